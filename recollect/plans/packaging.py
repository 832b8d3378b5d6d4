"""Packs table text into DOCX and EPUB bytes, the input of the extractor queries."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql.types import BinaryType

from recollect.functions.arrow import per_value

_BAD_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return out.getvalue()


def _docx(text: str) -> bytes:
    paragraphs = "".join(
        f'<w:p><w:r><w:t>{escape(_BAD_XML.sub(" ", line))}</w:t></w:r></w:p>' for line in text.split("\n")
    )
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return _zip({"word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {space}><w:body>{paragraphs}</w:body></w:document>'})


def _epub(html: str) -> bytes:
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf"><manifest>'
        '<item id="z" href="end.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="a" href="text/one.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="i" href="cover.png" media-type="image/png"/></manifest>'
        '<spine><itemref idref="a"/><itemref idref="i"/><itemref idref="gone"/><itemref idref="z"/></spine></package>'
    )
    return _zip({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": package,
        "OEBPS/text/one.xhtml": html,
        "OEBPS/end.xhtml": "<html><body><h1>end</h1></body></html>",
        "OEBPS/cover.png": "x",
    })


docx_bytes = per_value(_docx, BinaryType(), pa.binary())
epub_bytes = per_value(_epub, BinaryType(), pa.binary())
