"""Text out of binary documents: PDF, DOCX, EPUB, images.

Each extractor is an Arrow function over a column of file contents, so Spark
spreads the files over the cluster. Optional engines are looked up inside the
task; without one the result is '' and the file is reported, never raised.
"""

from __future__ import annotations

import importlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.arrow import per_value
from recollect.functions.formats import decode_text
from recollect.functions.html import DOCUMENT_RULES, to_text

# XML names of the two zipped formats, and the OCR languages.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OPF = "{http://www.idpf.org/2007/opf}"
OCR_LANGUAGES = ("eng", "rus")


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    runs = ("".join(t.text or "" for t in p.iter(WORD + "t")).strip() for p in root.iter(WORD + "p"))
    return "\n\n".join(run for run in runs if run)


def _package_path(archive: zipfile.ZipFile) -> str:
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    for element in container.iter():
        if element.tag.rpartition("}")[2] == "rootfile" and element.get("full-path"):
            return element.get("full-path")
    return next((n for n in archive.namelist() if n.lower().endswith(".opf")), "OEBPS/content.opf")


def _chapters(archive: zipfile.ZipFile) -> Iterator[str]:
    path = _package_path(archive)
    package = ElementTree.fromstring(archive.read(path))
    manifest = {i.get("id"): (i.get("href"), i.get("media-type", "")) for i in package.iter(OPF + "item")}
    names = set(archive.namelist())
    for ref in package.iterfind(f".//{OPF}spine/{OPF}itemref"):
        href, media = manifest.get(ref.get("idref"), (None, ""))
        if not href or not re.search("text|xml", media):
            continue
        places = (posixpath.join(posixpath.dirname(path), href), href)
        name = next((p for p in (q.lstrip("/") for q in places) if p in names), None)
        if name:
            yield to_text(archive.read(name).decode("utf-8", errors="replace"), DOCUMENT_RULES)


def epub_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return "\n\n".join(filter(None, _chapters(archive)))


def _pdf_pages(data: bytes) -> Iterator[list[str]]:
    """Page texts from each installed PDF engine that can read the file."""
    stream = io.BytesIO(data)
    engines = {
        "pypdf": lambda lib: [page.extract_text() or "" for page in lib.PdfReader(stream).pages],
        "fitz": lambda lib: [page.get_text() for page in lib.open(stream=data, filetype="pdf")],
    }
    for name, read in engines.items():
        if lib := _library(name):
            try:
                yield read(lib)
            except Exception:  # the next engine may cope
                continue


def pdf_text(data: bytes) -> str:
    pages = next(_pdf_pages(data), [])
    return "\n\n".join(p.strip() for p in pages if p.strip())


def image_text(data: bytes) -> str:
    """The first installed OCR engine that finds something."""
    tesseract, imaging = _library("pytesseract"), _library("PIL.Image")
    if tesseract and imaging:
        found = tesseract.image_to_string(imaging.open(io.BytesIO(data)), lang="+".join(OCR_LANGUAGES)).strip()
        if found:
            return found
    if easy := _library("easyocr"):
        reader = easy.Reader(lang_list=["en", "ru"], gpu=False)
        return "\n".join(reader.readtext(data, detail=0)).strip()
    return ""


def _extractor(extract: Callable[[bytes], str]):
    def guarded(data: bytes) -> str:
        try:
            return extract(data)
        except Exception:  # one broken file must not fail the job
            return ""

    return per_value(guarded)


extract_docx = _extractor(docx_text)
extract_epub = _extractor(epub_text)
extract_pdf = _extractor(pdf_text)
ocr_extract = _extractor(image_text)


def extract_text(content: Column, kind: Column) -> Column:
    """Raw text of a file of a known kind; other rows reach an extractor as NULL."""
    only = lambda name: F.when(kind == name, content)
    plain = F.when(~kind.isin("pdf", "docx", "epub", "image"), content)
    return F.coalesce(
        decode_text(plain), extract_pdf(only("pdf")), extract_docx(only("docx")),
        extract_epub(only("epub")), ocr_extract(only("image")),
    )


def ocr_scan(files: DataFrame) -> DataFrame:
    """Per image file: status, text length, preview of 200 characters."""
    text = F.col("_text")
    return (
        files.where(tx.file_kind(F.col("path")) == "image")
        .withColumn("_text", ocr_extract(F.col("content")))
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file"),
            F.when(F.coalesce(text, F.lit("")) != "", "success").otherwise("failed").alias("status"),
            F.nullif(F.length(text), F.lit(0)).alias("text_length"),
            F.nullif(F.substring(text, 1, 200), F.lit("")).alias("preview"),
        )
    )
