"""Formats whose exact output needs a parser: bytes, JSON, CSV.

Small Arrow functions around the standard library; one call handles a batch.
"""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.arrow import per_value
from recollect.functions.text import BLANKS


def _legacy(raw: bytes) -> str:
    try:
        return raw.decode("cp1251")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


_decode_legacy = per_value(_legacy)


def decode_text(data: Column) -> Column:
    """UTF-8 (a byte order mark stays), else Windows-1251, else Latin-1.

    The UTF-8 test is native; only bytes that fail it carry a value into Python.
    """
    utf8 = F.try_validate_utf8(data.cast("string"))
    return F.coalesce(utf8, _decode_legacy(F.when(utf8.isNull(), data)))


def _pretty(raw: str) -> str:
    try:
        return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return raw.strip(BLANKS)


# JSON with two-space indent; what does not parse is only trimmed.
normalize_json = per_value(_pretty)


def _table(raw: str) -> str:
    try:
        rows = [[cell.strip() for cell in row] for row in csv.reader(raw.splitlines())]
    except csv.Error:
        return raw.strip()
    if not rows:
        return ""
    width = len(rows[0])
    rule = "|" + "|".join("---" for _ in range(width)) + "|"
    shaped = ["| " + " | ".join((row + [""] * (width - len(row)))[:width]) + " |" for row in rows]
    return "\n".join([shaped[0], rule, *shaped[1:]])


# CSV text as a Markdown table of the header's width.
csv_to_markdown = per_value(_table)
