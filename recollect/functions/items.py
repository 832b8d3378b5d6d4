"""Readable items out of arbitrary session JSON (recursive, hence Python)."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from recollect.functions.arrow import per_value
from recollect.functions.text import strip

# Fields that hold an item's text, best first, and its speaker.
TEXT_FIELDS = ("content", "text", "decision", "summary", "note", "message",
               "item", "desc", "description", "result", "value", "текст")
SPEAKER_FIELDS = ("role", "author", "agent")

ITEM_TYPE = ArrayType(StructType([
    StructField("key_pos", IntegerType()), StructField("item_pos", IntegerType()),
    StructField("raw_key", StringType()), StructField("item", StringType()),
]))
_ARROW_ITEM = pa.list_(pa.struct([("key_pos", pa.int32()), ("item_pos", pa.int32()),
                                  ("raw_key", pa.string()), ("item", pa.string())]))


def _filled(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _from_mapping(value: dict) -> str | None:
    text = next((value[f].strip() for f in TEXT_FIELDS if _filled(value.get(f))), None)
    if text is None:
        scalars = [f"{k}: {v}" for k, v in value.items() if isinstance(v, (str, int, float)) and str(v).strip()]
        return "; ".join(scalars) or None
    speaker = next((value[f] for f in SPEAKER_FIELDS if value.get(f)), None)
    return f"[{speaker.strip()}] {text}" if _filled(speaker) else text


def flatten(value: Any):
    """Yield the readable texts of any JSON value, in order; a stack takes any depth."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            text = _from_mapping(value)
            if text is not None:
                yield text
        elif isinstance(value, str):
            if value.strip():
                yield value
        elif value is not None:
            yield str(value)


def _rows(raw: str) -> list[dict] | None:
    try:
        data = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    if isinstance(data, str):
        groups = [("done", [data])]
    elif isinstance(data, list):
        groups = [("done", list(flatten(data)))]
    elif isinstance(data, dict):
        groups = [(key, list(flatten(value))) for key, value in data.items()]
    else:
        groups = []
    return [
        {"key_pos": k, "item_pos": i, "raw_key": key, "item": item}
        for k, (key, items) in enumerate(groups)
        for i, item in enumerate(items)
    ]


# Items of a session document with their key and both positions. A bare text
# or list counts as what was done. NULL for a document that is no JSON.
session_items = per_value(_rows, ITEM_TYPE, _ARROW_ITEM)


def turn_item(role: Column, text: Column) -> Column:
    """``[role] text`` of a flat dialog turn, natively."""
    body = strip(text)
    who = strip(F.coalesce(role, F.lit("")))
    return F.when(who == "", body).otherwise(F.concat(F.lit("["), who, F.lit("] "), body))
