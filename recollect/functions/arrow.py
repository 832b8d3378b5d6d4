"""Wrapping a plain function of one value as an Arrow column function; memory of the Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DataType, StringType


def _allocator():
    """The C library's call that gives freed memory back to the system, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


_TRIM = _allocator()


def give_back() -> None:
    """Return what freed arrays took: Python workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def per_value(function: Callable, returns: DataType | None = None, arrow: pa.DataType = pa.string()):
    """Column function applying ``function`` to every non-NULL value of an Arrow batch.

    Declared nondeterministic only so that the optimizer never evaluates it
    twice, for instance once more inside a filter pushed below it.
    """

    @arrow_udf(returns or StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], arrow)

    return run.asNondeterministic()
