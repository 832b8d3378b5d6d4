"""Rounding to a few digits that does not depend on the engine.

A double is rounded by its exact value: ``x * 20000`` (for four digits) is taken as an unevaluated
sum of a product and its error (Veltkamp splitting), which decides on which side
of the half-way point ``x`` lies. Plain IEEE operations, so Spark, NumPy and SQL
agree bit for bit, and true ties go to the even digit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import let

SCALE = 10000.0
_SPLIT = 134217729.0  # 2**27 + 1


def _rounded(x: Column, scale: float) -> Column:
    def rounded(v: Column) -> Column:
        twice = v * (2 * scale)
        high = v * _SPLIT - (v * _SPLIT - v)
        error = (high * (2 * scale) - twice) + (v - high) * (2 * scale)
        low = F.floor(twice / 2).cast("double")
        side = (twice - (low * 2 + 1)) + error
        up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(low % 2)
        return (low + up) / scale

    return let(x, lambda v: F.signum(v) * rounded(F.abs(v)))


def round4(x: Column) -> Column:
    return _rounded(x, SCALE)


def fixed3(x: Column) -> Column:
    """Text with three decimals; the JVM's formatter alone rounds the shortest decimal form, not the value."""
    return F.format_string("%.3f", _rounded(x, 1000.0))


def round4_array(x: np.ndarray) -> np.ndarray:
    v = np.abs(x)
    twice = v * (2 * SCALE)
    high = v * _SPLIT - (v * _SPLIT - v)
    error = (high * (2 * SCALE) - twice) + (v - high) * (2 * SCALE)
    low = np.floor(twice / 2)
    side = (twice - (low * 2 + 1)) + error
    up = np.where(side > 0, 1.0, np.where(side < 0, 0.0, low % 2))
    return np.sign(x) * (low + up) / SCALE
