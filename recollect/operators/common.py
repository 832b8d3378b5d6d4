"""Grouped picks and numbering that stay balanced when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate, not a window: every map task reduces its share of a hot key
    to one row before the shuffle.
    """
    row = F.struct(order, *[c for c in columns if c != order])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in dict.fromkeys([order, *columns])])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key with their rank.

    ``row_number() <= n`` makes Spark cut each group to ``n`` rows on the map
    side (WindowGroupLimit), so a hot key ships at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def number_in_group(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, name: str = "n"
) -> DataFrame:
    """0-based position of each row within its key, for groups of any size.

    ``block`` must not decrease with ``order``. Rows are numbered inside
    (key, block); the blocks' counts, one small row each, give the offsets.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_kb"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    ranked = blocked.withColumn("_rank", F.row_number().over(inner) - 1)
    match = (F.col("_block") == F.col("_kb"))
    for i, k in enumerate(keys):
        match = match & (F.col(k).eqNullSafe(F.col(f"_k{i}")))
    return (
        ranked.join(offsets, match)
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, name)
    )
