"""Embedding of texts: a long form and a dense form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions import text as tx
from recollect.functions.vectors import DIGITS, EMBEDDER, embedded, embedder
from recollect.operators.chunks import stored_body
from recollect.settings import DEFAULTS


def embedding_weights(texts: DataFrame, key: str = "chunk_id", content: str = "content",
                      dim: int = DEFAULTS.semantic.dim) -> DataFrame:
    """(key, idx, w) with the non-zero slots of the unit vector, unrounded. ``key`` must identify a text.

    Narrow: a text's features are counted where it lies, so neither they nor the
    texts are sorted, spilled or shuffled.
    """
    base = texts.select(key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, vecs in embedded(batch.column(1), dim):
                row, slot = np.nonzero(vecs)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + row)), pa.array(slot, pa.int32()), pa.array(vecs[row, slot])], schema.names)

    schema = T.StructType([base.schema[key], T.StructField("idx", T.IntegerType()), T.StructField("w", T.DoubleType())])
    return base.mapInArrow(run, schema)


def rounded_weights(weights: DataFrame) -> DataFrame:
    """Stored precision; slots that round to zero are absent."""
    return weights.withColumn("w", F.round("w", DIGITS)).where(F.col("w") != 0)


def with_vectors(chunks: DataFrame, dim: int = DEFAULTS.semantic.dim,
                 vectorize: Callable[[Column], Column] | None = None, name: str = EMBEDDER) -> DataFrame:
    """The index: chunks plus ``embedder, dim, vec``; texts without a feature drop out.

    Narrow: each task embeds its own rows in Arrow batches, nothing is shuffled.
    ``vectorize`` puts another embedder in place of feature hashing: a column
    function (say, a pandas UDF) from text to ``array<double>`` of length
    ``dim``, NULL for no vector, under its own ``name``.
    """
    return chunks.select(
        "*",
        F.lit(name).alias("embedder"),
        F.lit(dim).alias("dim"),
        (vectorize or embedder(dim))(stored_body(chunks)).alias("vec"),
    ).where(F.col("vec").isNotNull())


def has_feature(chunks: DataFrame) -> Column:
    """Whether a chunk gets a vector at all."""
    return F.lower(stored_body(chunks)).rlike(tx.TOKEN)


def sync_stats(index: DataFrame, chunks: DataFrame, dim: int = DEFAULTS.semantic.dim) -> DataFrame:
    """One row ``total, added, removed, rebuilt`` for the pending sync."""
    usable = (F.col("embedder") == EMBEDDER) & (F.col("dim") == dim)
    known = index.select("chunk_id", usable.alias("usable"))
    wanted = chunks.select("chunk_id", has_feature(chunks).alias("indexable"))
    both = known.join(wanted, "chunk_id", "full_outer")
    u = F.coalesce("usable", F.lit(False))
    here = F.col("indexable").isNotNull()
    add = here & ~u & F.coalesce("indexable", F.lit(False))
    return both.agg(
        F.count_if((u & here) | add).alias("total"),
        F.count_if(add).alias("added"),
        F.count_if(u & ~here).alias("removed"),
        F.coalesce(F.bool_or(F.col("usable").isNotNull() & ~u), F.lit(False)).alias("rebuilt"),
    )


def index_version(chunks: DataFrame) -> DataFrame:
    """Twelve-digit fingerprint of the set of chunk ids, in whatever order they come.

    The digest of their number and of the sums of both leading twelve-digit
    halves, one partial aggregate at every size. (A digest of all ids in a row
    would be one sequential hash over the whole store.)
    """
    half = lambda start: F.conv(F.substring("chunk_id", start, 12), 16, 10).cast("decimal(38,0)")
    parts = [F.count("*"), *[F.coalesce(F.sum(half(s)), F.lit(0)) for s in (1, 13)]]
    text = F.concat_ws(",", *[p.cast("string") for p in parts])
    return chunks.agg(F.substring(F.md5(text.cast("binary")), 1, 12).alias("version"))
