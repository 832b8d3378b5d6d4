"""Token counts through a cache of content digests (operator 7).

The cache is a Parquet folder of ``(version, digest, n_tokens)``. A call joins
the digests of the normalised texts to it, encodes one text of each digest that
is missing, appends those counts, and joins once more.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.word_ids import word_encoder
from recollect.session import ship

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Texts given to the library at once, by number and by characters.
_BATCH, _BATCH_CHARS = 64, 1 << 20


def collapsed_space(text: Column) -> Column:
    """Normal form under tokenizers that drop white space: one space between words."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unchanged(text: Column) -> Column:
    """Normal form under tokenizers that keep every character."""
    return text


def tokenizer_version(path: str, library: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    with open(path, "rb") as source:
        return hashlib.sha256(source.read() + library.encode()).hexdigest()


def load_encoder(path: str) -> tuple[str, Callable[[list[str]], list[int]]]:
    """The library's version and a function from texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return f"sentencepiece {sentencepiece.__version__}", lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return f"tokenizers {tokenizers.__version__}", lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    batch, chars = [], 0
    for text in texts:
        if batch and (len(batch) >= _BATCH or chars + len(text) > _BATCH_CHARS):
            yield batch
            batch, chars = [], 0
        batch.append(text)
        chars += len(text)
    if batch:
        yield batch


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an absent cache is created empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, text: str = "text", normalise: Callable[[Column], Column] = unchanged, by_word: bool = False
) -> DataFrame:
    """``docs`` with ``digest`` (of the normalised text), ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer`` is the path of a vocabulary file, ``.json`` for tokenizers and
    ``.model`` for sentencepiece, readable on every executor. Counts are without
    begin, end or added special tokens; strings of special tokens inside a text
    are handled as the library does by default. ``by_word`` may be set for a
    vocabulary that drops white space: each distinct word then goes to the library once.

    A NULL text counts as empty: 0 bytes, 0 tokens. Repeated rows and copies are
    encoded once and every row keeps its count. Columns of ``docs`` named like an
    added one are replaced; others pass through. An empty table gives no rows.
    Running again over a warm cache encodes nothing.
    """
    spark = ship(docs.sparkSession)
    library, _ = load_encoder(tokenizer)
    version = tokenizer_version(tokenizer, library)
    known = open_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def digest(column):
        return F.unhex(F.sha2(normalise(column).cast("binary"), 256))

    whole = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(digest(whole).alias("digest"), whole.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None if by_word else load_encoder(tokenizer)[1]
        for batch in batches:
            if by_word:
                before = [word_encoder(tokenizer).encode(part.column("text"))[1] for part in tx.slices(batch, "text")]
                counts = np.concatenate([np.diff(b) for b in before]) if before else np.empty(0, np.int64)
            else:
                counts = [n for part in _batches(batch.column("text").to_pylist()) for n in count(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column("digest"), pa.array(counts, pa.int64())],
                ["version", "digest", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    added = ("digest", "n_bytes", "n_tokens")
    rows = docs.select(
        *[c for c in docs.columns if c not in added],
        digest(whole).alias("digest"), F.octet_length(whole).cast("bigint").alias("n_bytes"),
    )
    fresh = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return rows.join(fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest")
