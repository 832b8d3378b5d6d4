"""Token-id files: frequency-ranked ids, byte-aligned, control bytes apart (operator 9).

A folder ``blocks`` holds one Parquet row per block of documents, in ascending
``doc_id`` order within and between shards: ``control`` has two bits per id, the
number of its bytes less one, and ``data`` has those bytes. An id is written as
its rank by corpus frequency, so the commonest 256 take one byte each. A folder
``ranks`` holds the ids in rank order. Parquet is only the container that Spark
commits atomically; the coding is the one here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.word_ids import word_encoder
from recollect.session import ship, work_dir

STAGE_SCHEMA = "doc_id bigint, tag bigint, ids binary"
BLOCK_SCHEMA = "shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary"
#: A block is closed when it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18

#: Bytes of the four ids of each control byte, first id in the low bits.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    full = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    full[: len(code)] = code
    control = (full.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    kept = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``pack``: lengths from the table, then one gather per byte place."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for place in range(4):
        has = np.flatnonzero(lengths > place)
        if not len(has):
            break
        out[has] |= raw[starts[has] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each, and write the files to ``path``.

    ``tokenizer`` is a vocabulary whose normaliser drops white space. A NULL or
    empty text is its end id alone. Rows go in ascending ``doc_id`` order, NULL
    first, rows of one ``doc_id`` in the order of a hash of their texts; repeated
    rows are all written. Other columns are ignored. Ids are encoded once into a
    staging table, which the ranking and the writing read.
    """
    spark = ship(docs.sparkSession)
    staged = work_dir(spark, "token-ids")
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = _width(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                ids, before = encoder.encode(batch.column("text"))
                ids = ids.astype(width)
                end = np.array([end_id], width)
                packed = [np.concatenate((ids[a:b], end)).tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(packed, pa.binary())], ["doc_id", "tag", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    rows.mapInArrow(encode, STAGE_SCHEMA).write.parquet(staged)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            data, _ = tx.text_bytes(batch.column("ids"))
            total += np.bincount(data.view(width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    ids = spark.read.schema(STAGE_SCHEMA).parquet(staged)
    # At most one row per id of the vocabulary reaches the driver.
    counts = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ordered = [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(enumerate(ordered), "rank int, id bigint").write.parquet(f"{path}/ranks")
    ranks = np.zeros(vocabulary, np.uint32)
    ranks[ordered] = np.arange(len(ordered), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, held = [], [], []

        def close():
            nonlocal number, first
            n = sum(counts)
            control, data = pack(ranks[np.concatenate(held)])
            values = [[shard], [number], [first], [n], [doc_ids], [counts], [control], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            row = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
            number, first = number + 1, first + n
            for x in (doc_ids, counts, held):
                x.clear()
            return row

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                values = np.frombuffer(value.as_buffer(), width)
                n = len(values)
                if counts and sum(counts) + n > BLOCK_IDS:
                    yield close()
                doc_ids.append(doc_id)
                counts.append(n)
                held.append(values)
        if counts:
            yield close()

    shards = ids.repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    shards.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids`` (binary, unsigned 32-bit little-endian)."""
    ship(spark)
    ordered = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One small row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                counts = np.array(one["n_tokens"].as_py(), np.int64)
                ids = ordered[unpack(one["control"].as_buffer(), one["data"].as_buffer(), int(counts.sum()))].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                start = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one["doc_ids"].as_py(), pa.int64()), pa.array(start + one["first"].as_py() + one["base"].as_py(), pa.int64()),
                        pa.array(counts, pa.int64()), pa.array([ids[4 * a: 4 * b] for a, b in zip(start.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(shards, "shard").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def crc32(ids: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc32_of(ids: list[int]) -> int:
    """The same over a list; for tests and readers outside Spark."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
