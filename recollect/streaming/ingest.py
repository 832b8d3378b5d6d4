"""Continuous ingestion: a file stream into the note store.

The stream's checkpoint remembers which files were read; ``cleanSource`` can
move them away. Every writer of the store has a name of its own, a stream that of
its checkpoint. A micro-batch writes its own ``writer, batch_id`` partitions of
the store and the log and ignores them when it looks for known chunks, so a batch
that runs again after a failure replaces what it wrote and changes nothing else.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.operators import chunking as cg
from recollect.operators import chunks as ck
from recollect.settings import DEFAULTS, Settings
from recollect.sources.files import raw_texts

STORE_SCHEMA = (
    "chunk_id string, seq bigint, content string, tags array<string>, project_id string, agent_id string, "
    "source string, trust double, created_at string, writer string, batch_id bigint"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LOG_SCHEMA = "path string, kind string, status string, reason string, chunks int, writer string, batch_id bigint"
PARTITIONS = ("writer", "batch_id")
#: The writer of notes that are added by hand.
BY_HAND = "notes"


def writer_of(checkpoint: str) -> str:
    """The name under which the stream of a checkpoint writes."""
    return "stream-" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def create_table(spark: SparkSession, path: str, schema: str) -> str:
    """An empty table, partitioned by writer and batch if it has them, unless there is one."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException:
        empty = spark.createDataFrame([], schema).write.mode("append")
        (empty.partitionBy(*PARTITIONS) if "writer string, batch_id" in schema else empty).parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, writer: str = BY_HAND) -> None:
    df.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch_id={batch_id}")


def insert_notes(notes: DataFrame, store_dir: str, batch_id: int, writer: str = BY_HAND) -> None:
    """Append the notes whose content the store does not hold, first come first.

    ``notes`` has the note columns and an order ``ord`` within the batch. ``seq``
    goes on from the store's highest, in the batch's sort order; it may leave gaps.
    """
    spark = notes.sparkSession
    own = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
    earlier = read_table(spark, store_dir, STORE_SCHEMA).where(~own)
    base = earlier.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    fresh = ck.new_chunks(ck.identify(notes).withColumnRenamed("ord", "seq"), earlier)
    placed = fresh.repartitionByRange("seq").sortWithinPartitions("seq")
    numbered = placed.withColumn("seq", F.lit(base) + F.monotonically_increasing_id())
    write_batch(numbered.select("chunk_id", "seq", *ck.NOTE_COLUMNS), store_dir, batch_id, writer)


def _ingest_batch(root: str, store_dir: str, log_dir: str, writer: str, settings: Settings):
    def run(files: DataFrame, batch_id: int) -> None:
        # Both tables come from one evaluation of the files.
        done = cg.ingest(raw_texts(files, root), settings.ingestion.max_chunk_chars).persist()
        try:
            log = done.select("path", "kind", "status", "reason", F.size("chunks").alias("chunks"))
            write_batch(log, log_dir, batch_id, writer)
            notes = cg.file_chunks(done, "path").select(
                F.struct("path", "pos").alias("ord"), "content", "tags", "project_id", "source",
                F.lit(None).cast("string").alias("agent_id"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
            )
            insert_notes(notes, store_dir, batch_id, writer)
        finally:
            done.unpersist()

    return run


def start_ingest(
    spark: SparkSession, raw_dir: str, store_dir: str, log_dir: str, checkpoint: str,
    archive_dir: str | None = None, poll_seconds: int | None = None, settings: Settings = DEFAULTS, files_per_batch: int | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Watch ``raw_dir``; each folder needs a checkpoint of its own. Without ``poll_seconds`` the query takes what is there and ends.

    The returned query is the watcher's handle: ``stop()``, ``status``,
    ``lastProgress``. Files move to ``archive_dir`` after their batch if given. Under
    its ``name`` a :class:`recollect.streaming.progress.ScanLog` counts its scans.
    """
    create_table(spark, store_dir, STORE_SCHEMA)
    create_table(spark, log_dir, LOG_SCHEMA)
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        reader.load(raw_dir).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(_ingest_batch(raw_dir, store_dir, log_dir, writer_of(checkpoint), settings))
    )
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**trigger).start()


def start_notes(notes: DataFrame, store_dir: str, checkpoint: str) -> StreamingQuery:
    """A stream of notes (with ``ord``) into the store; repeats across batches add nothing."""
    create_table(notes.sparkSession, store_dir, STORE_SCHEMA)
    return (
        notes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: insert_notes(batch, store_dir, batch_id, writer_of(checkpoint)))
        .trigger(availableNow=True).start()
    )


def batch_counts(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per scan: files ingested, skipped, failed."""
    status = F.col("status")
    return log.groupBy(batch).agg(
        F.count("*").alias("scanned"), F.count_if(status == "ingested").alias("ingested"),
        F.count_if(status == "skipped").alias("skipped"), F.count_if(status == "error").alias("errors"),
    )


def running_totals(counts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Scan number and cumulative totals after each scan.

    The window sees one small row per scan: aggregate with :func:`batch_counts` first.
    """
    upto = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        batch, F.row_number().over(Window.orderBy(batch)).alias("scan_count"),
        F.sum("ingested").over(upto).alias("total_ingested"), F.sum("errors").over(upto).alias("total_errors"),
    )
