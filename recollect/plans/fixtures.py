"""Entities derived from the benchmark tables, for the registered queries.

The same derivations, as SQL, are in :mod:`recollect.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.items import turn_item
from recollect.session import work_dir
from recollect.functions.trust import source_trust

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the table's files, be it one file or a folder of them; as a plain path the source takes folders only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _stamp(minutes):
    ts = F.expr(f"TIMESTAMP_NTZ '{EPOCH}'") + F.make_interval(mins=minutes.cast("int"))
    return ts


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an inserted note; copies of a text are still there."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc.alias("seq"),
        F.col("text").alias("content"),
        F.md5(F.col("text").cast("binary")).alias("chunk_id"),
        F.array(F.lit("#doc"), F.lit("#source:text"), F.concat(F.lit("#lang_"), "lang")).alias("tags"),
        F.when(doc % 3 != 0, F.col("source")).alias("project_id"),
        F.concat(F.lit("agent_"), (doc % 5).cast("string")).alias("agent_id"),
        _source(doc).alias("source"),
        source_trust(_source(doc)).alias("trust"),
        F.date_format(_stamp(doc), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def _source(doc):
    n = doc.cast("string")
    return (
        F.when(doc % 4 == 0, F.concat(F.lit("https://docs.python.org/3/"), n))
        .when(doc % 4 == 1, F.concat(F.lit("https://blog.example/"), n))
        .when(doc % 4 == 2, F.concat(F.lit("notes/"), n, F.lit(".md")))
    )


def sessions(spark: SparkSession, sf_dir: str, width: int = 1) -> DataFrame:
    """Archived sessions, each made of ``width`` consecutive conversations."""
    conv = table(spark, sf_dir, "conversations")
    s = conv.select(F.floor(F.col("conv_id") / width).cast("bigint").alias("session_no")).distinct()
    return _session_columns(s)


def _session_columns(s: DataFrame) -> DataFrame:
    no = F.col("session_no")
    stamp = F.date_format(_stamp(F.floor(no / 2) * 14), "yyyyMMdd_HHmm")
    return s.select(
        "session_no",
        F.concat(F.lit("agent_"), (no % 4).cast("string")).alias("agent_id"),
        F.concat(F.lit("proj_"), (no % 3).cast("string")).alias("project_id"),
        stamp.alias("session_ts"),
        F.concat(F.lit("archive/"), no.cast("string"), F.lit(".json")).alias("file"),
        F.when(no % 5 == 3, "collapsed").when(no % 5 == 1, "summarized").otherwise("archived").alias("status"),
    )


def session_items(spark: SparkSession, sf_dir: str, width: int = 1) -> DataFrame:
    """The sessions' items: one row per turn under a session key."""
    conv = table(spark, sf_dir, "conversations")
    key = F.element_at(
        F.array(*map(F.lit, ["custom_metric", "actions", "decisions", "chat_history", "next_steps", "done"])),
        (F.col("turn") % 6 + 1).cast("int"),
    )
    return conv.select(
        F.floor(F.col("conv_id") / width).cast("bigint").alias("session_no"),
        (F.col("turn") % 6).cast("int").alias("key_pos"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_pos"),
        key.alias("raw_key"),
        turn_item(F.col("role"), F.col("text")).alias("item"),
        "role",
        "text",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("proj_"), (F.col("user_id") % 10).cast("string")).alias("project_id"),
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit(" "), "props").alias("decision"),
        F.array(
            F.concat(F.lit("agent_"), (F.col("user_id") % 8).cast("string")),
            F.concat(F.lit("agent_"), (F.col("event_id") % 3).cast("string")),
        ).alias("by_agents"),
        F.concat(F.lit("seen by user "), F.col("user_id").cast("string")).alias("reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task per three consecutive events: the first starts it, others may end it."""
    e = table(spark, sf_dir, "events")
    task = F.floor(F.col("event_id") / 3)
    return e.select(
        F.concat(F.lit("task_"), task.cast("bigint").cast("string")).alias("task_id"),
        F.concat(F.lit("agent_"), (task % 8).cast("bigint").cast("string")).alias("agent_id"),
        F.concat(F.lit("proj_"), (task % 10).cast("bigint").cast("string")).alias("project_id"),
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        F.when(F.col("event_id") % 3 == 0, "start")
        .when(F.col("event_type") == "purchase", "end")
        .when(F.col("event_type") == "error", "cancel")
        .otherwise("note").alias("action"),
        F.col("event_type").alias("description"),
    )


def task_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task events with all fields, some tasks started again by another agent, and one ``clear`` early on."""
    e, no = task_events(spark, sf_dir), F.col("seq")
    again = (no % 3 == 2) & (no % 15 == 2)
    action = F.when(no == 302, "clear").when(again, "start").otherwise(F.col("action"))
    context = F.when(no % 4 != 0, F.concat(F.lit("context of "), F.repeat(F.concat("agent_id", F.lit(" ")), (no % 40).cast("int"))))
    ended = (F.col("action") == "end") & (no % 2 == 0)
    return e.select(
        "task_id", F.when(again, F.concat(F.lit("agent_"), (no % 8).cast("string"))).otherwise(F.col("agent_id")).alias("agent_id"), "project_id", "seq", "at", action.alias("action"),
        "description", F.concat(F.lit("model_"), (no % 3).cast("string")).alias("model"), F.when(no % 5 == 0, "deep").alias("variant"),
        F.when(no % 6 != 0, F.array(F.col("description"), F.lit("#task"))).alias("tags"), context.alias("context"),
        F.when(ended, F.concat(F.lit("archive/"), no.cast("string"), F.lit(".json"))).alias("archive"),
        F.when(ended, F.create_map(F.lit("done"), no % 10, F.lit("next"), no % 7)).alias("stats"),
    )


DOCS_PER_FILE = 50


def raw_text_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files of fifty, paragraphs apart, in a fresh raw folder."""
    raw = work_dir(spark, "raw")
    d = table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / DOCS_PER_FILE).cast("bigint"))
    body = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n"))
    (
        d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", body.alias("value"))
        .write.partitionBy("part").text(raw)
    )
    # Spark names its files .txt, a supported kind; markers start with "_" and are not listed.
    return raw


def raw_text_folder(spark: SparkSession, sf_dir: str) -> str:
    """The same files side by side in one folder, as an inbox has them; a folder for each takes longer to make than its file."""
    raw = work_dir(spark, "raw")
    d = table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / DOCS_PER_FILE).cast("bigint"))
    body = F.coalesce(F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n")), F.lit(""))
    docs = F.array_sort(F.collect_list(F.struct("doc_id", body.alias("body"))))
    files = d.repartition("part").groupBy("part").agg(F.array_join(F.transform(docs, lambda x: x["body"]), "\n").alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(raw)  # a record is a whole file
    return raw
