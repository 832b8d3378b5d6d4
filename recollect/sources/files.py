"""Raw files as a DataFrame, and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.sources.documents import extract_text

LOG_SCHEMA = "ts string, level string, msg string"


def scan_raw_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files below ``path``: path, modificationTime, length, content, kind.

    Columns not asked for (the content above all) are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).withColumn("kind", tx.file_kind(F.col("path")))


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme prefix the file system added."""
    return F.regexp_replace(path, r"^.*\Q" + root.rstrip("/") + r"\E/", "")


def raw_texts(files: DataFrame, root: str) -> DataFrame:
    """(path, raw) as :func:`recollect.operators.chunking.ingest` takes them."""
    kind = tx.file_kind(F.col("path"))
    return files.select(
        relative_to(F.col("path"), root).alias("path"),
        extract_text(F.col("content"), kind).alias("raw"),
    )


def log_tail(lines: DataFrame, line: str, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` well-formed JSON log lines; malformed ones do not count."""
    parsed = lines.withColumn("_e", F.from_json(F.col(line), LOG_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where((F.trim(line) != "") & F.col("_e").isNotNull() & F.col("_e")["_bad"].isNull())
    return good.orderBy(F.col(order).desc()).limit(n).select(
        order, F.col("_e")["ts"].alias("ts"), F.upper(F.col("_e")["level"]).alias("level"), F.col("_e")["msg"].alias("msg")
    )
