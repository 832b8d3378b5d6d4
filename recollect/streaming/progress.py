"""Counters of streams over their whole life, from the streams' own events.

A listener writes one row per scan to a table: a batch, a scan that found nothing, or the
failure that ended a run. So empty and failed scans count as well, and totals go on after a
restart, as they are sums over the table.
"""

from __future__ import annotations

import datetime as dt
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCANS = "query string, run string, kind string, batch_id bigint, at string, rows bigint, seconds double, error string"
BATCH, EMPTY, FAILED = "batch", "empty", "failed"


class ScanLog(StreamingQueryListener):
    """Writes the scans of the named queries below ``path`` while it is attached to the session.

    ``scans_of`` is the table; a row that can't be written is kept and goes with the next.
    """

    def __init__(self, spark: SparkSession, path: str, *names: str):
        self.spark, self.path, self.names = spark, path.rstrip("/"), set(names)
        self.runs: dict[str, str] = {}
        self.told: set[str] = set()
        self.pending: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> ScanLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the run's end is in the table; events come a little after the query itself."""
        self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)

    def _put(self, run: str, kind: str, batch_id=None, at=None, rows=0, seconds=None, error=None) -> None:
        if run not in self.runs:
            return
        self.told.add(run)
        stamp = at or dt.datetime.now(dt.timezone.utc).isoformat()
        with self.lock:
            self.pending.append((self.runs[run], run, kind, batch_id, stamp, rows, seconds, error))
            try:
                self.spark.createDataFrame(self.pending, SCANS).coalesce(1).write.mode("append").parquet(self.path)
                self.pending = []
            except Exception:  # a listener must not end the stream; the rows stay for the next write
                pass

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.runs[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        kind = BATCH if p.numInputRows else EMPTY
        self._put(str(p.runId), kind, p.batchId, p.timestamp, p.numInputRows, p.batchDuration / 1000.0)

    def onQueryIdle(self, event) -> None:
        self._put(str(event.runId), EMPTY, at=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception:
            lines = event.exception.strip().splitlines()
            named = [line for line in lines if re.match(r"[\w.]*(Error|Exception)\b", line)]
            self._put(run, FAILED, error=(named or lines)[-1][:500])
        elif run not in self.told:
            # A run that takes what is there and finds nothing tells nothing of it.
            self._put(run, EMPTY)
        self.ended.setdefault(run, threading.Event()).set()


def scans_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCANS).parquet(path)


def scan_totals(scans: DataFrame) -> DataFrame:
    """Per query: all scans, those with work, without, and failed, rows taken in, and the last error."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return scans.groupBy("query").agg(
        F.count("*").alias("scan_count"), kind(BATCH).alias("batches"), kind(EMPTY).alias("empty_scans"), kind(FAILED).alias("failed_scans"),
        F.sum("rows").alias("rows"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("last_error"),
    )
