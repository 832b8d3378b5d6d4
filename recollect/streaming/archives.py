"""Auto-close of archived sessions as keyed state with event-time timers.

An archive opens a session and sets a timer; a summary of it cancels; where the timer
comes first the session is due and told once. The state of a session is a few values and
is dropped some time after its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recollect.settings import DEFAULTS

#: One session's archive, or a summary of it.
EVENT = "agent_id string, session_ts string, kind string, at timestamp, project_id string, file string"
DUE = "agent_id string, session_ts string, project_id string, file string, archived_at timestamp, due_at timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MINUTE = 60_000


def _millis(stamp) -> int:
    return int(pd.Timestamp(stamp).value // 1_000_000)


class ArchiveTimers(StatefulProcessor):
    """State of one (agent, session): ``open`` from the archive to its end, ``done`` from then until it is forgotten."""

    def __init__(self, timeout_min: int, forget_min: int):
        self.timeout, self.forget = timeout_min * _MINUTE, forget_min * _MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at timestamp, project_id string, file string, due bigint")
        self.done = handle.getValueState("done", "ended bigint")

    def _end(self, ended: int) -> None:
        if self.open.exists():
            self.open.clear()
        if not self.done.exists():
            self.done.update((ended,))
            self.handle.registerTimer(ended + self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, summed = None, None
        for part in rows:
            for row in part.itertuples(index=False):
                if row.kind == "archive":
                    if first is None or row.at < first.at:
                        first = row
                elif row.kind == "summary":
                    summed = row.at if summed is None else min(summed, row.at)
        if first is not None and not self.done.exists() and not self.open.exists():
            due = _millis(first.at) + self.timeout
            text = lambda v: None if pd.isna(v) else v
            self.open.update((first.at, text(first.project_id), text(first.file), due))
            self.handle.registerTimer(due)
        # A summary that is later than the timer comes too late, though the timer has not run yet.
        if summed is not None and (not self.open.exists() or _millis(summed) <= self.open.get()[3]):
            if self.open.exists():
                self.handle.deleteTimer(self.open.get()[3])
            self._end(_millis(summed))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            at, project, file, due = self.open.get()
            self._end(due)
            yield pd.DataFrame({
                "agent_id": [key[0]], "session_ts": [key[1]], "project_id": [project], "file": [file], "archived_at": [pd.Timestamp(at)],
                "due_at": [pd.Timestamp(due, unit="ms")],
            })
        elif self.done.exists():
            self.done.clear()

    def close(self) -> None:
        pass


def due_archives(
    events: DataFrame, timeout_min: int = DEFAULTS.summaries.autoclose_minutes, delay: str = "10 minutes", forget_min: int | None = None,
) -> DataFrame:
    """The archives that nobody summarized within the timeout, each once, when the watermark passes it.

    ``events`` is a stream of ``EVENT`` rows, in any order within ``delay``. A summary
    at the very end of the timeout still counts. Rows that repeat change nothing, also
    after the session's end, until ``forget_min`` (four timeouts, unless given) have passed.
    Rows of another kind are ignored; events later than the watermark are dropped by Spark.
    The query must be started with ``ROCKSDB`` as the session's state store, as ``start_autoclose`` does.
    """
    processor = ArchiveTimers(timeout_min, 4 * timeout_min if forget_min is None else forget_min)
    keyed = events.withWatermark("at", delay).groupBy("agent_id", "session_ts")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=DUE, outputMode="append", timeMode="eventtime")


def start_autoclose(
    events: DataFrame, close: Callable[[DataFrame, int], None], checkpoint: str, timeout_min: int = DEFAULTS.summaries.autoclose_minutes,
    delay: str = "10 minutes", poll_seconds: int | None = None,
) -> StreamingQuery:
    """Call ``close(due, batch_id)`` for what is due; it may see a batch again after a failure.

    Without ``poll_seconds`` the query takes what is there and ends; its timers go on
    with the next start from the same checkpoint.
    """
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
    writer = due_archives(events, timeout_min, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    conf = events.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKSDB)
    try:  # a query takes the session's settings as it starts
        return writer.foreachBatch(close).trigger(**trigger).start()
    finally:
        conf.set(STORE, before)
