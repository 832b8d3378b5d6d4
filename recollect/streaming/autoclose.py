"""Closing of idle sessions: a session ends when its user was silent for the timeout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from recollect.settings import DEFAULTS


def _seconds(events: DataFrame, ts: str) -> Column:
    """Whole seconds on the column's own time line, whatever the session's zone."""
    c = F.col(ts)
    if isinstance(events.schema[ts].dataType, TimestampNTZType):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        return days * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(c)


def idle_sessions(events: DataFrame, who: str, ts: str, timeout_min: int = DEFAULTS.summaries.autoclose_minutes) -> DataFrame:
    """(who, started, last_seen, events) of a table of events.

    Events of one time slot as wide as the timeout always share a session, so
    they are first aggregated per (who, slot) on the map side. What remains of
    even the busiest user is one row per slot; a gap between neighbouring slots
    longer than the timeout separates sessions.
    """
    slot = F.floor(_seconds(events, ts) / (timeout_min * 60))
    slots = events.groupBy(who, slot.alias("_slot")).agg(
        F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("events")
    )
    order = Window.partitionBy(who).orderBy("_slot")
    silence = F.col("started") - F.lag("last_seen").over(order)
    first = F.coalesce(silence > F.make_dt_interval(mins=F.lit(timeout_min)), F.lit(True)).cast("int")
    return (
        slots.withColumn("_first", first)
        .withColumn("_session", F.sum("_first").over(order))
        .groupBy(who, "_session")
        .agg(F.min("started").alias("started"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))
        .drop("_session")
    )


def idle_sessions_stream(events: DataFrame, who: str, ts: str, timeout_min: int = DEFAULTS.summaries.autoclose_minutes) -> DataFrame:
    """The same on a stream with a watermark on ``ts``.

    In append mode a session is emitted once the watermark has passed its
    timeout, which is the close. State is one row per open session.
    """
    window = F.session_window(F.col(ts), f"{timeout_min} minutes")
    return (
        events.groupBy(who, window.alias("w"))
        .agg(F.count("*").alias("events"), F.max(ts).alias("last_seen"))
        .select(who, F.col("w.start").alias("started"), "last_seen", "events")
    )
