"""Registered queries: streams over the tables (T)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from recollect.plans import fixtures as fx
from recollect.plans import oracle as o
from recollect.session import work_dir
from recollect.streaming import archives as ar
from recollect.streaming import autoclose as ac
from recollect.streaming import ingest as ig
from recollect.streaming import progress as pg

_NL = "chr(10)"


def _finish(query):
    query.awaitTermination()


def _ingested(spark, sf, **options):
    store = ig.create_table(spark, work_dir(spark, "store"), ig.STORE_SCHEMA)
    raw, log = fx.raw_text_folder(spark, sf), work_dir(spark, "log")
    if options:  # a store in use: the titles of the pages are notes already
        pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("content"), F.array(F.lit("#page")).alias("tags"),
            *[F.lit(None).cast("string").alias(c) for c in ("project_id", "source", "agent_id")], F.lit("2024-01-01").alias("created_at"))
        ig.insert_notes(pages, store, 0)
    _finish(ig.start_ingest(spark, raw, store, log, work_dir(spark, "checkpoint"), **options))
    return ig.read_table(spark, store, ig.STORE_SCHEMA).select(
        "chunk_id", F.length("content").cast("bigint").alias("n_chars"), F.array_join("tags", ",").alias("tags"))


def stream_ingest(spark, sf):
    return _ingested(spark, sf)


def stream_ingest_used_store(spark, sf):
    """Several micro-batches into a store that already holds notes of another writer."""
    parts = fx.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] // fx.DOCS_PER_FILE + 1
    return _ingested(spark, sf, files_per_batch=max(1, -(-parts // 3)))


_PARAS = f"list_filter(list({o.blanks(f'replace(text, {_NL}, chr(32))')} ORDER BY doc_id), lambda x: x <> '')"
STREAM_INGEST = f"""WITH f AS (SELECT doc_id // {fx.DOCS_PER_FILE} AS part, {_PARAS} AS ps FROM documents GROUP BY 1),
c AS (SELECT unnest({o.pack('ps', _NL + ' || ' + _NL, 1200)}) AS chunk FROM f)
SELECT DISTINCT md5(chunk) AS chunk_id, length(chunk)::BIGINT AS n_chars, '#source:text,#doc' AS tags FROM c"""
STREAM_USED = STREAM_INGEST + " UNION ALL SELECT DISTINCT md5(url), length(url)::BIGINT, '#page' FROM pages WHERE url IS NOT NULL"


def stream_dedup(spark, sf):
    notes = fx.table_stream(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("content"), F.array(F.lit("#doc")).alias("tags"),
        F.col("source").alias("project_id"), F.lit(None).cast("string").alias("agent_id"),
        F.lit(None).cast("string").alias("source"), F.lit("2024-01-01").alias("created_at"))
    store = work_dir(spark, "store")
    _finish(ig.start_notes(notes, store, work_dir(spark, "checkpoint")))
    return ig.read_table(spark, store, ig.STORE_SCHEMA).select("chunk_id", "project_id", "trust")


STREAM_DEDUP = f"WITH {o.CHUNKS} SELECT chunk_id, d.source AS project_id, 0.5::DOUBLE AS trust FROM chunks c JOIN documents d ON d.doc_id = c.seq"


def _closed(df):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return df.select("user_id", stamp("started"), stamp("last_seen"), "events")


def session_gap_close(spark, sf):
    return _closed(ac.idle_sessions(fx.table(spark, sf, "events"), "user_id", "ts"))


_GAPS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 360 MINUTE THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
c AS (SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS events FROM s GROUP BY user_id, sid)"""
_CLOSED = "SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, events FROM c"


def stream_autoclose(spark, sf):
    """The same sessions from a stream: those the watermark has closed."""
    events = fx.table_stream(spark, sf, "events")
    # Event time on a stream needs a zoned timestamp; the session zone is fixed for both ways.
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")
    out = work_dir(spark, "closed")
    query = (
        ac.idle_sessions_stream(timed, "user_id", "ts").writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", work_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    )
    _finish(query)
    return _closed(spark.read.schema("user_id bigint, started timestamp, last_seen timestamp, events bigint").parquet(out))


STREAM_CLOSE = f"WITH {_GAPS} {_CLOSED} WHERE last_seen + INTERVAL 360 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _archive_events(spark, sf):
    """Archives, some repeated half an hour later; of some sessions a summary: early, at the very end of the timeout, or a minute after it."""
    sessions = fx.sessions(spark, sf)
    no = F.col("session_no")
    base = (F.floor(no / 2) * 14).cast("int")
    after = F.when(no % 5 == 1, 100).when(no % 5 == 2, 360).when(no % 5 == 4, 361)
    kinds = F.array(
        F.struct(F.lit("archive").alias("kind"), base.alias("minute")), F.struct(F.lit("archive").alias("kind"), F.when(no % 7 == 0, base + 30).alias("minute")),
        F.struct(F.lit("summary").alias("kind"), (base + after).alias("minute")))
    events = sessions.select("agent_id", "session_ts", "project_id", "file", F.explode(kinds).alias("e")).where("e.minute is not null")
    at = (F.expr(f"TIMESTAMP_NTZ '{fx.EPOCH}'") + F.make_interval(mins=F.col("e.minute"))).cast("timestamp")
    return events.select("agent_id", "session_ts", "e.kind", at.alias("at"), "project_id", "file", "e.minute")


def stream_autoclose_archives(spark, sf):
    """Archives that nobody summarized in time: four files, one a micro-batch, with a restart after the second."""
    events = _archive_events(spark, sf)
    last = events.agg(F.max("minute")).first()[0]
    raw, out, checkpoint = (work_dir(spark, name) for name in ("archive-events", "due", "checkpoint"))

    def close(due, batch_id):
        due.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for half in (0, 1):
        for quarter in (2 * half, 2 * half + 1):
            part = events.where(F.floor(F.col("minute") * 4 / (last + 1)) == quarter).drop("minute")
            part.coalesce(1).write.mode("append").parquet(raw)
        stream = spark.readStream.schema(ar.EVENT).option("maxFilesPerTrigger", 1).parquet(raw)
        _finish(ar.start_autoclose(stream, close, checkpoint))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    found = spark.read.schema(ar.DUE).option("recursiveFileLookup", "true").parquet(out)
    return found.select("agent_id", "session_ts", "project_id", "file", stamp("archived_at"), stamp("due_at"))


STREAM_ARCHIVES = f"""WITH {o.sessions()}, a AS (SELECT *, (session_no // 2) * 14 AS m, CASE session_no % 5 WHEN 1 THEN 100 WHEN 2 THEN 360 WHEN 4 THEN 361 END AS later FROM sessions),
k AS (SELECT agent_id, session_ts, min(project_id) AS project_id, min(file) AS file, min(m) AS m, min(later) AS later FROM a GROUP BY agent_id, session_ts),
last AS (SELECT max(greatest(m + coalesce(later, 0), m + CASE WHEN session_no % 7 = 0 THEN 30 ELSE 0 END)) AS m FROM a)
SELECT agent_id, session_ts, project_id, file, strftime(TIMESTAMP '2024-01-01' + to_minutes(k.m), '%Y-%m-%d %H:%M') AS archived_at,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(k.m + 360), '%Y-%m-%d %H:%M') AS due_at
FROM k, last WHERE (later IS NULL OR later > 360) AND k.m + 360 <= last.m - 10"""


def running_totals(spark, sf):
    """A day of events is a scan; an error event is a failed file."""
    e = fx.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("ingested")
    log = e.select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), status.alias("status"))
    return ig.running_totals(ig.batch_counts(log)).select(
        "batch_id", F.col("scan_count").cast("bigint").alias("scan_count"), "total_ingested", "total_errors")


TOTALS = """SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS scan_count, (sum(i) OVER (ORDER BY batch_id))::BIGINT AS total_ingested, (sum(e) OVER (ORDER BY batch_id))::BIGINT AS total_errors
FROM (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS i, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)"""

def stream_scan_totals(spark, sf):
    """Five scans of the events by a watcher: two with work, one that finds nothing, one that fails, and its repetition."""
    e = fx.table(spark, sf, "events")
    raw, checkpoint, scans = (work_dir(spark, name) for name in ("events", "checkpoint", "scans"))
    name = "watch-" + scans[-8:]

    def put(third):
        e.where(F.col("event_id") % 3 == third).coalesce(1).write.mode("append").parquet(raw)

    def scan(fail):
        def each(batch, batch_id):
            if fail:
                raise ValueError("no room")
            batch.count()

        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(raw).writeStream.queryName(name).option("checkpointLocation", checkpoint)
        query = stream.foreachBatch(each).trigger(availableNow=True).start()
        try:
            _finish(query)
        except StreamingQueryException:
            if not fail:
                raise
        log.wait(query)

    with pg.ScanLog(spark, scans, name) as log:
        put(0)
        put(1)
        scan(False)
        scan(False)
        put(2)
        scan(True)
        scan(False)
    return pg.scan_totals(pg.scans_of(spark, scans)).drop("query")


SCAN_TOTALS = "SELECT 5 AS scan_count, 3 AS batches, 1 AS empty_scans, 1 AS failed_scans, count(*) AS rows, 'ValueError: no room' AS last_error FROM events"

QUERIES = {
    "stream_scan_totals": (stream_scan_totals, SCAN_TOTALS),
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "stream_ingest_used_store": (stream_ingest_used_store, STREAM_USED),
    "stream_dedup": (stream_dedup, STREAM_DEDUP),
    "session_gap_close": (session_gap_close, f"WITH {_GAPS} {_CLOSED}"),
    "stream_autoclose": (stream_autoclose, STREAM_CLOSE),
    "stream_autoclose_archives": (stream_autoclose_archives, STREAM_ARCHIVES),
    "running_totals": (running_totals, TOTALS),
}
