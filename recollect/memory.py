"""The operators bound to tables below one folder: the everyday interface.

Every table is append-only Parquet; what changes over time (a session's status,
an agent's latest summary, a task's state) is a view over appended rows. One
writer at a time is assumed, as for any plain Parquet table.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.items import session_items
from recollect.operators import chunks as ck
from recollect.operators import digest as dg
from recollect.operators import search as se
from recollect.operators import sessions as ss
from recollect.operators import tasks as tk
from recollect.operators.index import VectorIndex
from recollect.operators.keyword_index import KeywordIndex
from recollect.operators.result_cache import ResultCache
from recollect.settings import DEFAULTS, Settings
from recollect.streaming import archives as ar
from recollect.streaming import ingest as ig
from recollect.streaming import progress as pg

SCHEMAS = {
    "notes": ig.STORE_SCHEMA,
    "ingest_log": ig.LOG_SCHEMA,
    "archives": "agent_id string, session_ts string, project_id string, file string, data string, seq bigint",
    "statuses": "agent_id string, session_ts string, level int",
    "summaries": "agent_id string, session_ts string, body string, latest boolean, seq bigint",
    "collapsed": "agent_id string, section int, sort_key string, line string, run bigint",
    "decisions": "project_id string, seq bigint, decision string, by_agents array<string>, reason string, recorded_at string",
    "task_events": tk.EVENT,
}
STATUS = ("archived", "summarized", "collapsed")
BY = ["agent_id", "session_ts"]


class Memory:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS,
                 clock: Callable[[], dt.datetime] = dt.datetime.now):
        self.spark, self.root, self.settings, self.clock = spark, root.rstrip("/"), settings, clock
        for name, schema in SCHEMAS.items():
            ig.create_table(spark, self.path(name), schema)

    # --- tables -----------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def _append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name])
        df.write.mode("append").parquet(self.path(name))

    def _tick(self) -> int:
        """Order of small appended rows: microseconds since the epoch."""
        return int(self.clock().timestamp() * 1_000_000)

    # --- notes ------------------------------------------------------------

    def add_notes(self, notes: DataFrame) -> None:
        """Insert notes (ord, content, tags, project_id, source, agent_id, optional trust); known contents are skipped."""
        by_hand = self.table("notes").where(F.col("writer") == ig.BY_HAND)
        batch = by_hand.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0))).first()[0]
        stamped = notes.withColumn("created_at", F.lit(self.clock().isoformat()))
        ig.insert_notes(stamped, self.path("notes"), batch)

    def add_note(self, content: str, tags: Sequence[str], project_id: str | None = None, source: str | None = None,
                 agent_id: str | None = None, trust: float | None = None) -> str:
        row = (0, content, list(tags), project_id, source, agent_id, None if trust is None else float(trust))
        df = self.spark.createDataFrame([row], "ord bigint, content string, tags array<string>, project_id string, source string, agent_id string, trust double")
        self.add_notes(df)
        return ck.identify(df).select("chunk_id").first()[0]

    def ingest(self, raw_dir: str, poll_seconds: int | None = None, archive_dir: str | None = None):
        """Take in the files of a folder; with ``poll_seconds`` keep watching. Returns the streaming query."""
        name = self._watcher(raw_dir)
        return ig.start_ingest(self.spark, raw_dir, self.path("notes"), self.path("ingest_log"), self.path(f"checkpoints/{name}"),
                               archive_dir, poll_seconds, self.settings, name=name)

    def _watcher(self, raw_dir: str) -> str:
        return "ingest-" + hashlib.md5(raw_dir.rstrip("/").encode()).hexdigest()[:16]

    def scan_log(self, *raw_dirs: str) -> pg.ScanLog:
        """While it is attached (``with``), every scan of these folders' watchers is written down, empty and failed ones too."""
        return pg.ScanLog(self.spark, self.path("scans"), *map(self._watcher, raw_dirs))

    def scan_totals(self) -> DataFrame:
        """Counters of the watchers over their whole life."""
        return pg.scan_totals(ig.read_table(self.spark, ig.create_table(self.spark, self.path("scans"), pg.SCANS), pg.SCANS))

    def keyword_search(self, query: str, **scope: Any) -> DataFrame:
        """Notes that hold a text, by the keyword index, brought up to date first."""
        index = KeywordIndex(self.spark, self.path("index/keywords"), self.settings)
        index.sync(self.table("notes"))
        return index.search(query, **scope).orderBy("seq")

    def index(self) -> VectorIndex:
        """The vector index, brought up to date first.

        Store and index are compared by id and place only: notes that the index
        lacks are embedded, and rows whose note is gone or was written anew
        elsewhere are left out. Another embedder or dimension starts it anew.
        """
        index = VectorIndex(self.spark, self.path("index/vectors"), self.settings)
        index.sync(self.table("notes"))
        return index

    def semantic_search(self, query: str, top_k: int = 5, hybrid: bool = True, **scope: Any) -> DataFrame:
        return self.index().search(query, top_k, hybrid=hybrid, **scope)

    def semantic_search_batch(self, queries: DataFrame, query_id: str, query_text: str, top_k: int = 5) -> DataFrame:
        """Many searches at once; answers are kept and used again while the index stays as it is."""
        cache = ResultCache(self.spark, self.path("results"), self.settings.semantic.cache_entries)
        return cache.search_batch(self.index(), queries, query_id, query_text, top_k)

    def related(self, chunk_id: str, top_k: int = 5) -> DataFrame:
        return se.related(self.index().rows(), chunk_id, top_k)

    def context_prompt(self, query: str, **options: Any) -> DataFrame:
        return self.index().context_prompt(query, **options)

    # --- sessions ---------------------------------------------------------

    def sessions(self) -> DataFrame:
        level = self.table("statuses").groupBy(*BY).agg(F.max("level").alias("level"))
        names = F.array(*map(F.lit, STATUS))
        return self.table("archives").join(level, BY, "left").withColumn(
            "status", F.element_at(names, F.coalesce("level", F.lit(0)) + 1)).drop("level")

    def items(self, sessions: DataFrame) -> DataFrame:
        exploded = sessions.select(*BY, F.explode(session_items("data")).alias("i"))
        return exploded.select(*BY, "i.*")

    def _with_buckets(self, sessions: DataFrame) -> DataFrame:
        rows = ss.bucket_rows(self.items(sessions), BY, self.settings.summaries)
        return ss.with_buckets(sessions, rows, BY)

    def archive_session(self, agent_id: str, session_data: Any, project_id: str | None = None) -> str:
        minute = self.clock().strftime("%Y%m%d_%H%M")
        taken = self.table("archives").where((F.col("agent_id") == agent_id) & F.col("session_ts").startswith(minute)).count()
        stamp = minute if taken == 0 else f"{minute}_{taken}"
        file = f"archived_sessions/agent_{agent_id}/session_{stamp}.json"
        self._append("archives", [(agent_id, stamp, project_id, file, json.dumps(session_data, ensure_ascii=False), self._tick())])
        return stamp

    def _close(self, due: DataFrame, latest: bool) -> None:
        """Store summaries of the given sessions and mark them."""
        told = self._with_buckets(due).select(*BY, ss.stored_summary(F.col("agent_id"), F.col("session_ts"), ss.summary_text()).alias("body"))
        self._append("summaries", told.withColumn("latest", F.lit(latest)).withColumn("seq", F.lit(self._tick())))
        self._append("statuses", due.select(*BY, F.lit(1).alias("level")))

    def summarize(self, agent_id: str, session_ts: str | None = None) -> str | None:
        """Summary of the newest open session, or of a given one (which leaves the latest summary in place)."""
        mine = self.sessions().where(F.col("agent_id") == agent_id)
        if session_ts is None:
            row = ss.latest_session(mine).select("session_ts").first()
            if row is None:
                return None
            target = row[0]
        else:
            target = session_ts
        due = mine.where(F.col("session_ts") == target)
        if due.isEmpty():
            return None
        self._close(due, latest=session_ts is None)
        return self.table("summaries").where((F.col("agent_id") == agent_id) & (F.col("session_ts") == target)).agg(F.max_by("body", "seq")).first()[0]

    def end_session(self, agent_id: str, session_data: Any, project_id: str | None = None,
                    collapse_after: bool = False, keep_last: int = 1) -> dict[str, Any]:
        """Archive, summarize, optionally collapse."""
        agent_id = (agent_id or "").strip()
        if not agent_id or not session_data or (isinstance(session_data, str) and not session_data.strip()):
            return {"status": "invalid_input", "agent_id": agent_id}
        stamp = self.archive_session(agent_id, session_data, project_id)
        summary = self.summarize(agent_id)
        done = self.collapse(agent_id, keep_last) if collapse_after else None
        return {"status": "ok", "agent_id": agent_id, "session_ts": stamp, "summary": summary, "collapsed": done}

    def collapse(self, agent_id: str, keep_last: int = 1) -> int:
        """Fold all but the newest sessions of an agent; returns how many."""
        mine = self.sessions().where(F.col("agent_id") == agent_id).withColumn("key", F.col("session_ts"))
        folded = ss.collapsible(mine, keep_last)
        n = folded.count()
        if n:
            items = self.items(mine).withColumn("key", F.col("session_ts")).drop(*BY)
            lines = ss.collapse_history(mine, items, "key", keep_last, self.settings.summaries)
            self._append("collapsed", lines.withColumn("run", F.lit(self._tick())).select("agent_id", "section", "sort_key", "line", "run"))
            self._append("statuses", folded.select(*BY, F.lit(2).alias("level")))
        return n

    def compress(self, agent_id: str, session_ts: str | None = None, max_chars: int | None = None,
                 rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
        mine = self.sessions().where(F.col("agent_id") == agent_id)
        one = ss.latest_session(mine) if session_ts is None else mine.where(F.col("session_ts") == session_ts)
        sized = self._with_buckets(one).withColumn("in_chars", F.length("data").cast("bigint"))
        return ss.compress(sized, max_chars, self.settings.compression, rewrite=rewrite)

    def auto_close(self, timeout_min: int | None = None) -> dict[str, int]:
        """Summarize all stale sessions; returns how many were checked, closed, and left as their data can't be read."""
        now = F.lit(self.clock().isoformat(sep=" ")).cast("timestamp_ntz")
        sessions = self.sessions()
        checked = sessions.where(F.col("status") == "archived").count()
        due = ss.stale(sessions, now, timeout_min or self.settings.summaries.autoclose_minutes)
        readable = due.where(session_items("data").isNotNull())
        stale, closed = due.count(), readable.count()
        if closed:
            self._close(readable, latest=False)
        return {"checked": checked, "closed": closed, "errors": stale - closed}

    def watch_sessions(self, timeout_min: int | None = None, poll_seconds: int | None = None):
        """Close archived sessions that nobody summarizes in time, from the store's own tables; returns the streaming query.

        Event time is when a row was written. With ``poll_seconds`` the query goes on, and a clock
        moves time along while nothing is written; without, it takes what is there and ends.
        """
        def stream(name: str, kind: str) -> DataFrame:
            rows = self.spark.readStream.schema(SCHEMAS[name]).parquet(self.path(name))
            optional = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("project_id", "file")]
            return rows.select(*BY, F.lit(kind).alias("kind"), F.timestamp_micros("seq").alias("at"), *optional)

        events = stream("archives", "archive").unionByName(stream("summaries", "summary"))
        if poll_seconds is not None:
            none = [F.lit(None).cast("string").alias(c) for c in ("project_id", "file")]
            ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            events = events.unionByName(ticks.select(F.lit("clock").alias("agent_id"), F.lit("").alias("session_ts"), F.lit("tick").alias("kind"), F.col("timestamp").alias("at"), *none))

        def close(due: DataFrame, batch_id: int) -> None:
            open_ = self.sessions().where(F.col("status") == "archived").join(due.select(*BY), BY, "left_semi")
            readable = open_.where(session_items("data").isNotNull())
            if not readable.isEmpty():
                self._close(readable, latest=False)

        return ar.start_autoclose(events, close, self.path("checkpoints/watch-sessions"), timeout_min or self.settings.summaries.autoclose_minutes, poll_seconds=poll_seconds)

    def _latest_summaries(self) -> DataFrame:
        """The newest regular summary of each agent, else the first one made for a named session."""
        s = self.table("summaries")
        newest = F.max_by("body", F.when(F.col("latest"), F.col("seq")))
        return s.groupBy("agent_id").agg(F.coalesce(newest, F.min_by("body", "seq")).alias("body"))

    # --- projects ---------------------------------------------------------

    def record_decision(self, project_id: str, decision: str, by_agents: Sequence[str] = (), reason: str | None = None,
                        recorded_at: str | None = None) -> None:
        stamp = recorded_at or self.clock().isoformat()
        self._append("decisions", [(project_id, self._tick(), decision, list(by_agents), reason, stamp)])

    def decisions(self, project_id: str) -> DataFrame:
        return dg.decisions_list(self.table("decisions"), project_id)

    def _digest_inputs(self) -> tuple:
        sessions = self.sessions().withColumn("key", F.concat_ws("\n", *BY))
        items = self.items(sessions).withColumn("key", F.concat_ws("\n", *BY)).drop(*BY)
        return sessions.drop("data"), items, self.table("decisions"), self.table("notes"), "key"

    def project_digest(self, project_id: str, **options: Any) -> DataFrame:
        return dg.project_digest(*self._digest_inputs(), project_id, conf=self.settings.digest, **options)

    def context(self, agent_id: str, project_id: str | None = None) -> DataFrame:
        runs = self.table("collapsed")
        last = runs.groupBy("agent_id").agg(F.max("run").alias("run"))
        folded = runs.join(last, ["agent_id", "run"]).drop("run")
        return dg.agent_context(agent_id, project_id, self._latest_summaries(), folded, *self._digest_inputs(), "seq")

    # --- tasks ------------------------------------------------------------

    def start_task(self, task_id: str, agent_id: str, project_id: str, description: str = "", model: str | None = None,
                   variant: str | None = None, tags: Sequence[str] = ()) -> None:
        """Begin a task, or begin it anew; the agent's context for the project is noted with it."""
        lines = self.context(agent_id, project_id).orderBy("block", "section", "agent_id", "rank", "part").select("line").limit(tk.PREVIEW).collect()
        context = "\n".join(r.line for r in lines)[: tk.PREVIEW]
        self._task(task_id, "start", agent_id, project_id, description, model, variant, list(tags), context)

    def end_task(self, task_id: str, agent_id: str | None = None, session_data: Any = None, project_id: str | None = None,
                 collapse_after: bool = False, keep_last: int = 1) -> bool:
        """End a known task; agent and project are the task's unless given. False, and nothing done, for an unknown one.

        With session data the session is ended as well, and the task's result names its archive and how much each bucket holds.
        """
        task = self.tasks().where(F.col("task_id") == task_id).first()
        if task is None:
            return False
        agent_id, project_id = agent_id or task.agent_id, project_id or task.project_id
        archive, stats = None, None
        if session_data:
            done = self.end_session(agent_id, session_data, project_id, collapse_after, keep_last)
            if done["status"] == "ok":
                one = self.sessions().where((F.col("agent_id") == agent_id) & (F.col("session_ts") == done["session_ts"]))
                row = self._with_buckets(one).select("file", *[F.size(b).alias(b) for b in ss.BUCKETS]).first()
                archive, stats = row.file, {b: row[b] for b in ss.BUCKETS}
        self._task(task_id, "end", agent_id, project_id, archive=archive, stats=stats)
        return True

    def cancel_task(self, task_id: str) -> bool:
        """Cancel a known task; False for an unknown one."""
        if self.tasks().where(F.col("task_id") == task_id).isEmpty():
            return False
        self._task(task_id, "cancel")
        return True

    def clear_tasks(self) -> int:
        """Forget all tasks and agents; returns how many tasks there were."""
        n = self.tasks().count()
        self._task(None, "clear")
        return n

    def _task(self, task_id, action, agent_id=None, project_id=None, description=None, model=None, variant=None, tags=None, context=None, archive=None, stats=None) -> None:
        tick = self._tick()
        self._append("task_events", [(task_id, agent_id, project_id, tick, self.clock().isoformat(), action, description, model, variant, tags, context, archive, stats)])

    def tasks(self, **filters: Any) -> DataFrame:
        return tk.filter_tasks(tk.task_log(self.table("task_events")), **filters)

    def task_statistics(self) -> DataFrame:
        return tk.task_statistics(self.table("task_events"))

    def status(self) -> DataFrame:
        return tk.store_status(self.table("notes"), self.sessions().withColumn("session_no", F.col("seq")))
