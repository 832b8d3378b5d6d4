"""Registered queries: sessions, digest, context and tasks (G, P6-P9)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from recollect.functions.rewriting import rewriter
from recollect.operators import chunks as ck
from recollect.operators import digest as dg
from recollect.operators import sessions as ss
from recollect.operators import tasks as tk
from recollect.plans import fixtures as fx
from recollect.plans import oracle as o

BY = "session_no"
WIDE = 10
PROJECT = "proj_1"
AGENT = "agent_2"
NOW = "2024-01-01 22:00:00"
SINCE = "20240101_0130"
_NL = "chr(10)"


def session_archive(spark, sf):
    """Every event archived as a session of its user, so minutes clash."""
    e = fx.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("agent_"), (F.col("user_id") % 3).cast("string")).alias("agent_id"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyyMMdd_HHmm").alias("minute"))
    return ss.archive_stamps(e, "event_id", "minute", block_rows=1000).select("event_id", "agent_id", "session_ts")


ARCHIVE = """SELECT event_id, agent_id, m || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS session_ts FROM (
  SELECT event_id, 'agent_' || (user_id % 3) AS agent_id, strftime(date_trunc('hour', ts), '%Y%m%d_%H%M') AS m,
    row_number() OVER (PARTITION BY user_id % 3, date_trunc('hour', ts) ORDER BY event_id) - 1 AS n FROM events)"""


def _rows(spark, sf, width):
    return ss.bucket_rows(fx.session_items(spark, sf, width), [BY])


def _full(spark, sf, width):
    return ss.with_buckets(fx.sessions(spark, sf, width), _rows(spark, sf, width), [BY])


_WIDE = f"{o.sessions(WIDE)}, {o.items(WIDE)}, {o.buckets()}"
_SQL = f"{o.sessions()}, {o.items()}, {o.buckets()}"


def extract_buckets(spark, sf):
    return _rows(spark, sf, WIDE).select(BY, "bucket", "pos", "text")


def bucket_stats(spark, sf):
    return ss.bucket_stats(_rows(spark, sf, WIDE), [BY])


BUCKET_STATS = f"WITH {_WIDE} SELECT session_no, " + ", ".join(
    f"count(*) FILTER (bucket = '{b}') AS {b}" for b in o.BUCKET_NAMES) + " FROM rows GROUP BY 1"


def session_summary(spark, sf):
    return _full(spark, sf, WIDE).select(BY, ss.summary_text().alias("summary"))


def latest_session(spark, sf):
    return ss.latest_session(fx.sessions(spark, sf)).select("agent_id", BY, "session_ts", "file", "status")


def list_archives(spark, sf):
    return fx.sessions(spark, sf).select("agent_id", "session_ts", "file", "status").orderBy("agent_id", "session_ts")


def collapse_history(spark, sf):
    return ss.collapse_history(fx.sessions(spark, sf), fx.session_items(spark, sf), BY, keep_last=2)


_FOLDED = """usable AS (SELECT * FROM sessions WHERE status <> 'collapsed'),
folded AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY session_ts DESC) > 2)"""
_COUNTS = ", ".join(f"CASE WHEN count(*) FILTER (bucket = '{b}') > 0 THEN '{b}=' || count(*) FILTER (bucket = '{b}') END" for b in o.BUCKET_NAMES)
COLLAPSE = f"""WITH {_SQL}, {_FOLDED},
facts AS (SELECT session_no, max(text) FILTER (bucket = 'done' AND pos = 1) AS fd, concat_ws(', ', {_COUNTS}) AS counts FROM rows GROUP BY 1),
tot AS (SELECT agent_id, count(*) AS n, min(session_ts) AS a, max(session_ts) AS b FROM folded GROUP BY 1),
seen AS (SELECT agent_id, bucket, text, min(session_ts || lpad(pos::VARCHAR, 4, '0')) AS first_at FROM rows JOIN folded USING (session_no) WHERE bucket IN ('decisions', 'next') GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY agent_id, bucket ORDER BY first_at) AS rn FROM seen)
SELECT agent_id, 0 AS section, '0' AS sort_key, '# Свернутое резюме истории сессий (' || agent_id || ')' AS line FROM tot
UNION ALL SELECT agent_id, 0, '1', '**Сессии:** ' || a || ' … ' || b || ' · **Свернуто:** ' || n FROM tot
UNION ALL SELECT agent_id, 0, '2', '**Сгенерировано:** SessionSummarizer.collapse_history (эвристика).' FROM tot
UNION ALL SELECT agent_id, 1, '', {_NL} || '## Сессии (по одной строке)' FROM tot
UNION ALL SELECT agent_id, 1, session_ts, '- **' || session_ts || '** — ' || coalesce(fd, '—') || CASE WHEN counts <> '' THEN ' · (' || counts || ')' ELSE '' END FROM folded LEFT JOIN facts USING (session_no)
UNION ALL SELECT agent_id, 2, '', {_NL} || '## Решения (агрегировано: ' || (SELECT count(*) FROM seen s WHERE s.agent_id = tot.agent_id AND bucket = 'decisions') || ')' FROM tot
UNION ALL SELECT agent_id, 3, '', {_NL} || '## Дальше (агрегировано: ' || (SELECT count(*) FROM seen s WHERE s.agent_id = tot.agent_id AND bucket = 'next') || ')' FROM tot
UNION ALL SELECT agent_id, CASE bucket WHEN 'decisions' THEN 2 ELSE 3 END, lpad(rn::VARCHAR, 4, '0'), '- ' || text FROM nth WHERE rn <= 10"""


def collapse_report(spark, sf):
    return ss.collapse_report(fx.sessions(spark, sf), keep_last=2)


COLLAPSE_REPORT = f"""WITH {o.sessions()}, {_FOLDED} SELECT u.agent_id, CASE WHEN max(f.n) IS NULL THEN 'nothing_to_collapse' ELSE 'ok' END AS status,
  count(*) AS archives, coalesce(max(f.n), 0) AS collapsed, max(f.a) AS first_ts, max(f.b) AS last_ts
FROM usable u LEFT JOIN (SELECT agent_id, count(*) AS n, min(session_ts) AS a, max(session_ts) AS b FROM folded GROUP BY 1) f USING (agent_id) GROUP BY 1"""


def _json_size(items):
    """Length of a session's JSON text, added up without building it."""
    escaped = lambda c: F.length(F.to_json(F.struct(F.col(c).alias("c")))) - 6
    per_item = escaped("role") + escaped("text") + len('{"role": , "content": }')
    per_key = items.groupBy(BY, "raw_key").agg((F.sum(per_item) + 2 * (F.count("*") - 1)).alias("n"))
    key = F.length("raw_key") + len('"": []')
    return per_key.groupBy(BY).agg((F.sum(F.col("n") + key) + 2 * (F.count("*") - 1) + 2).alias("in_chars"))


def compress_session(spark, sf):
    full = _full(spark, sf, WIDE).join(_json_size(fx.session_items(spark, sf, WIDE)), BY, "left")
    return ss.compress(full).select(BY, "markdown", "in_chars", "out_chars", "ratio")


def compress_tight(spark, sf):
    """A budget that forces every step of shrinking."""
    full = _full(spark, sf, WIDE).join(_json_size(fx.session_items(spark, sf, WIDE)), BY, "left")
    budget = F.col(BY) % 2
    tight = ss.compress(full.where(budget == 0), 6200).unionByName(ss.compress(full.where(budget == 1), 4500))
    return tight.select(BY, "markdown", "in_chars", "out_chars", "ratio")


def _compact_sql(level_sections):
    head = "'# Сжатая сессия (' || agent_id || ')' || chr(10) || '**Время:** ' || session_ts || ' · **Уровень сжатия:** 1'"
    return o.document(head, level_sections, "Сессия не содержит структурированных данных.")


def _compress_sql(limit):
    caps = (("Сделано", "done_l", 8), ("Решения", "decisions_l", 6), ("Дальше", "next_l", 6), ("Прочее", "other_l", 4))
    capped = [(t, f"{c}[1:{n}]") for t, c, n in caps]
    short = [(t, f"list_transform({c}, lambda x: {o.truncate('x', 180)})") for t, c in capped]
    return f"""WITH {_WIDE}, {o.arrays()},
size AS (SELECT session_no, sum(n + length(raw_key) + 6) + 2 * (count(*) - 1) + 2 AS in_chars FROM (
  SELECT session_no, raw_key, sum(length(to_json(role)::VARCHAR) + length(to_json(text)::VARCHAR) + 23) + 2 * (count(*) - 1) AS n FROM items GROUP BY ALL) GROUP BY 1),
docs AS (SELECT *, {_compact_sql(capped + [('Диалог', 'dialog_l[1:6]')])} AS a, {_compact_sql(capped)} AS b, {_compact_sql(short)} AS c, {limit} AS lim FROM full_),
fit AS (SELECT session_no, CASE WHEN length(a) <= lim THEN a WHEN length(b) <= lim THEN b ELSE {o.cut('c', 'lim', 'lim - 1')} END AS markdown FROM docs)
SELECT session_no, markdown, in_chars::BIGINT AS in_chars, length(markdown)::BIGINT AS out_chars,
  ((in_chars * 20 + length(markdown)) // (2 * length(markdown))) / 10.0::DOUBLE AS ratio FROM fit JOIN size USING (session_no)"""


def _digest_of(prompts):
    """Stands in for a model: the prompt's digest, with a failure on some."""
    out = []
    for prompt in prompts:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        if digest[0] in "0123":
            raise ValueError(digest[:6])
        out.append(digest.upper())
    return out


def compress_rewritten(spark, sf):
    """Level 2 by a rewriter that fails on some sessions, which stay at level 1."""
    full = _full(spark, sf, WIDE).withColumn("in_chars", F.lit(0).cast("bigint"))
    done = ss.compress(full, 100_000, rewriter=rewriter(_digest_of, 4))
    return done.select(BY, "level", "llm", "llm_status", "llm_error", "markdown")


def _rewritten_sql():
    caps = (("Сделано", "done_l[1:8]"), ("Решения", "decisions_l[1:6]"), ("Дальше", "next_l[1:6]"), ("Прочее", "other_l[1:4]"))
    parts = " || ".join(f"CASE WHEN len({c}) > 0 THEN chr(10) || chr(10) || '{t}: ' || array_to_string({c}, '; ') ELSE '' END" for t, c in caps)
    intro = " || chr(10) || ".join("'" + line + "'" for line in "\n".join(ss.PROMPT_INTRO).split("\n"))
    return f"""WITH {_WIDE}, {o.arrays()}, p AS (SELECT *, md5({intro} || {parts}) AS d FROM full_),
l AS (SELECT *, CASE WHEN d[1] IN ('0', '1', '2', '3') THEN 1 ELSE 2 END AS lv FROM p)
SELECT session_no, lv AS level, CASE WHEN lv = 2 THEN upper(d) END AS llm, CASE WHEN lv = 2 THEN 'ok' ELSE 'error' END AS llm_status,
  CASE WHEN lv = 1 THEN 'ValueError: ' || d[1:6] END AS llm_error, replace({_compact_sql([*caps, ('Диалог', 'dialog_l[1:6]')])}, 'сжатия:** 1', 'сжатия:** ' || lv) AS markdown FROM l"""


def end_session(spark, sf):
    """The end-of-session composition: stamp, summary, counts for every session."""
    s = fx.sessions(spark, sf, WIDE).drop("session_ts", "status").withColumn("minute", F.lit("20240301_1200"))
    stamped = ss.archive_stamps(s, BY, "minute").withColumn("status", F.lit("archived"))
    full = ss.with_buckets(stamped, _rows(spark, sf, WIDE), [BY])
    body = ss.stored_summary(F.col("agent_id"), F.col("session_ts"), ss.summary_text())
    return full.select(BY, "agent_id", "session_ts", F.lit("summarized").alias("status"), body.alias("summary"),
                       *[F.size(b).cast("bigint").alias(b) for b in ss.BUCKETS])


END_SESSION = f"""WITH {_WIDE.replace('sessions AS', 'sessions0 AS', 1)},
sessions AS (SELECT session_no, agent_id, file, '20240301_1200' || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS session_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY session_no) - 1 AS n FROM sessions0)), {o.arrays()}
SELECT session_no, agent_id, session_ts, 'summarized' AS status, '# Session Summary for Agent: ' || agent_id || {_NL} || {_NL} || '**Timestamp:** ' || session_ts || {_NL} || {_NL} || {o.SUMMARY} AS summary,
  len(done_l)::BIGINT AS done, len(decisions_l)::BIGINT AS decisions, len(next_l)::BIGINT AS next, len(dialog_l)::BIGINT AS dialog, len(other_l)::BIGINT AS other FROM full_"""


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def stale_sessions(spark, sf):
    """The archive with some unreadable stamps, which count as stale."""
    s = fx.sessions(spark, sf)
    stamp = F.when(F.col(BY) % 7 == 0, F.lit("lost")).otherwise(F.col("session_ts"))
    return ss.stale(s.withColumn("session_ts", stamp), _now(), 960).select(BY, "agent_id", "session_ts")


_STALE = f"strptime(session_ts, '%Y%m%d_%H%M') < TIMESTAMP '{NOW}' - INTERVAL 960 MINUTE"
STALE = f"""WITH {o.sessions()} SELECT session_no, agent_id, CASE WHEN session_no % 7 = 0 THEN 'lost' ELSE session_ts END AS session_ts
FROM sessions WHERE status = 'archived' AND (session_no % 7 = 0 OR {_STALE})"""


def autoclose_report(spark, sf):
    closed = ss.autoclose(fx.sessions(spark, sf), fx.session_items(spark, sf), BY, _now(), 960)
    return closed.select("agent_id", "session_ts", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


AUTOCLOSE = f"""WITH {_SQL}, due AS (SELECT * FROM sessions WHERE status = 'archived' AND {_STALE}), {o.arrays('due')}
SELECT agent_id, session_ts, md5({o.SUMMARY}) AS summary_md5 FROM full_"""


# --- digest -------------------------------------------------------------------

def digest_sessions(spark, sf):
    picked = dg.digest_sessions(fx.sessions(spark, sf), PROJECT, SINCE)
    told = dg.with_bucket_lines(picked, fx.session_items(spark, sf), BY)
    return told.select("agent_id", F.col("rank").cast("bigint").alias("rank"), "session_ts", "done", "decisions", "next", "other")


def _picked_sql(project=PROJECT, since=SINCE, extra=""):
    bound = f"AND session_ts >= '{since}'" if since else ""
    return f"""picked AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY session_ts DESC) AS rank FROM sessions
  WHERE project_id = '{project}' AND status <> 'collapsed' {bound} {extra} QUALIFY rank <= 6),
told AS (SELECT p.*, """ + ", ".join(
        f"coalesce((SELECT string_agg(text, '; ' ORDER BY pos) FROM rows r WHERE r.session_no = p.session_no AND bucket = '{b}' AND pos <= 4), '') AS {b}"
        for b in ("done", "decisions", "next", "other")) + " FROM picked p)"


DIGEST_SESSIONS = f"WITH {_SQL}, {_picked_sql()} SELECT agent_id, rank, session_ts, done, decisions, next, other FROM told"


def digest_agent_filter(spark, sf):
    """Everyone but one agent, and one agent alone."""
    s = fx.sessions(spark, sf)
    others = dg.digest_sessions(s, PROJECT, exclude_agent=AGENT).select(F.lit("others").alias("view"), "agent_id", "session_ts")
    alone = dg.digest_sessions(s, PROJECT, only_agent=AGENT).select(F.lit("alone").alias("view"), "agent_id", "session_ts")
    return others.unionAll(alone)


AGENT_FILTER = f"""WITH {o.sessions()}, p AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY session_ts DESC) AS rank FROM sessions
  WHERE project_id = '{PROJECT}' AND status <> 'collapsed' QUALIFY rank <= 6)
SELECT CASE agent_id WHEN '{AGENT}' THEN 'alone' ELSE 'others' END AS view, agent_id, session_ts FROM p"""


def digest_decisions(spark, sf):
    return dg.digest_decisions(fx.decisions(spark, sf), PROJECT, "2024-01-05").select("seq", "decision", "recorded_at")


_CHOSEN = """chosen AS (SELECT *, row_number() OVER (ORDER BY recorded_at DESC, seq) AS rank FROM decisions
  WHERE project_id = '{project}' {bound} QUALIFY rank <= 8)"""


def _chosen(project, bound=""):
    return _CHOSEN.format(project=project, bound=f"AND recorded_at >= '{bound}'" if bound else "")


def _project_notes(spark, sf):
    """Notes whose project is named as the sessions' projects are."""
    name = F.concat(F.lit("proj_"), F.regexp_extract("project_id", r"\d+", 0))
    chunks = ck.deduplicate(fx.notes(spark, sf))
    return chunks.withColumn("project_id", F.when(F.col("project_id").isNotNull(), name))


def digest_chunks(spark, sf):
    return dg.digest_chunks(_project_notes(spark, sf), PROJECT, "2024-01-01 05:00:00").select("seq", "id", "created_at", "agent_id", "preview")


_NAMED = f"{o.CHUNKS}, named AS (SELECT * REPLACE (CASE WHEN project_id IS NOT NULL THEN 'proj_' || regexp_extract(project_id, '\\d+') END AS project_id) FROM chunks)"


def _notes_sql(project, bound=""):
    limit = f"AND created_at >= '{bound}'" if bound else ""
    flat = o.one_line("content")
    return f"""fresh AS (SELECT seq, substr(chunk_id, 1, 8) AS id, created_at, agent_id, substr(flat, 1, 140) || CASE WHEN length(flat) > 140 THEN '…' ELSE '' END AS preview,
  row_number() OVER (ORDER BY created_at DESC, seq) AS rank FROM (SELECT *, {flat} AS flat FROM named WHERE project_id = '{project}' {limit}) WHERE flat <> '' QUALIFY rank <= 8)"""


def digest_stats(spark, sf):
    return dg.digest_stats(
        dg.digest_sessions(fx.sessions(spark, sf), PROJECT), dg.digest_decisions(fx.decisions(spark, sf), PROJECT),
        dg.digest_chunks(_project_notes(spark, sf), PROJECT))



def _digest_ctes(project):
    return f"{_SQL}, {_picked_sql(project, None)}, {o.DECISIONS}, {_chosen(project)}, {_NAMED}, {_notes_sql(project)}"


_STATS = "stats AS (SELECT (SELECT count(DISTINCT agent_id) FROM picked) AS agents, (SELECT count(*) FROM picked) AS sessions, (SELECT count(*) FROM chosen) AS decisions, (SELECT count(*) FROM fresh) AS chunks)"


def _digest_lines(project):
    labels = (("done", "Сделано", 1), ("decisions", "Решения", 2), ("next", "Дальше", 3), ("other", "Прочее", 4))
    parts = "".join(f"\nUNION ALL SELECT 1, agent_id, rank, {i}, '    - {t}: ' || {b} FROM told WHERE {b} <> ''" for b, t, i in labels)
    return f"""SELECT 0 AS section, '' AS agent_id, 0 AS rank, 0 AS part, '# Проектный дайджест: {project}' AS line FROM stats WHERE sessions + decisions + chunks > 0
UNION ALL SELECT 0, '', 0, 1, '**Сессий:** ' || sessions || ' · **Агентов:** ' || agents || ' · **Решений:** ' || decisions || ' · **Заметок:** ' || chunks FROM stats WHERE sessions + decisions + chunks > 0
UNION ALL SELECT 0, '', 0, 2, '**Сгенерировано:** ProjectDigest (эвристика, без LLM).' FROM stats WHERE sessions + decisions + chunks > 0
UNION ALL SELECT 0, '', 0, 0, 'Нет данных по проекту `{project}`: нет сессий/решений/заметок за указанный период.' FROM stats WHERE sessions + decisions + chunks = 0
UNION ALL SELECT 1, '', 0, 0, {_NL} || '## Сессии по агентам' FROM stats WHERE sessions > 0
UNION ALL SELECT 2, '', 0, 0, {_NL} || '## Совместные решения (' || decisions || ')' FROM stats WHERE decisions > 0
UNION ALL SELECT 3, '', 0, 0, {_NL} || '## Свежие заметки проекта (' || chunks || ')' FROM stats WHERE chunks > 0
UNION ALL SELECT 1, agent_id, 0, 0, {_NL} || '### ' || agent_id || ' (сессий: ' || count(*) || ')' FROM picked GROUP BY agent_id
UNION ALL SELECT 1, agent_id, rank, 0, '- **' || session_ts || '**' FROM told{parts}
UNION ALL SELECT 2, '', rank, 0, '- ' || substr(recorded_at, 1, 10) || ' **' || decision || '** — агенты: ' || array_to_string(by_agents, ', ') FROM chosen
UNION ALL SELECT 2, '', rank, 1, '    - Причина: ' || reason FROM chosen
UNION ALL SELECT 3, '', rank, 0, '- ' || substr(created_at, 1, 10) || ' (' || agent_id || '): ' || preview FROM fresh"""


def project_digest(spark, sf):
    return dg.project_digest(fx.sessions(spark, sf), fx.session_items(spark, sf), fx.decisions(spark, sf), _project_notes(spark, sf), BY, PROJECT)


def project_digest_empty(spark, sf):
    """A project nobody worked on yields the notice."""
    return dg.project_digest(fx.sessions(spark, sf), fx.session_items(spark, sf), fx.decisions(spark, sf), _project_notes(spark, sf), BY, "nowhere")


def agent_context(spark, sf):
    """Block 0 from stored summaries of the agents' newest summarized sessions."""
    sessions, items = fx.sessions(spark, sf), fx.session_items(spark, sf)
    done = sessions.where(F.col("status") == "summarized")
    newest = ss.latest_session(done)
    rows = ss.bucket_rows(items.join(newest.select(BY), BY, "left_semi"), [BY])
    stored = ss.with_buckets(newest, rows, [BY])
    summaries = stored.select("agent_id", ss.stored_summary(F.col("agent_id"), F.col("session_ts"), ss.summary_text()).alias("body"))
    collapsed = ss.collapse_history(sessions, items, BY, 2)
    return dg.agent_context(AGENT, PROJECT, summaries, collapsed, sessions, items, fx.decisions(spark, sf), _project_notes(spark, sf), BY, BY)


def _context_sql():
    last = "(SELECT max_by(session_ts, session_no) FROM sessions WHERE agent_id = '%s')" % AGENT
    iso = f"strftime(strptime({last}, '%Y%m%d_%H%M'), '%Y-%m-%dT%H:%M:%S')"
    picked = _picked_sql(since=None, extra=f"AND session_ts >= {last}")
    return f"""WITH {_SQL}, {picked}, {o.DECISIONS}, {_CHOSEN.format(project=PROJECT, bound=f"AND recorded_at >= {iso}")}, {_NAMED},
{_notes_sql(PROJECT).replace(f"project_id = '{PROJECT}' ", f"project_id = '{PROJECT}' AND created_at >= {iso} ")}, {_STATS},
newest AS (SELECT * FROM sessions WHERE agent_id = '{AGENT}' AND status = 'summarized' ORDER BY session_ts DESC LIMIT 1), {o.arrays('newest')},
blocks AS (SELECT 0 AS block, 0 AS section, '' AS agent_id, -1 AS rank, 0 AS part, '# Session Summary for Agent: ' || agent_id || {_NL} || {_NL} || '**Timestamp:** ' || session_ts || {_NL} || {_NL} || {o.SUMMARY} AS line FROM full_
  UNION ALL SELECT DISTINCT 1, 0, '', -1, 0, '## Shared Project Knowledge ({PROJECT})' FROM decisions WHERE project_id = '{PROJECT}'
  UNION ALL SELECT 1, 0, '', seq, 0, '- **Decision:** ' || decision FROM decisions WHERE project_id = '{PROJECT}'
  UNION ALL SELECT 1, 0, '', seq, 1, '  - **By Agents:** ' || array_to_string(by_agents, ', ') FROM decisions WHERE project_id = '{PROJECT}'
  UNION ALL SELECT 1, 0, '', seq, 2, '  - **Reason:** ' || reason || {_NL} FROM decisions WHERE project_id = '{PROJECT}'
  UNION ALL SELECT 2, * FROM ({_digest_lines(PROJECT)}))
SELECT * FROM blocks UNION ALL SELECT DISTINCT block, -1, '', CASE block WHEN 1 THEN -1 ELSE 0 END, 0, '---' FROM blocks WHERE block > (SELECT min(block) FROM blocks)"""


# --- tasks --------------------------------------------------------------------

def _tasks(spark, sf):
    return tk.task_status(fx.task_events(spark, sf))


def task_status(spark, sf):
    return _tasks(spark, sf)


def task_log(spark, sf):
    """Every field of each task after the log was cleared."""
    log = tk.task_log(fx.task_log_events(spark, sf))
    return log.select(
        "task_id", "agent_id", "project_id", "description", "model", "variant", F.array_join("tags", ",").alias("tags"), "status", "started_at", "ended_at",
        F.col("result.archive").alias("archive"), F.col("result.stats")["done"].alias("done"), F.col("result.stats")["next"].alias("next"), "context_loaded", "context_preview")


def task_statistics(spark, sf):
    return tk.task_statistics(fx.task_log_events(spark, sf))


_LOG_COUNTS = "count(*) AS total_tasks, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("running", "completed", "cancelled"))
TASK_STATISTICS = f"""WITH {o.TASK_LOG}, starts AS (SELECT * FROM after WHERE action = 'start'),
last AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY seq DESC) = 1)
SELECT 'total' AS level, NULL AS name, {_LOG_COUNTS}, (SELECT count(DISTINCT agent_id) FROM starts) AS agents, count(DISTINCT project_id) AS projects, NULL AS last_task, NULL AS last_project FROM log
UNION ALL SELECT 'project', project_id, {_LOG_COUNTS}, count(DISTINCT agent_id), NULL, NULL, NULL FROM log GROUP BY project_id
UNION ALL SELECT 'agent', l.agent_id, count(g.task_id), {", ".join(f"count(*) FILTER (status = '{s}')" for s in ("running", "completed", "cancelled"))}, NULL, NULL, l.task_id, l.project_id
  FROM last l LEFT JOIN log g ON g.agent_id = l.agent_id GROUP BY l.agent_id, l.task_id, l.project_id"""


def tasks_filtered(spark, sf):
    return tk.filter_tasks(_tasks(spark, sf), "agent_3", "proj_5", "running").select("task_id", "description", "started_at")


def task_stats(spark, sf):
    return tk.task_stats(_tasks(spark, sf))


def agent_stats(spark, sf):
    return tk.agent_stats(_tasks(spark, sf), fx.task_events(spark, sf))


def project_stats(spark, sf):
    return tk.project_stats(_tasks(spark, sf))


def project_agents(spark, sf):
    return tk.project_agents(_tasks(spark, sf))


_TASK_COUNTS = "count(*) AS total_tasks, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("running", "completed", "cancelled"))
AGENT_STATS = f"""WITH {o.TASKS}, l AS (SELECT agent_id, max_by(task_id, seq) AS last_task, max_by(project_id, seq) AS last_project FROM tev WHERE action = 'start' GROUP BY 1),
c AS (SELECT agent_id, {_TASK_COUNTS} FROM tasks GROUP BY 1)
SELECT l.agent_id, total_tasks, running, completed, cancelled, last_task, last_project FROM l LEFT JOIN c USING (agent_id)"""


def store_status(spark, sf):
    return tk.store_status(ck.deduplicate(fx.notes(spark, sf), ["project_id", "agent_id"]), fx.sessions(spark, sf))


STATUS = f"""WITH {o.CHUNKS}, {o.sessions()}
SELECT 'project' AS kind, coalesce(project_id, 'general') AS name, count(*) AS n, NULL::BIGINT AS summarized, NULL AS last_ts FROM chunks GROUP BY 2
UNION ALL SELECT 'author', agent_id, count(*), NULL, NULL FROM chunks GROUP BY 2
UNION ALL SELECT 'sessions', agent_id, count(*), count(*) FILTER (status = 'summarized'), max_by(session_ts, session_no) FROM sessions GROUP BY 2"""


def decisions_list(spark, sf):
    return dg.decisions_list(fx.decisions(spark, sf), PROJECT, block_rows=1000)


QUERIES = {
    "session_archive": (session_archive, ARCHIVE),
    "extract_buckets": (extract_buckets, f"WITH {_WIDE} SELECT session_no, bucket, pos, text FROM rows"),
    "bucket_stats": (bucket_stats, BUCKET_STATS),
    "session_summary": (session_summary, f"WITH {_WIDE}, {o.arrays()} SELECT session_no, {o.SUMMARY} AS summary FROM full_"),
    "latest_session": (latest_session, f"WITH {o.sessions()} SELECT agent_id, session_no, session_ts, file, status FROM sessions WHERE status <> 'collapsed' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY session_ts DESC) = 1"),
    "list_archives": (list_archives, f"WITH {o.sessions()} SELECT agent_id, session_ts, file, status FROM sessions ORDER BY 1, 2"),
    "collapse_history": (collapse_history, COLLAPSE),
    "collapse_report": (collapse_report, COLLAPSE_REPORT),
    "compress_session": (compress_session, _compress_sql("2400")),
    "compress_rewritten": (compress_rewritten, _rewritten_sql()),
    "compress_tight": (compress_tight, _compress_sql("CASE WHEN session_no % 2 = 0 THEN 6200 ELSE 4500 END")),
    "end_session": (end_session, END_SESSION),
    "stale_sessions": (stale_sessions, STALE),
    "autoclose_report": (autoclose_report, AUTOCLOSE),
    "digest_sessions": (digest_sessions, DIGEST_SESSIONS),
    "digest_agent_filter": (digest_agent_filter, AGENT_FILTER),
    "digest_decisions": (digest_decisions, f"WITH {o.DECISIONS}, {_chosen(PROJECT, '2024-01-05T00:00:00')} SELECT seq, decision, recorded_at FROM chosen"),
    "digest_chunks": (digest_chunks, f"WITH {_NAMED}, {_notes_sql(PROJECT, '2024-01-01T05:00:00')} SELECT seq, id, created_at, agent_id, preview FROM fresh"),
    "digest_stats": (digest_stats, f"WITH {_digest_ctes(PROJECT)}, {_STATS} SELECT * FROM stats"),
    "project_digest": (project_digest, f"WITH {_digest_ctes(PROJECT)}, {_STATS} {_digest_lines(PROJECT)}"),
    "project_digest_empty": (project_digest_empty, f"WITH {_digest_ctes('nowhere')}, {_STATS} {_digest_lines('nowhere')}"),
    "agent_context": (agent_context, _context_sql()),
    "task_log": (task_log, f"WITH {o.TASK_LOG} SELECT * FROM log"),
    "task_statistics": (task_statistics, TASK_STATISTICS),
    "task_status": (task_status, f"WITH {o.TASKS} SELECT * FROM tasks"),
    "tasks_filtered": (tasks_filtered, f"WITH {o.TASKS} SELECT task_id, description, started_at FROM tasks WHERE agent_id = 'agent_3' AND project_id = 'proj_5' AND status = 'running'"),
    "task_stats": (task_stats, f"WITH {o.TASKS} SELECT {_TASK_COUNTS}, count(DISTINCT agent_id) AS agents, count(DISTINCT project_id) AS projects FROM tasks"),
    "agent_stats": (agent_stats, AGENT_STATS),
    "project_stats": (project_stats, f"WITH {o.TASKS} SELECT project_id, count(*) AS total_tasks, count(DISTINCT agent_id) AS agents FROM tasks GROUP BY 1"),
    "project_agents": (project_agents, f"WITH {o.TASKS} SELECT DISTINCT project_id, agent_id FROM tasks"),
    "store_status": (store_status, STATUS),
    "decisions_list": (decisions_list, f"WITH {o.DECISIONS} SELECT row_number() OVER (ORDER BY seq) AS n, decision, array_to_string(by_agents, ', ') AS by_agents, reason FROM decisions WHERE project_id = '{PROJECT}'"),
}
