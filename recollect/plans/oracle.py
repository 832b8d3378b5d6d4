"""SQL fragments shared by the oracle queries: the fixtures of
:mod:`recollect.plans.fixtures` and independent forms of the core operators."""

from __future__ import annotations

NOTES = """notes AS (
  SELECT doc_id AS seq, text AS content, md5(text) AS chunk_id,
    ['#doc', '#source:text', '#lang_' || lang] AS tags,
    CASE WHEN doc_id % 3 <> 0 THEN source END AS project_id,
    'agent_' || (doc_id % 5) AS agent_id,
    CASE doc_id % 4 WHEN 0 THEN 'https://docs.python.org/3/' || doc_id
      WHEN 1 THEN 'https://blog.example/' || doc_id
      WHEN 2 THEN 'notes/' || doc_id || '.md' END AS source,
    CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.8 ELSE 0.5 END AS trust,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM documents)"""

CHUNKS = NOTES + """, chunks AS (
  SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq) = 1)"""


def blanks(expr: str) -> str:
    """Trim of ASCII white space."""
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def cut(expr: str, limit: str | int, keep: str | int) -> str:
    """First ``keep`` characters without trailing white space, plus an ellipsis, when longer than ``limit``."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"CASE WHEN length({expr}) > {limit} THEN rtrim(substr({expr}, 1, {keep}), {ws}) || '…' ELSE {expr} END"


def one_line(expr: str) -> str:
    return blanks(f"regexp_replace({expr}, '\\s+', ' ', 'g')")


def truncate(expr: str, limit: int) -> str:
    flat = one_line(expr)
    return (f"CASE WHEN length({flat}) <= {limit} THEN {flat} "
            f"ELSE rtrim(substr({flat}, 1, {limit - 1})) || '…' END")


def rendered(c: str = "") -> str:
    """Stored form of a chunk row."""
    return (f"'---' || chr(10) || 'tags: [\"' || array_to_string({c}tags, '\", \"') || '\"]' || chr(10)"
            f" || coalesce('project_id: ' || {c}project_id || chr(10), '')"
            f" || coalesce('source: ' || {c}source || chr(10), '')"
            f" || 'agent_id: ' || {c}agent_id || chr(10) || 'trust: ' || {c}trust || chr(10)"
            f" || 'created_at: ' || {c}created_at || chr(10) || '---' || chr(10) || chr(10) || {c}content")


def weights(source: str, key: str, content: str, out: str, digits: int | None = 6) -> str:
    """CTEs ending in ``out(key, idx, w)``: hashed, damped, normalized features."""
    w = f"v / sqrt(sum(v * v) OVER (PARTITION BY {key}))"
    w = w if digits is None else f"round({w}, {digits})"
    return f"""{out}_t AS (SELECT {key}, regexp_extract_all(lower({content}), '[а-яёa-z0-9]+') AS t FROM {source}),
{out}_f AS (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS f FROM {out}_t),
{out}_c AS (SELECT {key}, f, count(*) AS tf FROM {out}_f GROUP BY ALL),
{out}_s AS (SELECT {key}, ('0x' || substr(md5(f), 1, 8))::BIGINT % 512 AS idx,
  sum(CASE WHEN ('0x' || substr(md5(f), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(tf))) AS v
  FROM {out}_c GROUP BY ALL),
{out} AS (SELECT {key}, idx::INTEGER AS idx, {w} AS w FROM {out}_s WHERE v <> 0)"""


def round4(x: str) -> str:
    """Rounding of a non-negative column by its exact value, in IEEE operations; see recollect.functions.numbers."""
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    twice, low = f"({x} * 20000.0::DOUBLE)", f"floor({x} * 20000.0::DOUBLE / 2.0::DOUBLE)"
    side = f"(({twice} - ({low} * 2.0::DOUBLE + 1.0::DOUBLE)) + (({high} * 20000.0::DOUBLE - {twice}) + ({x} - {high}) * 20000.0::DOUBLE))"
    return f"(({low} + CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 ELSE {low} % 2 END) / 10000.0::DOUBLE)"


def ranking(query: str, top_k: int, hybrid: bool = True, weight: str = "0.25", where: str = "true") -> str:
    """CTEs ending in ``hits``: the ranked chunks of one query."""
    head = 4 * top_k if hybrid else 0
    return f"""{CHUNKS}, {weights('chunks', 'chunk_id', 'content', 'w')},
q AS (SELECT 0 AS qid, '{query}' AS qtext), {weights('q', 'qid', 'qtext', 'qw', None)},
cos AS (SELECT chunk_id, sum(w.w * qw.w) AS c FROM w JOIN qw USING (idx) GROUP BY chunk_id HAVING sum(w.w * qw.w) > 0),
scored AS (SELECT k.*, {round4('c')} AS cosine,
  contains(lower({blanks('content')}), lower('{query}')) AS hit
  FROM cos JOIN chunks k USING (chunk_id) WHERE {where}),
placed AS (SELECT *, hit AND row_number() OVER (ORDER BY cosine DESC, seq) <= {head} AS keyword_hit FROM scored),
raised AS (SELECT *, cosine + CASE WHEN keyword_hit THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS r FROM placed),
bonus AS (SELECT *, {round4('r')} AS hybrid FROM raised),
damp AS (SELECT *, hybrid * ((1.0::DOUBLE - {weight}::DOUBLE) + {weight}::DOUBLE * trust::DOUBLE) AS d FROM bonus),
final AS (SELECT *, {round4('d')} AS score FROM damp),
hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, hybrid DESC, cosine DESC, seq) AS rank
  FROM final QUALIFY rank <= {top_k})"""


def pack(parts: str, glue: str, limit: int) -> str:
    """Greedy packing of a list of strings as a reduction; ``glue`` is an SQL literal of 1 or 2 characters."""
    size = f"(len(p.open) + length({glue}))"
    empty = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'used': 0::BIGINT}"
    item = "{'done': []::VARCHAR[], 'open': x, 'used': 0::BIGINT}"
    fold = f"""list_reduce(list_prepend({empty}, list_transform({parts}, lambda x: {item})), lambda a, p:
  CASE WHEN a.open IS NULL THEN {{'done': a.done, 'open': p.open, 'used': {size}::BIGINT}}
  WHEN a.used + {size} <= {limit} THEN {{'done': a.done, 'open': a.open || {glue} || p.open, 'used': (a.used + {size})::BIGINT}}
  ELSE {{'done': list_append(a.done, a.open), 'open': p.open, 'used': {size}::BIGINT}} END)"""
    return f"(SELECT list_filter(list_append(f.done, f.open), lambda x: x IS NOT NULL) FROM (SELECT {fold} AS f))"


def sessions(width: int = 1) -> str:
    return f"""sessions AS (
  SELECT session_no, 'agent_' || (session_no % 4) AS agent_id, 'proj_' || (session_no % 3) AS project_id,
    strftime(TIMESTAMP '2024-01-01' + to_minutes((session_no // 2) * 14), '%Y%m%d_%H%M') AS session_ts,
    'archive/' || session_no || '.json' AS file,
    CASE WHEN session_no % 5 = 3 THEN 'collapsed' WHEN session_no % 5 = 1 THEN 'summarized' ELSE 'archived' END AS status
  FROM (SELECT DISTINCT conv_id // {width} AS session_no FROM conversations))"""


def items(width: int = 1) -> str:
    return f"""items AS (
  SELECT conv_id // {width} AS session_no, turn % 6 AS key_pos, conv_id * 1000 + turn AS item_pos,
    ['custom_metric', 'actions', 'decisions', 'chat_history', 'next_steps', 'done'][turn % 6 + 1] AS raw_key,
    '[' || role || '] ' || {blanks('text')} AS item, role, text
  FROM conversations)"""


OVERFLOW = " (обрезано: ещё есть данные в архиве)"


def buckets(source: str = "items") -> str:
    """CTEs ending in ``rows(session_no, bucket, pos, text)``."""
    marked = truncate(f"text || repeat('{OVERFLOW}', 1)", 300)
    return f"""cand AS (
  SELECT session_no, CASE raw_key WHEN 'actions' THEN 'done' WHEN 'done' THEN 'done' WHEN 'decisions' THEN 'decisions'
    WHEN 'next_steps' THEN 'next' WHEN 'chat_history' THEN 'dialog' ELSE 'other' END AS bucket, key_pos, item_pos,
    {truncate("CASE WHEN raw_key = 'custom_metric' THEN raw_key || ': ' || item ELSE item END", 300)} AS text
  FROM {source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_no, bucket ORDER BY key_pos, item_pos) AS pos,
  CASE bucket WHEN 'dialog' THEN 5 ELSE 10 END AS cap FROM cand),
marks AS (SELECT session_no, bucket, CASE WHEN bucket = 'other' THEN count(*) ELSE count(DISTINCT key_pos) END AS m
  FROM ranked WHERE pos > cap GROUP BY session_no, bucket),
step AS (WITH RECURSIVE s AS (
    SELECT r.session_no, r.bucket, r.pos, r.text, CASE WHEN r.pos = r.cap THEN least(coalesce(m.m, 0), 12) ELSE 0 END AS left_
    FROM ranked r LEFT JOIN marks m USING (session_no, bucket) WHERE r.pos <= r.cap
    UNION ALL
    SELECT session_no, bucket, pos, {marked}, left_ - 1 FROM s WHERE left_ > 0)
  SELECT * FROM s WHERE left_ = 0),
rows AS (SELECT session_no, bucket, pos::INTEGER AS pos, text FROM step)"""


BUCKET_NAMES = ("done", "decisions", "next", "dialog", "other")


def arrays(source: str = "sessions") -> str:
    """CTE ``full_``: sessions with a list per bucket."""
    lists = ", ".join(
        f"coalesce((SELECT list(text ORDER BY pos) FROM rows r WHERE r.session_no = s.session_no AND bucket = '{b}'), []) AS {b}_l"
        for b in BUCKET_NAMES
    )
    return f"full_ AS (SELECT s.*, {lists} FROM {source} s)"


def document(head: str, sections, empty: str) -> str:
    """Text of a document from SQL list expressions per section."""
    parts = [
        f"CASE WHEN len({items_}) > 0 THEN chr(10) || chr(10) || '## {title}' || chr(10) || "
        f"array_to_string(list_transform({items_}, lambda x: '- ' || x), chr(10)) ELSE '' END"
        for title, items_ in sections
    ]
    none = " AND ".join(f"len({items_}) = 0" for _, items_ in sections)
    return f"{head} || {' || '.join(parts)} || CASE WHEN {none} THEN chr(10) || chr(10) || '{empty}' ELSE '' END"


SUMMARY = document(
    "'# Автосводка сессии (' || agent_id || ')' || chr(10) || '**Сессия:** ' || session_ts || ' · **Источник:** ' || file"
    " || chr(10) || '**Сгенерировано:** SessionSummarizer (эвристика, без LLM)'",
    [("Сделано", "done_l"), ("Решения", "decisions_l"), ("Дальше", "next_l"),
     ("Диалог (конец сессии)", "dialog_l"), ("Прочее", "other_l")],
    "Сессия не содержит структурированных данных (архив пуст).",
)

DECISIONS = """decisions AS (
  SELECT 'proj_' || (user_id % 10) AS project_id, event_id AS seq, event_type || ' ' || props AS decision,
    ['agent_' || (user_id % 8), 'agent_' || (event_id % 3)] AS by_agents,
    'seen by user ' || user_id AS reason, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS recorded_at
  FROM events)"""

TASKS = """tev AS (
  SELECT 'task_' || (event_id // 3) AS task_id, 'agent_' || ((event_id // 3) % 8) AS agent_id,
    'proj_' || ((event_id // 3) % 10) AS project_id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at,
    CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_type = 'purchase' THEN 'end'
      WHEN event_type = 'error' THEN 'cancel' ELSE 'note' END AS action, event_type AS description
  FROM events),
tasks AS (
  SELECT s.task_id, s.agent_id, s.project_id, s.description,
    CASE c.action WHEN 'end' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'running' END AS status,
    s.at AS started_at, c.at AS ended_at
  FROM (SELECT * FROM tev WHERE action = 'start' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1) s
  LEFT JOIN (SELECT * FROM tev WHERE action IN ('end', 'cancel')
    QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1) c
    ON c.task_id = s.task_id AND c.seq > s.seq)"""

TASK_LOG = """tlog AS (
  SELECT 'task_' || (event_id // 3) AS task_id, CASE WHEN event_id % 15 = 2 THEN 'agent_' || (event_id % 8) ELSE 'agent_' || ((event_id // 3) % 8) END AS agent_id,
    'proj_' || ((event_id // 3) % 10) AS project_id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at,
    CASE WHEN event_id = 302 THEN 'clear' WHEN event_id % 15 = 2 OR event_id % 3 = 0 THEN 'start' WHEN event_type = 'purchase' THEN 'end'
      WHEN event_type = 'error' THEN 'cancel' ELSE 'note' END AS action, event_type AS description, 'model_' || (event_id % 3) AS model,
    CASE WHEN event_id % 5 = 0 THEN 'deep' END AS variant, CASE WHEN event_id % 6 <> 0 THEN event_type || ',#task' ELSE '' END AS tags,
    CASE WHEN event_id % 4 <> 0 THEN 'context of ' || repeat('agent_' || ((event_id // 3) % 8) || ' ', (event_id % 40)::INTEGER) END AS context,
    CASE WHEN event_id % 3 <> 0 AND event_type = 'purchase' AND event_id % 2 = 0 THEN event_id END AS archive
  FROM events),
after AS (SELECT * FROM tlog WHERE seq > coalesce((SELECT max(seq) FROM tlog WHERE action = 'clear'), -1)),
begun AS (SELECT * FROM after WHERE action = 'start' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1),
closed AS (SELECT * FROM after WHERE action IN ('end', 'cancel') QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1),
result AS (SELECT task_id, max(seq) AS seq FROM after WHERE action = 'end' AND archive IS NOT NULL GROUP BY task_id),
log AS (
  SELECT b.task_id, b.agent_id, b.project_id, b.description, b.model, b.variant, b.tags,
    CASE c.action WHEN 'end' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'running' END AS status, b.at AS started_at, c.at AS ended_at,
    'archive/' || r.seq || '.json' AS archive, r.seq % 10 AS done, r.seq % 7 AS next, b.context IS NOT NULL AS context_loaded, substr(b.context, 1, 200) AS context_preview
  FROM begun b LEFT JOIN closed c ON c.task_id = b.task_id AND c.seq > b.seq LEFT JOIN result r ON r.task_id = b.task_id AND r.seq > b.seq)"""
