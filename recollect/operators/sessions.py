"""Session archives: buckets, summaries, collapse, compression, closing.

Items are rows, not documents: a session may be of any size. Every step that
caps a bucket does so with ``row_number() <= n``, which Spark applies before the
shuffle, so a hot session costs each task a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators.common import number_in_group, top_n
from recollect.settings import DEFAULTS, Compression, Summaries

BUCKETS = ("done", "decisions", "next", "dialog", "other")
# Session keys (after normalizing) and the bucket they feed.
BUCKET_KEYS = {
    "dialog": ("chat_history", "messages", "history", "dialog", "диалог"),
    "done": ("actions", "done", "completed", "what_was_done", "facts", "сделано", "действия", "шаги"),
    "decisions": ("decisions", "decision", "решения", "решение"),
    "next": ("next_steps", "todo", "followups", "follow_up", "plans", "what_next",
             "дальше", "планы", "следующие_шаги"),
}
# Marker of a full bucket, and the wording of the documents.
OVERFLOW = " (обрезано: ещё есть данные в архиве)"
SUMMARY_SECTIONS = (("done", "Сделано"), ("decisions", "Решения"), ("next", "Дальше"),
                    ("dialog", "Диалог (конец сессии)"), ("other", "Прочее"))
COMPACT_SECTIONS = (("done", "Сделано"), ("decisions", "Решения"), ("next", "Дальше"),
                    ("other", "Прочее"), ("dialog", "Диалог"))
WORDING = {
    "summary_title": "# Автосводка сессии (",
    "summary_session": "**Сессия:** ",
    "summary_source": " · **Источник:** ",
    "summary_by": "**Сгенерировано:** SessionSummarizer (эвристика, без LLM)",
    "summary_empty": "Сессия не содержит структурированных данных (архив пуст).",
    "stored_title": "# Session Summary for Agent: ",
    "stored_time": "\n\n**Timestamp:** ",
    "collapse_title": "# Свернутое резюме истории сессий (",
    "collapse_range": "**Сессии:** ",
    "collapse_count": " · **Свернуто:** ",
    "collapse_by": "**Сгенерировано:** SessionSummarizer.collapse_history (эвристика).",
    "collapse_lines": "\n## Сессии (по одной строке)",
    "collapse_decisions": "\n## Решения (агрегировано: ",
    "collapse_next": "\n## Дальше (агрегировано: ",
    "compact_title": "# Сжатая сессия",
    "compact_time": "**Время:** ",
    "compact_level": " · **Уровень сжатия:** ",
    "compact_empty": "Сессия не содержит структурированных данных.",
}
PROMPT_INTRO = (
    "Сожми сессию агента в компактную сводку на русском языке.",
    "Сохрани ВСЕ факты, решения и оставшиеся задачи. Убери повторы",
    "и несущественные детали. Формат ответа:",
    "СДЕЛАНО: ...\nРЕШЕНИЯ: ...\nДАЛЬШЕ: ...",
    "",
    "Исходные данные:",
)


def _word(name: str) -> Column:
    return F.lit(WORDING[name])


def bucket_of(raw_key: Column) -> Column:
    key = tx.norm_key(raw_key)
    out = F
    for bucket, names in BUCKET_KEYS.items():
        out = out.when(key.isin(*names), bucket)
    return out.otherwise("other")


def bucket_caps(conf: Summaries = DEFAULTS.summaries) -> dict[str, int]:
    return {b: conf.max_dialog if b == "dialog" else conf.max_items for b in BUCKETS}


def _cap(caps: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.element_at(table, F.col("bucket"))


def bucket_rows(items: DataFrame, by: Sequence[str], conf: Summaries = DEFAULTS.summaries) -> DataFrame:
    """(by..., bucket, pos, text): the first items of every bucket in session order.

    ``items`` has ``key_pos, item_pos, raw_key, item``. The last item of a full
    bucket carries the overflow marker, once per key that had more (for
    ``other`` once per item that found no room).
    """
    caps = bucket_caps(conf)
    limit = conf.max_item_chars
    bucket = bucket_of(F.col("raw_key"))
    rows = (
        items.withColumn("bucket", bucket)
        .withColumn("text", F.when(F.col("bucket") == "other", F.concat("raw_key", F.lit(": "), "item")).otherwise(F.col("item")))
        .select(*by, "bucket", "key_pos", "item_pos", "text")
        .where(tx.one_line(F.col("text")) != "")
    )
    group = [*by, "bucket"]
    kept = top_n(rows, group, [F.col("key_pos"), F.col("item_pos")], max(caps.values()), "pos").where(
        F.col("pos") <= _cap(caps)
    ).withColumn("text", tx.truncate(F.col("text"), limit))

    per_key = (
        items.select(*by, bucket.alias("bucket"), "key_pos")
        .withColumn("key_pos", F.when(F.col("bucket") != "other", F.col("key_pos")))
        .groupBy(*group, "key_pos").agg(F.count("*").alias("n"))
    )
    so_far = Window.partitionBy(*group).orderBy("key_pos").rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum("n").over(so_far) - _cap(caps)
    marks = (
        per_key.withColumn("over", over)
        .groupBy(*group)
        .agg(F.sum(F.when(F.col("bucket") == "other", F.greatest("over", F.lit(0)))
                   .otherwise((F.col("over") > 0).cast("bigint"))).alias("marks"))
        .where(F.col("marks") > 0)
    )
    marked = F.aggregate(
        # So many markers fill an item of any length up to its limit.
        F.sequence(F.lit(1), F.least(F.col("marks"), F.lit(limit // len(OVERFLOW) + 2)).cast("int")),
        F.col("text"),
        lambda text, _: tx.truncate(F.concat(text, F.lit(OVERFLOW)), limit),
    )
    return kept.join(marks, group, "left").select(
        *group,
        F.col("pos").cast("int").alias("pos"),
        F.when((F.col("pos") == _cap(caps)) & F.col("marks").isNotNull(), marked).otherwise(F.col("text")).alias("text"),
    )


def bucket_arrays(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per session with a capped array per bucket."""
    def collected(bucket: str) -> Column:
        entries = F.collect_list(F.when(F.col("bucket") == bucket, F.struct("pos", "text")))
        return F.transform(F.array_sort(entries), lambda e: e["text"]).alias(bucket)

    return rows.groupBy(*by).agg(*[collected(b) for b in BUCKETS])


def bucket_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def with_buckets(sessions: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sessions with their bucket arrays; a session without items gets empty ones."""
    joined = sessions.join(bucket_arrays(rows, by), list(by), "left")
    for b in BUCKETS:
        joined = joined.withColumn(b, F.coalesce(F.col(b), F.array().cast("array<string>")))
    return joined


def _section(title: str, items: Column) -> Column:
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n"), listed))


def _document(head: Sequence[Column], sections: Sequence[tuple[str, Column]], empty: str) -> Column:
    some = reduce(lambda a, b: a | b, [F.size(items) > 0 for _, items in sections])
    body = [_section(title, items) for title, items in sections]
    return F.concat_ws("\n", *head, *body, F.when(~some, F.lit("\n" + empty)))


def summary_text() -> Column:
    """Summary document of a session row (see :func:`with_buckets`)."""
    head = [
        F.concat(_word("summary_title"), "agent_id", F.lit(")")),
        F.concat(_word("summary_session"), "session_ts", _word("summary_source"), "file"),
        _word("summary_by"),
    ]
    return _document(
        head, [(title, F.col(b)) for b, title in SUMMARY_SECTIONS],
        WORDING["summary_empty"],
    )


def stored_summary(agent: Column, stamp: Column, body: Column) -> Column:
    """A summary as it is kept and served: header, then body."""
    return F.concat(_word("stored_title"), agent, _word("stored_time"), stamp, F.lit("\n\n"), body)


def archive_stamps(sessions: DataFrame, order: str, minute: str, block_rows: int = 1_000_000) -> DataFrame:
    """``session_ts`` unique per agent: the minute, with ``_n`` from the second one on."""
    numbered = number_in_group(
        sessions, ["agent_id", minute], order, F.floor(F.col(order) / block_rows), "_n"
    )
    n = F.col("_n")
    return numbered.withColumn(
        "session_ts", F.when(n == 0, F.col(minute)).otherwise(F.concat(minute, F.lit("_"), n.cast("string")))
    ).drop("_n")


def latest_session(sessions: DataFrame) -> DataFrame:
    """Per agent the newest session (by stamp text) that is not collapsed."""
    rest = [c for c in sessions.columns if c != "agent_id"]
    return (
        sessions.where(F.col("status") != "collapsed")
        .groupBy("agent_id").agg(F.max_by(F.struct(*rest), F.col("session_ts")).alias("_s"))
        .select("agent_id", *[F.col("_s")[c].alias(c) for c in rest])
    )


def collapsible(sessions: DataFrame, keep_last: int = 1) -> DataFrame:
    """Sessions that collapse: all usable ones but each agent's newest ``keep_last``.

    The few kept rows are found first and removed by an anti join on the session
    itself, so an agent's history is never gathered in one place.
    """
    usable = sessions.where(F.col("status") != "collapsed")
    if keep_last <= 0:
        return usable
    newest = top_n(usable.select("agent_id", "session_ts"), ["agent_id"], [F.col("session_ts").desc()], keep_last)
    return usable.join(newest.select("agent_id", "session_ts"), ["agent_id", "session_ts"], "left_anti")


def collapse_report(sessions: DataFrame, keep_last: int = 1) -> DataFrame:
    """Per agent: status, how many collapse, from when to when."""
    usable = sessions.where(F.col("status") != "collapsed").groupBy("agent_id").agg(F.count("*").alias("archives"))
    folded = collapsible(sessions, keep_last).groupBy("agent_id").agg(
        F.count("*").alias("collapsed"), F.min("session_ts").alias("first_ts"), F.max("session_ts").alias("last_ts")
    )
    return usable.join(folded, "agent_id", "left").select(
        "agent_id",
        F.when(F.col("collapsed").isNull(), "nothing_to_collapse").otherwise("ok").alias("status"),
        "archives",
        F.coalesce("collapsed", F.lit(0)).alias("collapsed"),
        "first_ts", "last_ts",
    )


def collapse_history(sessions: DataFrame, items: DataFrame, by: str, keep_last: int = 1,
                     conf: Summaries = DEFAULTS.summaries) -> DataFrame:
    """The collapsed history of every agent, as lines.

    (agent_id, section, sort_key, line); ordering by the first three columns
    yields the document. An agent's history has one line per session, so it is
    kept as rows and never built as one value.
    """
    folded = collapsible(sessions, keep_last)
    rows = bucket_rows(items.join(folded.select(by), by, "left_semi"), [by], conf)
    # One exchange of the bucketed items serves both aggregates below.
    told = (
        rows.join(folded.select(by, "agent_id", "session_ts"), by)
        .select("agent_id", "session_ts", "bucket", "pos", "text")
        .repartition("agent_id", "session_ts")
    )
    facts = told.groupBy("agent_id", "session_ts").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS],
        F.max(F.when((F.col("bucket") == "done") & (F.col("pos") == 1), F.col("text"))).alias("first_done"),
    )
    per_session = folded.join(facts, ["agent_id", "session_ts"], "left")
    counts = F.concat_ws(", ", *[F.when(F.col(b) > 0, F.concat(F.lit(f"{b}="), F.col(b).cast("string"))) for b in BUCKETS])
    session_lines = per_session.select(
        "agent_id", F.lit(1).alias("section"), F.col("session_ts").alias("sort_key"),
        F.concat(
            F.lit("- **"), "session_ts", F.lit("** — "), F.coalesce("first_done", F.lit("—")),
            F.when(counts != "", F.concat(F.lit(" · ("), counts, F.lit(")"))).otherwise(F.lit("")),
        ).alias("line"),
    )
    totals = folded.groupBy("agent_id").agg(
        F.count("*").alias("n"), F.min("session_ts").alias("first_ts"), F.max("session_ts").alias("last_ts")
    )

    def line(section: int, key: str, *parts) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(key).alias("sort_key"), F.concat(*parts).alias("line"))

    agent = F.col("agent_id")
    head = totals.select("agent_id", F.explode(F.array(
        line(0, "0", _word("collapse_title"), agent, F.lit(")")),
        line(0, "1", _word("collapse_range"), F.col("first_ts"), F.lit(" … "), F.col("last_ts"),
             _word("collapse_count"), F.col("n").cast("string")),
        line(0, "2", _word("collapse_by")),
        line(1, "", _word("collapse_lines")),
    )).alias("l")).select("agent_id", "l.*")

    out = head.unionByName(session_lines)
    first_seen = (
        told.groupBy("agent_id", "bucket", "text").agg(F.min(F.struct("session_ts", "pos")).alias("seen"))
        .where(F.col("bucket").isin("decisions", "next"))
    )
    distinct = first_seen.groupBy("agent_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("decisions", "next")]
    )
    sizes = totals.select("agent_id").join(distinct, "agent_id", "left").na.fill(0, ["decisions", "next"])
    titles = sizes.select("agent_id", F.explode(F.array(*[
        line(s, "", _word(f"collapse_{b}"), F.col(b).cast("string"), F.lit(")"))
        for s, b in ((2, "decisions"), (3, "next"))
    ])).alias("l")).select("agent_id", "l.*")
    shown = top_n(first_seen, ["agent_id", "bucket"], [F.col("seen")], conf.max_items).select(
        "agent_id",
        F.when(F.col("bucket") == "decisions", 2).otherwise(3).alias("section"),
        F.lpad(F.col("rn").cast("string"), 4, "0").alias("sort_key"),
        F.concat(F.lit("- "), "text").alias("line"),
    )
    return out.unionByName(titles).unionByName(shown)


def compact_arrays(sessions: DataFrame, conf: Compression = DEFAULTS.compression) -> DataFrame:
    limits = {"done": conf.max_done, "decisions": conf.max_decisions, "next": conf.max_next,
              "other": conf.max_other, "dialog": conf.max_dialog}
    for bucket, n in limits.items():
        sessions = sessions.withColumn(bucket, F.slice(F.col(bucket), 1, n))
    return sessions


def _compact_text(buckets: dict[str, Column], level: Column) -> Column:
    agent = F.col("agent_id")
    who = F.when(F.coalesce(agent, F.lit("")) != "", F.concat(F.lit(" ("), agent, F.lit(")"))).otherwise(F.lit(""))
    head = [
        F.concat(_word("compact_title"), who),
        F.concat(_word("compact_time"), F.coalesce("session_ts", F.lit("?")), F.lit(WORDING["compact_level"]), level.cast("string")),
    ]
    return _document(head, [(t, buckets[b]) for b, t in COMPACT_SECTIONS], WORDING["compact_empty"])


def upgrade_prompt() -> Column:
    """The instruction handed to a level-2 rewriter."""
    parts = [
        F.when(F.size(b) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(b, "; ")))
        for b, title in COMPACT_SECTIONS if b != "dialog"
    ]
    return F.concat_ws("\n", F.lit("\n".join(PROMPT_INTRO)), *parts)


def compress(sessions: DataFrame, max_chars: int | None = None, conf: Compression = DEFAULTS.compression,
             item_chars: int = DEFAULTS.summaries.max_item_chars,
             rewrite: Callable[[Column], Column] | None = None,
             rewriter: Callable[[Column], Column] | None = None, level: int | None = None) -> DataFrame:
    """Compact document of each session row, with size statistics.

    The document shrinks until it fits: without dialog, then with shorter items,
    then cut. ``in_chars`` is the length of the session's JSON. ``rewrite`` (for
    instance a pandas UDF) makes level 2: it turns the prompt into free text. A
    ``rewriter`` (see :mod:`recollect.functions.rewriting`) may fail on single rows, which
    then stay at level 1. Columns ``level``, ``llm``, ``llm_status`` (``ok``, ``error``;
    ``skipped`` where level 2 is asked for and nothing can make it) and ``llm_error`` tell.
    """
    limit = max_chars or conf.max_chars
    compact = compact_arrays(sessions, conf)
    none = F.lit(None).cast("string")
    if rewriter is not None:
        compact = compact.withColumn("_llm", rewriter(upgrade_prompt()))
        ok = F.col("_llm.error").isNull()
        told = {"llm": tx.strip(F.col("_llm.text")), "llm_status": F.when(ok, "ok").otherwise("error"), "llm_error": F.col("_llm.error"), "level": F.when(ok, 2).otherwise(1)}
        compact = compact.select("*", *[c.alias(name) for name, c in told.items()]).drop("_llm")
    elif rewrite is not None:
        compact = compact.withColumns({"llm": tx.strip(rewrite(upgrade_prompt())), "llm_status": F.lit("ok"), "llm_error": none, "level": F.lit(2)})
    else:
        compact = compact.withColumns({"llm": none, "llm_status": F.lit("skipped" if (level or 1) >= 2 else None).cast("string"), "llm_error": none, "level": F.lit(1)})
    level = F.col("level")
    arrays = {b: F.col(b) for b in BUCKETS}
    no_dialog = {**arrays, "dialog": F.array().cast("array<string>")}
    short = max(40, int(item_chars * 0.6))
    cut = {b: c if b == "dialog" else F.transform(c, lambda x: tx.truncate(x, short)) for b, c in no_dialog.items()}
    staged = (
        compact.withColumn("_full", _compact_text(arrays, level))
        .withColumn("_slim", F.when(F.length("_full") > limit, _compact_text(no_dialog, level)))
        .withColumn("_short", F.when(F.length("_slim") > limit, _compact_text(cut, level)))
    )
    text = F.when(F.col("_slim").isNull() | (limit < 0), F.col("_full")).when(F.col("_short").isNull(), F.col("_slim")).when(
        F.length("_short") > limit, F.concat(tx.rstrip(F.substring("_short", 1, limit - 1)), F.lit("…"))
    ).otherwise(F.col("_short"))
    n_out = F.length("markdown").cast("bigint")
    # One decimal, half up, in whole numbers.
    ratio = F.floor((F.col("in_chars") * 20 + n_out) / (n_out * 2)) / 10
    return (
        staged.withColumn("markdown", text).drop("_full", "_slim", "_short")
        .withColumn("out_chars", n_out)
        .withColumn("ratio", F.when(n_out > 0, ratio).otherwise(F.lit(0.0)))
    )


def stale(sessions: DataFrame, now: Column, timeout_min: int = DEFAULTS.summaries.autoclose_minutes) -> DataFrame:
    """Archived, never summarized, older than the timeout (or of unknown age)."""
    ts = tx.parse_time(F.col("session_ts"))
    cutoff = now - F.make_interval(mins=F.lit(max(1, int(timeout_min))))
    return sessions.where((F.col("status") == "archived") & F.coalesce(ts < cutoff, F.lit(True)))


def autoclose(sessions: DataFrame, items: DataFrame, by: str, now: Column,
              timeout_min: int = DEFAULTS.summaries.autoclose_minutes) -> DataFrame:
    """Summaries of all stale sessions of all agents."""
    due = stale(sessions, now, timeout_min)
    rows = bucket_rows(items.join(due.select(by), by, "left_semi"), [by])
    return with_buckets(due, rows, [by]).withColumn("summary", summary_text())
