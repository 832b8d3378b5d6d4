"""Cross-agent project digest and the context an agent starts with, as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.operators.chunks import rendered, since, stored_body
from recollect.operators.common import number_in_group, top_n
from recollect.operators.sessions import bucket_rows
from recollect.settings import DEFAULTS, Digest

# Labels of a session's buckets inside the digest, and its wording.
LABELS = (("done", "Сделано"), ("decisions", "Решения"), ("next", "Дальше"), ("other", "Прочее"))

WORDING = {
    "title": "# Проектный дайджест: ",
    "nothing": "Нет данных по проекту `{}`: нет сессий/решений/заметок за указанный период.",
    "shared": "## Shared Project Knowledge (",
    "by": "**Сгенерировано:** ProjectDigest (эвристика, без LLM).",
    "n_sessions": "**Сессий:** ",
    "n_agents": " · **Агентов:** ",
    "n_decisions": " · **Решений:** ",
    "n_chunks": " · **Заметок:** ",
    "sessions": "\n## Сессии по агентам",
    "decisions": "\n## Совместные решения (",
    "chunks": "\n## Свежие заметки проекта (",
    "agent_sessions": " (сессий: ",
    "agents": "** — агенты: ",
    "reason": "    - Причина: ",
    "decision_line": "- **Decision:** ",
    "agents_line": "  - **By Agents:** ",
    "reason_line": "  - **Reason:** ",
}


def _word(name: str) -> Column:
    return F.lit(WORDING[name])


def _bound(value: Column | str | None) -> Column | None:
    if value is None:
        return None
    return tx.parse_time(F.lit(value) if isinstance(value, str) else value)


def digest_sessions(sessions: DataFrame, project_id: str, since_ts=None, exclude_agent: str | None = None,
                    only_agent: str | None = None, conf: Digest = DEFAULTS.digest) -> DataFrame:
    """Each agent's newest sessions in a project, ranked newest first."""
    rows = sessions.where((F.col("project_id") == project_id) & (F.col("status") != "collapsed") & F.col("file").isNotNull())
    if only_agent:
        rows = rows.where(F.col("agent_id") == only_agent)
    if exclude_agent:
        rows = rows.where(F.col("agent_id") != exclude_agent)
    rows = rows.where(since(tx.parse_time(F.col("session_ts")), _bound(since_ts)))
    return top_n(rows, ["agent_id"], [F.col("session_ts").desc()], conf.max_sessions_per_agent, "rank")


def with_bucket_lines(picked: DataFrame, items: DataFrame, by: str, conf: Digest = DEFAULTS.digest) -> DataFrame:
    """The picked sessions with one joined text per bucket; only their items are read on."""
    rows = bucket_rows(items.join(picked.select(by), by, "left_semi"), [by]).where(F.col("pos") <= conf.max_items)

    def joined(bucket: str) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("pos", "text"))))
        return F.array_join(F.transform(entries, lambda e: tx.truncate(e["text"], conf.max_item_chars)), "; ").alias(bucket)

    lines = rows.groupBy(by).agg(*[joined(b) for b, _ in LABELS])
    return picked.join(lines, by, "left").na.fill("", [b for b, _ in LABELS])


def digest_decisions(decisions: DataFrame, project_id: str, since_ts=None, conf: Digest = DEFAULTS.digest) -> DataFrame:
    """The newest decisions of a project by their time text."""
    rows = decisions.where(F.col("project_id") == project_id)
    rows = rows.where(since(tx.parse_time(F.col("recorded_at")), _bound(since_ts)))
    return rows.orderBy(F.coalesce("recorded_at", F.lit("")).desc(), "seq").limit(conf.max_decisions)


def digest_chunks(chunks: DataFrame, project_id: str, since_ts=None, conf: Digest = DEFAULTS.digest) -> DataFrame:
    """The newest notes of a project with a preview."""
    rows = chunks.where(F.col("project_id") == project_id)
    rows = rows.where(since(tx.parse_time(F.col("created_at")), _bound(since_ts)))
    return (
        # Whether a note has text is enough to choose; only the chosen are previewed.
        rows.where(stored_body(rows) != "")
        .orderBy(F.coalesce("created_at", F.lit("")).desc(), "seq").limit(conf.max_chunks)
        .withColumn("preview", tx.preview(rendered(rows), conf.preview_chars))
        .select("seq", F.substring("chunk_id", 1, 8).alias("id"), "created_at", "agent_id", "preview")
    )


def digest_stats(sessions: DataFrame, decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: agents, sessions, decisions, chunks of an already capped digest."""
    rows = (
        sessions.select(F.lit("s").alias("kind"), "agent_id")
        .unionAll(decisions.select(F.lit("d"), F.lit(None).cast("string")))
        .unionAll(chunks.select(F.lit("c"), F.lit(None).cast("string")))
    )
    kind = F.col("kind")
    return rows.agg(
        F.count_distinct(F.when(kind == "s", F.col("agent_id"))).alias("agents"),
        F.count_if(kind == "s").alias("sessions"),
        F.count_if(kind == "d").alias("decisions"),
        F.count_if(kind == "c").alias("chunks"),
    )


def _lines(df: DataFrame, section: int, agent, rank, *parts: Column) -> DataFrame:
    """One output row per non-NULL part, numbered in the order given."""
    entries = F.array(*[F.struct(F.lit(i).alias("part"), p.alias("line")) for i, p in enumerate(parts)])
    return (
        df.select(F.lit(section).alias("section"), agent.alias("agent_id"), rank.cast("int").alias("rank"),
                  F.explode(F.filter(entries, lambda e: e["line"].isNotNull())).alias("e"))
        .select("section", "agent_id", "rank", "e.part", "e.line")
    )


def _ranked(df: DataFrame, newest: Column) -> DataFrame:
    """Numbers the rows of an already limited selection."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(newest.desc(), "seq")))


def project_digest(sessions: DataFrame, items: DataFrame, decisions: DataFrame, chunks: DataFrame, by: str,
                   project_id: str, since_ts=None, exclude_agent: str | None = None, only_agent: str | None = None,
                   empty_notice: bool = True, conf: Digest = DEFAULTS.digest) -> DataFrame:
    """The digest as rows (section, agent_id, rank, part, line); ordered by these it is the document.

    The entries are computed once and pass one exchange; headings are counts
    over that same exchange (they name all its columns, so Spark reuses it).
    """
    picked = digest_sessions(sessions, project_id, since_ts, exclude_agent, only_agent, conf)
    told = with_bucket_lines(picked, items, by, conf)
    chosen = _ranked(digest_decisions(decisions, project_id, since_ts, conf), F.coalesce("recorded_at", F.lit("")))
    notes = _ranked(digest_chunks(chunks, project_id, since_ts, conf), F.coalesce("created_at", F.lit("")))

    none, zero, rank = F.lit(""), F.lit(0), F.col("rank")
    by_agents = F.array_join(F.when(F.size("by_agents") > 0, F.col("by_agents")).otherwise(F.array(F.lit("?"))), ", ")
    who = F.when(F.coalesce("agent_id", none) != "", F.concat(F.lit(" ("), "agent_id", F.lit(")"))).otherwise(none)
    entries = (
        _lines(
            told, 1, F.col("agent_id"), rank,
            F.concat(F.lit("- **"), "session_ts", F.lit("**")),
            *[F.when(F.col(b) != "", F.concat(F.lit(f"    - {label}: "), F.col(b))) for b, label in LABELS],
        )
        .unionAll(_lines(
            chosen, 2, none, rank,
            F.concat(F.lit("- "), F.substring(F.coalesce("recorded_at", F.lit("?")), 1, 10), F.lit(" **"),
                     tx.truncate(F.coalesce("decision", none), conf.max_item_chars), _word("agents"), by_agents),
            F.when(F.coalesce("reason", none) != "", F.concat(_word("reason"), tx.truncate(F.col("reason"), 200))),
        ))
        .unionAll(_lines(
            notes, 3, none, rank,
            F.concat(F.lit("- "), F.substring(F.coalesce("created_at", none), 1, 10), who, F.lit(": "), "preview"),
        ))
        .repartition("section", "agent_id")
    )

    def opening(section: int) -> Column:
        here = (F.col("section") == section) & (F.col("part") == 0)
        return here & (F.col("rank") > 0) & F.col("line").isNotNull()

    stats = entries.agg(
        F.count_if(opening(1)).alias("sessions"), F.count_if(opening(2)).alias("decisions"),
        F.count_if(opening(3)).alias("chunks"), F.count_distinct(F.when(opening(1), F.col("agent_id"))).alias("agents"),
    )
    text = lambda c: F.col(c).cast("string")
    some = (F.col("sessions") + F.col("decisions") + F.col("chunks")) > 0
    title = lambda section, part, when, *parts: F.struct(
        F.lit(section).alias("section"), F.lit(part).alias("part"), F.when(when, F.concat(*parts)).alias("line"))
    notice = WORDING["nothing"].format(project_id)
    titles = F.array(
        title(0, 0, some, F.lit(WORDING["title"] + project_id)),
        title(0, 1, some, _word("n_sessions"), text("sessions"), _word("n_agents"), text("agents"),
              _word("n_decisions"), text("decisions"), _word("n_chunks"), text("chunks")),
        title(0, 2, some, _word("by")),
        title(0, 0, ~some & F.lit(empty_notice), F.lit(notice)),
        title(1, 0, F.col("sessions") > 0, _word("sessions")),
        title(2, 0, F.col("decisions") > 0, _word("decisions"), text("decisions"), F.lit(")")),
        title(3, 0, F.col("chunks") > 0, _word("chunks"), text("chunks"), F.lit(")")),
    )
    head = stats.select(F.explode(F.filter(titles, lambda t: t["line"].isNotNull())).alias("t")).select(
        "t.section", none.alias("agent_id"), zero.alias("rank"), "t.part", "t.line")
    per_agent = entries.groupBy("agent_id").agg(F.count_if(opening(1)).alias("n")).where(F.col("n") > 0)
    agents = _lines(per_agent, 1, F.col("agent_id"), zero,
                    F.concat(F.lit("\n### "), F.col("agent_id"), _word("agent_sessions"), text("n"), F.lit(")")))
    return head.unionAll(agents).unionAll(entries)


def shared_decisions(decisions: DataFrame, project_id: str) -> DataFrame:
    """All decisions of a project as context lines, in the order they were recorded."""
    rows = decisions.where(F.col("project_id") == project_id)
    lines = (
        F.concat(_word("decision_line"), F.coalesce("decision", F.lit("N/A"))),
        F.concat(_word("agents_line"), F.array_join("by_agents", ", ")),
        F.concat(_word("reason_line"), F.coalesce("reason", F.lit("N/A")), F.lit("\n")),
    )
    return rows.select("seq", F.posexplode(F.array(*lines)).alias("part", "line"))


def decisions_list(decisions: DataFrame, project_id: str, block_rows: int = 1_000_000) -> DataFrame:
    """A project's decisions numbered from 1 in recording order."""
    rows = decisions.where(F.col("project_id") == project_id)
    numbered = number_in_group(rows, ["project_id"], "seq", F.floor(F.col("seq") / block_rows), "n")
    return numbered.select(
        (F.col("n") + 1).alias("n"), F.coalesce("decision", F.lit("N/A")).alias("decision"),
        F.array_join("by_agents", ", ").alias("by_agents"), F.coalesce("reason", F.lit("N/A")).alias("reason"),
    )


def agent_context(agent_id: str, project_id: str | None, summaries: DataFrame, collapsed: DataFrame,
                  sessions: DataFrame, items: DataFrame, decisions: DataFrame, chunks: DataFrame, by: str,
                  order: str) -> DataFrame:
    """What an agent reads first, as rows (block, section, agent_id, rank, part, line).

    Block 0 is the latest summary, or without one the collapsed history; block 1
    the project's decisions; block 2 the digest since the agent's own last
    session. A ``---`` line separates the blocks that are present.
    """
    own = F.col("agent_id") == agent_id
    mine, old = summaries.where(own), collapsed.where(own)
    told = shared_decisions(decisions, project_id) if project_id else None
    # One row tells which blocks there are and since when to tell; the digest opens with its title if it has any.
    known = sessions.where(own).agg(F.max_by("session_ts", order).alias("since"))
    for name, block in (("summary", mine), ("history", old), ("shared", told)):
        if block is not None:
            known = known.crossJoin(block.limit(1).agg((F.count("*") > 0).alias(name)))
    known = known.first()
    none, zero = F.lit(""), F.lit(0)
    if known.summary:
        first = _block(0, mine, zero, none, F.lit(-1), zero, F.col("body"))
    else:
        first = _block(0, old, F.col("section"), F.col("sort_key"), F.lit(-1), zero, F.col("line"))
    if not project_id:
        return first
    has_summary, has_shared = known.summary or known.history, known.shared
    title = F.lit(f"{WORDING['shared']}{project_id})")
    shared = _block(1, told.limit(1), zero, none, F.lit(-1), zero, title).unionAll(
        _block(1, told, zero, none, F.col("seq"), F.col("part"), F.col("line")))
    digest = project_digest(sessions, items, decisions, chunks, by, project_id, known.since, empty_notice=False)
    last = _block(2, digest, F.col("section"), F.col("agent_id"), F.col("rank"), F.col("part"), F.col("line"))
    opens = (F.col("rank") == -1) | ((F.col("block") == 2) & (F.col("section") == 0) & (F.col("part") == 0))
    if has_summary:
        shared = _broken_off(shared, opens)
    if has_summary or has_shared:
        last = _broken_off(last, opens)
    return first.unionAll(shared).unionAll(last)


def _block(number: int, df: DataFrame, section, agent, rank, part, line) -> DataFrame:
    return df.select(
        F.lit(number).alias("block"), section.alias("section"), agent.alias("agent_id"),
        rank.cast("bigint").alias("rank"), part.alias("part"), line.alias("line"))


def _broken_off(block: DataFrame, opens: Column) -> DataFrame:
    """A separator line (section -1) before the row that opens a block."""
    line = lambda section, text: F.struct(section.alias("section"), text.alias("line"))
    own = line(F.col("section"), F.col("line"))
    rows = F.when(opens, F.array(line(F.lit(-1), F.lit("---")), own)).otherwise(F.array(own))
    return block.select("block", "agent_id", "rank", "part", F.explode(rows).alias("r")).select(
        "block", "r.section", "agent_id", "rank", "part", "r.line")
