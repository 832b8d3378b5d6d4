"""The note store as a relation: identity, deduplication, filters, keyword search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.trust import clamp_trust, source_trust
from recollect.operators.common import first_by
from recollect.settings import DEFAULTS, Trust

NOTE_COLUMNS = ("content", "tags", "project_id", "agent_id", "source", "trust", "created_at")


def identify(notes: DataFrame, trust: Trust = DEFAULTS.trust) -> DataFrame:
    """Add ``chunk_id`` and resolve trust: the given value clamped, else by source."""
    given = F.col("trust") if "trust" in notes.columns else F.lit(None).cast("double")
    resolved = F.when(given.isNull(), source_trust(F.col("source"), trust)).otherwise(clamp_trust(given, trust))
    return notes.withColumn("trust", resolved).withColumn("chunk_id", tx.chunk_id(F.col("content")))


def deduplicate(notes: DataFrame, columns: Sequence[str] = NOTE_COLUMNS) -> DataFrame:
    """One row per content, the one first inserted, whatever its project or agent.

    Ask only for the columns needed: they are what the shuffle carries. The
    result is hash-partitioned by ``chunk_id``.
    """
    return first_by(notes, ["chunk_id"], "seq", columns)


def new_chunks(notes: DataFrame, store: DataFrame, columns: Sequence[str] = NOTE_COLUMNS) -> DataFrame:
    """What an idempotent insert adds: distinct contents the store does not hold."""
    known = store.select("chunk_id").join(notes.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return deduplicate(notes, columns).join(known, "chunk_id", "left_anti")


def tag_index(chunks: DataFrame) -> DataFrame:
    """Inverted index in long form, one row per (tag, chunk)."""
    return chunks.select(F.explode("tags").alias("tag"), "chunk_id").distinct()


def has_all_tags(tags: Sequence[str]) -> Column:
    condition = F.lit(True)
    for tag in tags:
        condition = condition & F.array_contains("tags", tag)
    return condition


def visible_to(agent_id: str) -> Column:
    """Own notes, and every note that belongs to a project."""
    own = F.col("agent_id").eqNullSafe(F.lit(agent_id))
    return own | (F.coalesce(F.col("project_id"), F.lit("")) != "")


def scope(
    chunks: DataFrame,
    tags: Sequence[str] | None = None,
    project_id: str | None = None,
    agent_id: str | None = None,
) -> DataFrame:
    """The store's three filters; an empty value means no filter."""
    if tags:
        chunks = chunks.where(has_all_tags(tags))
    if project_id:
        chunks = chunks.where(F.col("project_id") == project_id)
    if agent_id:
        chunks = chunks.where(visible_to(agent_id))
    return chunks


def rendered(chunks: DataFrame) -> Column:
    """The stored text of a note, front matter included."""
    return tx.render_note(
        F.col("content"), F.col("tags"), F.col("project_id"), F.col("source"),
        F.col("agent_id"), F.col("trust"), F.col("created_at"),
    )


def stored_body(chunks: DataFrame) -> Column:
    """What reading a note back yields: the text after the second ``---``, trimmed.

    Normally the content; a ``---`` inside a header value moves the cut.
    """
    header = F.concat_ws("\n", F.array_join("tags", "\n"), "project_id", "source", "agent_id")
    return F.when(F.contains(header, F.lit("---")), tx.strip_front_matter(rendered(chunks))).otherwise(
        tx.strip(F.col("content"))
    )


def keyword_search(
    chunks: DataFrame,
    query: str,
    tags: Sequence[str] | None = None,
    project_id: str | None = None,
    agent_id: str | None = None,
) -> DataFrame:
    """Case-insensitive substring match over the stored text, front matter included.

    Narrow: one scan, no shuffle. The empty query matches every note. Callers
    order by ``seq`` for insertion order.
    """
    found = scope(chunks, tags, project_id, agent_id)
    if query:
        found = found.where(F.contains(F.lower(rendered(found)), F.lit(query.lower())))
    return found


def since(ts: Column, bound: Column | None) -> Column:
    """Inclusive lower bound; rows without a time fall out, an unknown bound lets all pass."""
    if bound is None:
        return F.lit(True)
    return bound.isNull() | F.coalesce(ts >= bound, F.lit(False))
