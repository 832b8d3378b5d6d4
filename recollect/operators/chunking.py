"""Splitting texts into chunks and the per-file ingestion plan.

Greedy packing is a left fold over a text's parts. It runs inside the row as
an ``aggregate``, so chunking needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import formats, html
from recollect.functions import text as tx
from recollect.settings import DEFAULTS

HEADING_KINDS = ("markdown", "pdf", "image", "docx", "epub")
_EMPTY = "array<string>"


def pack(parts: Column, glue: str, limit: int) -> Column:
    """Join consecutive parts while the sum of ``length + len(glue)`` stays within ``limit``.

    A part that is too long alone is kept whole.
    """
    overhead = len(glue)
    start = F.struct(
        F.array().cast(_EMPTY).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used")
    )

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part) + overhead
        fits = acc["open"].isNotNull() & (acc["used"] + size <= limit)
        return F.struct(
            F.when(fits | acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(fits, F.concat(acc["open"], F.lit(glue), part)).otherwise(part).alias("open"),
            F.when(fits, acc["used"] + size).otherwise(size).alias("used"),
        )

    return F.aggregate(
        parts, start, step,
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])),
    )


def _solid(chunks: Column) -> Column:
    return F.filter(F.transform(chunks, tx.strip), lambda c: c != "")


def chunk_plain(text: Column, limit: int = DEFAULTS.ingestion.max_chunk_chars) -> Column:
    """Paragraphs packed up to ``limit`` characters."""
    return pack(_solid(F.split(text, rf"\n{tx.SPACE}*\n")), "\n\n", limit)


def chunk_markdown(text: Column, limit: int = DEFAULTS.ingestion.max_chunk_chars) -> Column:
    """One chunk per heading section; a longer section is packed line by line."""
    sections = F.split(tx.unify_lines(text), r"\n(?=#{1,6}[^\S\n])")

    def split_up(section: Column) -> Column:
        return tx.let(
            tx.strip(section),
            lambda whole: F.when(F.length(whole) <= limit, F.array(whole)).otherwise(
                pack(F.split(section, "\n"), "\n", limit)
            ),
        )

    return _solid(F.flatten(F.transform(sections, split_up)))


def chunks_of(text: Column, kind: Column, limit: int = DEFAULTS.ingestion.max_chunk_chars) -> Column:
    return F.when(kind.isin(*HEADING_KINDS), chunk_markdown(text, limit)).otherwise(chunk_plain(text, limit))


def normalized(raw: Column, kind: Column) -> Column:
    """Any text kind as Markdown. The Arrow branches get NULL for rows of other kinds."""
    only = lambda *names: F.when(kind.isin(*names), raw)
    return (
        F.when(kind.isin("markdown", "text"), tx.strip(raw))
        .when(kind == "jsonl", tx.normalize_jsonl(raw))
        .when(kind == "json", formats.normalize_json(only("json")))
        .when(kind == "csv", formats.csv_to_markdown(only("csv")))
        .when(kind == "html", html.html_to_text(only("html")))
        .when(kind.isin("pdf", "image", "docx", "epub"), tx.normalize_ws(raw))
        .otherwise(tx.strip(raw))
    )


def ingest(files: DataFrame, limit: int = DEFAULTS.ingestion.max_chunk_chars) -> DataFrame:
    """Per file: status, reason, tags, project, source and the array of chunks.

    ``files`` has ``path`` and extracted ``raw`` text. Nothing raises: a bad
    file is a row with status ``skipped`` or ``error``.
    """
    path, raw = F.col("path"), F.col("raw")
    known = files.withColumn("kind", tx.file_kind(path))
    kind = F.col("kind")
    # Trimmed on the left only, which stops at the first other character: the test is made several times.
    blank = F.coalesce(F.ltrim(raw, F.lit(tx.BLANKS)), F.lit("")) == ""
    no_entries = F.array().cast("array<struct<key:string,value:string>>")

    def report(chunks: Column, meta: Column) -> Column:
        bad = (
            F.when(kind.isNull(), F.concat(F.lit("unsupported format "), tx.file_suffix(path)))
            .when(blank, "empty content").when(F.size(chunks) == 0, "no chunks produced")
        )
        entries = meta["entries"]
        return F.struct(
            F.when(kind.isNull(), "skipped").when(bad.isNotNull(), "error").otherwise("ingested").alias("status"),
            bad.alias("reason"),
            chunks.alias("chunks"),
            F.when(bad.isNull(), tx.doc_tags(tx.meta_list(entries, "tags"), kind)).alias("tags"),
            tx.meta_value(entries, "project").alias("project_id"),
            F.coalesce(tx.meta_value(entries, "source"), path).alias("source"),
        )

    def split(meta: Column) -> Column:
        usable = kind.isNotNull() & ~blank
        chunks = F.when(usable, chunks_of(meta["body"], kind, limit)).otherwise(F.array().cast(_EMPTY))
        return tx.let(chunks, lambda c: report(c, meta))

    def parsed(md: Column) -> Column:
        plain = F.struct(no_entries.alias("entries"), md.alias("body"))
        return tx.let(F.when(kind == "markdown", tx.front_matter(md)).otherwise(plain), split)

    # Bound variables instead of a chain of columns: the optimizer would repeat
    # each column's whole expression wherever a later one names it.
    done = known.withColumn("_r", tx.let(normalized(raw, kind), parsed))
    return done.select(
        *[c for c in files.columns if c != "raw"], F.coalesce(kind, F.lit("unknown")).alias("kind"), "_r.*"
    )


def file_chunks(ingested: DataFrame, order: str) -> DataFrame:
    """The chunks of ingested files as notes, in file order then text order.

    Other files have no chunks, so the explode alone drops them.
    """
    return ingested.select(
        order, F.posexplode("chunks").alias("pos", "content"), "tags", "project_id", "source"
    )


def ingest_report(ingested: DataFrame) -> DataFrame:
    return ingested.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("status") == "ingested").alias("ingested"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
