"""Text functions as native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space when trimming.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Regex classes: any white space; white space within a line; line ends other
# than a line feed. (?U) and \v are single tests in Java, unlike spelled-out sets.
SPACE = r"(?U:[\s\x1c-\x1f])"
INLINE_SPACE = r"(?U:[\s\x1f&&[^\n]])"
ODD_LINE_END = r"[\v\x1c-\x1e&&[^\n]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKEN = "[а-яёa-z0-9]+"

# File suffix -> kind of content.
KINDS = {
    ".md": "markdown", ".markdown": "markdown",
    ".txt": "text", ".text": "text",
    ".json": "json", ".jsonl": "jsonl", ".csv": "csv",
    ".html": "html", ".htm": "html",
    ".pdf": "pdf", ".docx": "docx", ".epub": "epub",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image",
    ".tiff": "image", ".tif": "image", ".webp": "image",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    Keeps nested expressions small; ``body`` must be native.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def one_line(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def unify_lines(c: Column) -> Column:
    """Every kind of line end as a line feed."""
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), ODD_LINE_END, "\n")


def lines_of(c: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    return let(
        F.split(unify_lines(c), "\n"),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def chunk_id(c: Column) -> Column:
    """Content identity: the MD5 of the UTF-8 bytes."""
    return F.md5(c.cast("binary"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_features(toks: Column) -> Column:
    """The tokens followed by their adjacent pairs ``a_b``."""
    def with_pairs(t: Column) -> Column:
        rest = F.size(t) - 1
        pairs = F.zip_with(F.slice(t, 1, rest), F.slice(t, 2, rest), lambda a, b: F.concat(a, F.lit("_"), b))
        return F.when(rest > 0, F.concat(t, pairs)).otherwise(t)

    return let(toks, with_pairs)


def feature_slot(feature: Column, dim: int) -> Column:
    """Vector position of a feature: the first 32 digest bits modulo ``dim``."""
    bits = F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (bits % dim).cast("int")


def feature_sign(feature: Column) -> Column:
    """+1 when digest bits 33-64 form an even number, else -1."""
    last = F.substring(F.md5(feature.cast("binary")), 16, 1)
    return F.when(last.isin(*"02468ace"), F.lit(1)).otherwise(F.lit(-1))


def truncate(c: Column, limit: int) -> Column:
    def cut(flat: Column) -> Column:
        return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(rstrip(F.substring(flat, 1, limit - 1)), F.lit("…")))

    return let(one_line(c), cut)


def norm_key(c: Column) -> Column:
    """Lower snake case; everything but ``a-z``, ``а-я`` and ``_`` is dropped."""
    return F.regexp_replace(F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_")), "[^a-zа-я_]", "")


def parse_time(c: Column) -> Column:
    """Session stamp, ISO, spaced or plain date -> TIMESTAMP_NTZ, else NULL."""
    t = strip(c)
    stamp = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(?:_\d+)?$"
    iso = r"^\d{4}-\d{1,2}-\d{1,2}(?:T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?| \d{1,2}:\d{1,2}:\d{1,2})?$"
    return (
        F.when(t.rlike(stamp), F.regexp_replace(t, stamp, "$1-$2-$3 $4:$5:00"))
        .when(t.rlike(iso), t)
        .try_cast("timestamp_ntz")
    )


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; a leading dot alone is no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def file_kind(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(table, file_suffix(path))


def strip_front_matter(c: Column) -> Column:
    """Body of a stored note: what follows the second ``---``, trimmed."""
    parts = F.split(c, "---", 3)
    return strip(F.when(F.startswith(c, F.lit("---")) & (F.size(parts) == 3), F.try_element_at(parts, F.lit(3))).otherwise(c))


def preview(c: Column, limit: int) -> Column:
    flat = one_line(strip_front_matter(c))
    return F.concat(F.substring(flat, 1, limit), F.when(F.length(flat) > limit, F.lit("…")).otherwise(F.lit("")))


def normalize_ws(c: Column) -> Column:
    """Line ends unified, trailing blanks cut, at most one empty line in a row."""
    cut = F.regexp_replace(unify_lines(c), INLINE_SPACE + r"++\n", "\n")
    return strip(F.regexp_replace(cut, "\n{3,}", "\n\n"))


def normalize_jsonl(c: Column) -> Column:
    return F.array_join(F.filter(lines_of(c), lambda x: strip(x) != ""), "\n")


def front_matter(c: Column) -> Column:
    """Struct ``entries array<key,value>, body`` of a Markdown text.

    The closing ``---`` must stand within the first 50 lines; without it the
    whole text is body. Later entries of a key win, see :func:`meta_value`.
    """
    none = F.array().cast("array<struct<key:string,value:string>>")

    def pair(line: Column) -> Column:
        value = F.substring(line, F.instr(line, ":") + 1, F.length(line))
        return F.struct(F.lower(strip(F.substring_index(line, ":", 1))).alias("key"), strip(value).alias("value"))

    def parsed(rows: Column, end: Column) -> Column:
        has = F.startswith(c, F.lit("---")) & (F.size(rows) >= 2) & (end > 0)
        marked = F.filter(F.slice(rows, 2, F.greatest(end - 1, F.lit(0))), lambda x: F.instr(x, ":") > 0)
        pairs = F.filter(F.transform(marked, pair), lambda p: p["value"] != "")
        body = strip(F.array_join(F.slice(rows, end + 2, F.size(rows)), "\n"))
        return F.struct(F.when(has, pairs).otherwise(none).alias("entries"), F.when(has, body).otherwise(c).alias("body"))

    def with_end(rows: Column) -> Column:
        closing = F.array_position(F.transform(F.slice(rows, 2, 49), strip), "---").cast("int")
        return let(closing, lambda end: parsed(rows, end))

    return let(lines_of(c), with_end)


def meta_raw(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda p: p["key"] == key), F.lit(-1))["value"]


def is_meta_list(value: Column) -> Column:
    return F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]")) & (F.length(value) >= 2)


def meta_value(entries: Column, key: str) -> Column:
    """Scalar value without surrounding quotes, hashes and spaces."""
    v = F.btrim(meta_raw(entries, key), F.lit("\"'# "))
    return F.when(v != "", v)


def meta_list(entries: Column, key: str) -> Column:
    """``[a, b]`` as an array; a scalar counts as the list of its characters."""
    def listed(v: Column) -> Column:
        inner = F.split(F.substring(v, 2, F.length(v) - 2), ",")
        items = F.transform(F.filter(inner, lambda x: strip(x) != ""), lambda x: F.btrim(strip(x), F.lit("\"'#")))
        chars = F.filter(F.split(F.btrim(v, F.lit("\"'# ")), ""), lambda x: x != "")
        return F.when(is_meta_list(v), items).otherwise(chars)

    return F.coalesce(let(meta_raw(entries, key), listed), F.array().cast("array<string>"))


def doc_tags(tags: Column, kind: Column) -> Column:
    """Given tags with ``#``, then ``#source:<kind>`` and ``#doc`` unless present."""
    marked = F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), t)))
    source = F.concat(F.lit("#source:"), kind)
    with_source = F.when(F.array_contains(marked, source), marked).otherwise(F.array_append(marked, source))
    return F.when(F.array_contains(with_source, "#doc"), with_source).otherwise(
        F.array_append(with_source, F.lit("#doc"))
    )


def sanitize_filename(c: Column) -> Column:
    safe = F.regexp_replace(c, r'[<>:"/\\|?* ]', "_")
    return F.btrim(F.substring(F.regexp_replace(safe, "_{2,}", "_"), 1, 80), F.lit("_"))


def render_note(content, tags, project_id, source, agent_id, trust, created_at) -> Column:
    """The stored form of a note: front matter, blank line, content."""
    ascii_only = {"writeNonAsciiCharacterAsCodePoint": "true"}  # tags are stored escaped
    quoted = F.transform(tags, lambda t: F.regexp_extract(F.to_json(F.array(t), ascii_only), r"(?s)^\[(.*)\]$", 1))
    optional = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    header = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("tags: ["), F.array_join(quoted, ", "), F.lit("]")),
        optional("project_id", project_id),
        optional("source", source),
        optional("agent_id", agent_id),
        F.concat(F.lit("trust: "), trust.cast("string")),
        F.concat(F.lit("created_at: "), created_at),
    )
    return F.concat(header, F.lit("\n---\n\n"), content)
