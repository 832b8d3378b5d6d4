"""Registered queries: sources, scalar functions, predicates (S, F, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import formats, html, items, vectors, web
from recollect.functions import text as tx
from recollect.functions.numbers import round4
from recollect.functions import trust as tr
from recollect.operators import chunks as ck
from recollect.operators import embed as em
from recollect.operators.common import number_in_group
from recollect.plans import fixtures as fx
from recollect.plans import oracle as o
from recollect.plans.packaging import docx_bytes, epub_bytes
from recollect.sources import documents as docs
from recollect.sources import files as fs
from recollect.sources import web as ws

SUFFIXES = (".md", ".MARKDOWN", ".txt", ".Text", ".json", ".jsonl", ".csv", ".html", ".HTM", ".pdf",
            ".docx", ".epub", ".png", ".JPG", ".gif", "", ".tar.gz", ".tiff", ".webp", ".bmp")
_sql_suffixes = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
_NL = "chr(10)"


def _doc():
    return F.col("doc_id")


def _text():
    return F.col("text")


def _md5(c):
    return F.md5(c.cast("binary"))


def scan_raw_files(spark, sf):
    files = fs.scan_raw_files(spark, fx.raw_text_files(spark, sf))
    part = F.regexp_extract("path", r"part=(\d+)/[^/]+$", 1).cast("bigint")
    return files.select(part.alias("part"), "kind", "length")


SCAN = f"SELECT doc_id // {fx.DOCS_PER_FILE} AS part, 'text' AS kind, sum(octet_length(encode(text)) + 2)::BIGINT AS length FROM documents GROUP BY 1"


def file_kind(spark, sf):
    names = F.array(*map(F.lit, SUFFIXES))
    d = fx.table(spark, sf, "documents")
    path = F.concat(F.lit("raw/"), "source", F.lit("/v1.2/.f"), _doc().cast("string"),
                    F.element_at(names, (_doc() % len(SUFFIXES) + 1).cast("int")))
    return d.select("doc_id", tx.file_kind(path).alias("kind"))


FILE_KIND = f"""SELECT doc_id, CASE lower({_sql_suffixes}[doc_id % {len(SUFFIXES)} + 1])
  WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.text' THEN 'text'
  WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'jsonl' WHEN '.csv' THEN 'csv' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html'
  WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.epub' THEN 'epub' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image'
  WHEN '.tiff' THEN 'image' WHEN '.webp' THEN 'image' WHEN '.bmp' THEN 'image' END AS kind FROM documents"""


def decode_text(spark, sf):
    ascii_only = F.encode(F.regexp_replace(_text(), r"[^\x00-\x7f]", ""), "UTF-8")
    data = (
        F.when(_doc() % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(_text(), "UTF-8")))
        .when(_doc() % 5 == 1, F.concat(ascii_only, F.unhex(F.lit("E9"))))
        .when(_doc() % 5 == 2, F.concat(ascii_only, F.unhex(F.lit("E998"))))
        .otherwise(F.encode(_text(), "UTF-8"))
    )
    raw = fx.table(spark, sf, "documents").select("doc_id", data.alias("data"))
    return raw.select("doc_id", formats.decode_text(F.col("data")).alias("text"))


DECODE = """WITH d AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') AS ascii FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN chr(65279) || text WHEN 1 THEN ascii || 'й'
  WHEN 2 THEN ascii || 'é' || chr(152) ELSE text END AS text FROM d"""


def norm_json(spark, sf):
    e = fx.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("  "), F.col("props"), F.lit("{ \n"))).otherwise(F.col("props"))
    return e.select("event_id", formats.normalize_json(raw).alias("json"))


NORM_JSON = f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN props || '{{' ELSE
  '{{' || {_NL} || '  "k": ' || json_extract_string(props, '$.k') || {_NL} || '}}' END AS json FROM events"""


def norm_jsonl(spark, sf):
    spread = F.concat(F.lit("\n \n"), F.replace(_text(), F.lit("\n"), F.lit("\n\t\n")), F.lit("\n"))
    return fx.table(spark, sf, "documents").select("doc_id", tx.normalize_jsonl(spread).alias("text"))


NORM_JSONL = f"""SELECT doc_id, array_to_string(list_filter(string_split(text, {_NL}), lambda x: {o.blanks('x')} <> ''), {_NL}) AS text
FROM documents"""


def csv_to_markdown(spark, sf):
    raw = F.replace(F.replace(_text(), F.lit(" "), F.lit(" ,")), F.lit('"'), F.lit("'"))
    return fx.table(spark, sf, "documents").select("doc_id", formats.csv_to_markdown(raw).alias("text"))


CSV = f"""WITH r AS (SELECT doc_id, list_transform(list_filter(string_split(replace(replace(text, ' ', ' ,'), '"', ''''), {_NL}), lambda x: x <> ''),
    lambda x: list_transform(string_split(x, ','), lambda c: {o.blanks('c')})) AS rows FROM documents),
p AS (SELECT doc_id, rows, len(rows[1]) AS w FROM r)
SELECT doc_id, '| ' || array_to_string(rows[1], ' | ') || ' |' || {_NL} || '|' || array_to_string(list_transform(rows[1], lambda c: '---'), '|') || '|'
  || coalesce(array_to_string(list_transform(rows[2:], lambda c: {_NL} || '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: coalesce(c[i], '')), ' | ') || ' |'), ''), '') AS text
FROM p"""


def _unescape(e):
    return (f"replace(replace(replace(replace(regexp_replace({e}, '&(copy|middot|quot);', chr(1) || '\\1' || chr(2), 'g'), "
            f"chr(1) || 'copy' || chr(2), '©'), chr(1) || 'middot' || chr(2), '·'), chr(1) || 'quot' || chr(2), '\"'), '&amp;', '&amp')")


def _tidy(e):
    return o.blanks(f"regexp_replace(regexp_replace({e}, '[ \\t\\r\\f\\v]+\\n', {_NL}, 'g'), '\\n{{3,}}', {_NL} || {_NL}, 'g')")


_DROP = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head.*?</head>', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
_CUT = _DROP
for _tag in ("nav", "footer", "header", "aside", "form", "button"):
    _CUT = f"regexp_replace({_CUT}, '(?is)<{_tag}(\\s[^>]*)?>.*?</{_tag}>', {_NL} || '---' || {_NL} || {_NL} || '---' || {_NL}, 'g')"
MAIN_CONTENT = _tidy(f"replace({_unescape(f'''regexp_replace({_CUT}, '(?s)<[^>]*>', '', 'g')''')}, '&amp', '&')")
_BLOCK = f"regexp_replace(regexp_replace({_DROP}, '(?i)<h1[^>]*>', {_NL} || '# ', 'g'), '(?i)</?(p|div|section|article|li|tr|br|h[1-6]|td|th|blockquote)(\\s[^>]*)?/?>', {_NL}, 'g')"
HTML_TEXT = _tidy(f"replace({_unescape(f'''regexp_replace({_BLOCK}, '(?s)<[^>]*>', '', 'g')''')}, '&amp', '&')")


def html_to_text(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


def html_main_content(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", html.html_main_content(F.col("html")).alias("content"))


def _titles(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


TITLE = "coalesce(nullif(" + o.blanks("regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)") + ", ''), 'Untitled')"


def favicon(spark, sf):
    """Every page, its first navigation link rewritten to an icon address."""
    p = fx.table(spark, sf, "pages")
    page = F.replace(F.col("html"), F.lit('<a href="/'), F.lit('<a href="/favicon-'))
    return p.select("page_id", web.favicon(page, F.col("url")).alias("icon"))


FAVICON = """WITH h AS (SELECT page_id, url, regexp_extract(replace(html, '<a href="/', '<a href="/favicon-'), '(?i)href=["'']([^"'']*favicon[^"'']*)["'']', 1) AS href FROM pages)
SELECT page_id, CASE WHEN href <> '' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS icon FROM h"""


def web_page_report(spark, sf):
    r = ws.page_report(fx.table(spark, sf, "pages"))
    return r.select("page_id", "url", "title", _md5(F.col("content")).alias("content_md5"),
                    F.col("html_length").cast("bigint").alias("html_length"),
                    F.col("content_length").cast("bigint").alias("content_length"))


PAGE_REPORT = f"""SELECT page_id, url, {TITLE} AS title, md5(c) AS content_md5, length(html)::BIGINT AS html_length, length(c)::BIGINT AS content_length
FROM (SELECT *, {MAIN_CONTENT} AS c FROM pages)"""


def page_front_matter(spark, sf):
    r = ws.page_report(fx.table(spark, sf, "pages"))
    stamp = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"))
    project = F.when(F.col("page_id") % 2 == 0, F.lit("web"))
    return ws.saved_pages(r, "page_id", stamp, project).select("page_id", "file", F.col("document"))


_FILENAME = """substr(regexp_replace(regexp_replace(replace(replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '.', '_'), 'www_', '')
  || CASE WHEN path = '' THEN 'index' ELSE rtrim(regexp_replace(path, '[^a-zA-Z0-9_./-]', '_', 'g'), '/') END || '.html', '[<>:"/\\\\|?* ]', '_', 'g'), '_{2,}', '_', 'g'), 1, 150)"""
_NAMED = f"""named AS (SELECT *, {_FILENAME} AS name FROM (SELECT *, trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS n FROM named)"""
_UNIQUE = "CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || n || regexp_extract(name, '\\.[^.]*$') END"
PAGE_FRONT = f"""WITH {_NAMED} SELECT page_id, {_UNIQUE} AS file, '---' || {_NL} || 'source: ' || url || {_NL} || 'title: ' || {TITLE} || {_NL}
  || 'saved_at: 2024-01-01T00:00:' || lpad((page_id % 60)::VARCHAR, 2, '0') || {_NL} || CASE WHEN page_id % 2 = 0 THEN 'project: web' || {_NL} ELSE '' END
  || '---' || {_NL} || {MAIN_CONTENT} AS document FROM numbered"""


def url_filename(spark, sf):
    """File names by site only, so that many pages clash and get numbers."""
    p = fx.table(spark, sf, "pages").select("page_id", "url", web.url_filename(F.col("url")).alias("name"))
    site = F.regexp_replace("url", r"^(\w+://[^/]*/[a-z]*).*$", "$1")
    p = p.withColumn("site_name", web.url_filename(site))
    numbered = number_in_group(p, ["site_name"], "page_id", F.floor(F.col("page_id") / 1000), "n")
    return numbered.select("page_id", "name", web.numbered_name(F.col("site_name"), F.col("n")).alias("unique_name"))


_SITE = """SELECT page_id, regexp_replace(url, '^(\\w+://[^/]*/[a-z]*).*$', '\\1') AS url FROM pages"""
URL_FILENAME = f"""WITH {_NAMED}, spath AS (SELECT *, trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM ({_SITE})),
sites AS (SELECT page_id, {_FILENAME} AS name FROM spath),
snum AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS n FROM sites)
SELECT d.page_id, d.name, s.unique_name FROM named d JOIN (SELECT page_id, {_UNIQUE} AS unique_name FROM snum) s USING (page_id)"""


def extract_docx(spark, sf):
    packed = fx.table(spark, sf, "documents").select("doc_id", docx_bytes(_text()).alias("content"))
    return packed.select("doc_id", docs.extract_docx(F.col("content")).alias("text"))


DOCX = f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, {_NL}), lambda x: {o.blanks('x')}), lambda x: x <> ''), {_NL} || {_NL}) AS text FROM documents"""


def extract_epub(spark, sf):
    packed = fx.table(spark, sf, "pages").select("page_id", epub_bytes(F.col("html")).alias("content"))
    return packed.select("page_id", docs.extract_epub(F.col("content")).alias("text"))


EPUB = f"""SELECT page_id, {HTML_TEXT} || {_NL} || {_NL} || '# end' AS text FROM pages"""


def log_tail(spark, sf):
    e = fx.table(spark, sf, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
                              F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
                              F.col("event_type").alias("msg")))
    broken = F.when(F.col("event_id") % 4 == 1, F.substring(line, 1, 30)).when(F.col("event_id") % 4 == 2, F.lit("  ")).otherwise(line)
    return fs.log_tail(e.select("event_id", broken.alias("line")), "line", "event_id")


LOG_TAIL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS msg
FROM events WHERE event_id % 4 NOT IN (1, 2) ORDER BY event_id DESC LIMIT 10"""

_RAW_NOTE = {
    0: "---\ntags: [x]\n---\n\n", 1: "", 2: "---\ntags: [a---b]\n---\n", 3: "---\nno end",
}


def _raw_note():
    c = F
    for n, head in _RAW_NOTE.items():
        c = c.when(_doc() % 4 == n, F.concat(F.lit(head), _text()))
    return c


_SQL_RAW = "CASE doc_id % 4 " + " ".join(
    f"WHEN {n} THEN '" + h.replace("\n", "' || chr(10) || '") + "' || text" for n, h in _RAW_NOTE.items()) + " END"


def strip_front_matter(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.strip_front_matter(_raw_note()).alias("body"))


STRIP = f"""WITH r AS (SELECT doc_id, {_SQL_RAW} AS raw FROM documents)
SELECT doc_id, {o.blanks("CASE WHEN regexp_matches(raw, '(?s)^---.*---') AND starts_with(raw, '---') THEN regexp_replace(raw, '(?s)^---.*?---', '') ELSE raw END")} AS body FROM r"""


def chunk_preview(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.preview(_raw_note(), 140).alias("preview"))


_FLAT_BODY = o.one_line("CASE WHEN regexp_matches(raw, '(?s)^---.*---') THEN regexp_replace(raw, '(?s)^---.*?---', '') ELSE raw END")
PREVIEW = f"""WITH r AS (SELECT doc_id, {_SQL_RAW} AS raw FROM documents), f AS (SELECT doc_id, {_FLAT_BODY} AS flat FROM r)
SELECT doc_id, substr(flat, 1, 140) || CASE WHEN length(flat) > 140 THEN '…' ELSE '' END AS preview FROM f"""


def chunk_id(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.chunk_id(_text()).alias("chunk_id"))


def tokenize(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", tx.tokens(_text()).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


_TOKS = "regexp_extract_all(lower(text), '[а-яёa-z0-9]+')"
TOKENIZE = f"SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_TOKS} AS t FROM documents)"


def features(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", tx.token_features(tx.tokens(_text())).alias("f"))
    return d.select("doc_id", F.size("f").cast("bigint").alias("n"), _md5(F.array_join("f", " ")).alias("features_md5"))


FEATURES = f"""SELECT doc_id, len(f)::BIGINT AS n, md5(array_to_string(f, ' ')) AS features_md5
FROM (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS f FROM (SELECT doc_id, {_TOKS} AS t FROM documents))"""


def feature_hash(spark, sf):
    d = fx.table(spark, sf, "documents")
    f = d.select(F.explode(tx.token_features(tx.tokens(_text()))).alias("feature")).distinct()
    return f.select("feature", tx.feature_slot(F.col("feature"), 512).cast("bigint").alias("idx"), tx.feature_sign(F.col("feature")).cast("bigint").alias("sign"))


FEATURE_HASH = f"""WITH t AS (SELECT {_TOKS} AS t FROM documents),
f AS (SELECT DISTINCT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS feature FROM t)
SELECT feature, ('0x' || substr(md5(feature), 1, 8))::BIGINT % 512 AS idx,
  CASE WHEN ('0x' || substr(md5(feature), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS sign FROM f"""


def embed(spark, sf):
    chunks = ck.deduplicate(fx.notes(spark, sf), ["content"])
    return em.rounded_weights(em.embedding_weights(chunks))


def embed_dense(spark, sf):
    """The Arrow form of the same vectors, as the index keeps them."""
    index = em.with_vectors(ck.deduplicate(fx.notes(spark, sf)))
    return index.select("chunk_id", F.posexplode("vec").alias("idx", "w")).where(F.col("w") != 0)


EMBED = f"WITH {o.CHUNKS}, {o.weights('chunks', 'chunk_id', 'content', 'w')} SELECT chunk_id, idx, w FROM w WHERE w <> 0"


def vector_cosine(spark, sf):
    """Each embedding against its label's first vector."""
    e = fx.table(spark, sf, "embeddings")
    base = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return e.join(base, "label").select("vec_id", round4(vectors.dot(F.col("embedding"), F.col("base"))).alias("cosine"))


COSINE = f"""SELECT vec_id, CASE WHEN c < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * {o.round4('a')} AS cosine FROM (SELECT *, abs(c) AS a FROM (
SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS c
FROM embeddings e JOIN (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)))"""

# The forms of source every rule needs; a page supplies the variable part.
SOURCE_FORMS = ("%", "https://docs.python.org/%", "https://example.gov/p", "https://en.wikipedia.org/wiki/X", "www.github.com/a",
                "https://user@github.com:443/a", "ROADMAP.md", "docs/a.bin", "note", "  ", "sessions/a.bin", "www.", "http://notpython.org/")


def _sources(spark, sf):
    forms = F.array(*map(F.lit, SOURCE_FORMS))
    p = fx.table(spark, sf, "pages")
    form = F.element_at(forms, (F.col("page_id") % len(SOURCE_FORMS) + 1).cast("int"))
    return p.select("page_id", F.replace(form, F.lit("%"), F.col("url")).alias("source"))


_SQL_SOURCES = "src AS (SELECT page_id, replace([" + ", ".join(f"'{s}'" for s in SOURCE_FORMS) + f"][page_id % {len(SOURCE_FORMS)} + 1], '%', url) AS source FROM pages)"
_HOST = "lower(trim(split_part(list_last(string_split(regexp_extract(CASE WHEN contains(s, '://') THEN s ELSE 'http://' || s END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@')), ':', 1), '.'))"
_HOSTS = f"host AS (SELECT page_id, s, {_HOST} AS host FROM (SELECT page_id, trim(source) AS s FROM src))"
_TRUSTED = ("(regexp_matches(host, '\\.(gov|edu|mil)$') OR list_contains(['docs', 'developer', 'developers', 'learn', 'api', 'help'], split_part(host, '.', 1))"
            " OR len(list_filter(['wikipedia.org', 'python.org', 'mozilla.org', 'microsoft.com', 'arxiv.org', 'github.com', 'oracle.com', 'redhat.com'],"
            " lambda d: host = d OR ends_with(host, '.' || d))) > 0)")


def source_trust(spark, sf):
    return _sources(spark, sf).select("page_id", tr.source_trust(F.col("source")).alias("trust"))


TRUST = f"""WITH {_SQL_SOURCES}, {_HOSTS} SELECT page_id, CASE WHEN s = '' THEN 0.5
  WHEN contains(s, '://') OR starts_with(lower(s), 'www.') THEN CASE WHEN host = '' THEN 0.5 WHEN {_TRUSTED} THEN 1.0 ELSE 0.4 END
  WHEN regexp_matches(lower(s), '\\.(md|txt|rst|adoc)$') OR contains(lower(s), 'docs') OR starts_with(lower(s), 'sessions') THEN 0.8 ELSE 0.5 END::DOUBLE AS trust FROM host"""


def url_host(spark, sf):
    return _sources(spark, sf).select("page_id", tr.url_host(F.col("source")).alias("host"))


def trusted_domain(spark, sf):
    return _sources(spark, sf).select("page_id", tr.trusted_domain(tr.url_host(F.col("source"))).alias("trusted"))


def clamp_trust(spark, sf):
    e = fx.table(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit("high")).when(F.col("event_id") % 7 == 1, F.lit(None)).otherwise(
        ((F.col("event_id") % 40) - 10).cast("string"))
    scaled = F.when(F.col("event_id") % 7 > 3, F.concat(F.lit("0."), (F.col("event_id") % 90 + 10).cast("string"))).otherwise(value)
    return e.select("event_id", tr.clamp_trust(scaled).alias("trust"))


CLAMP = """SELECT event_id, greatest(0.0, least(1.0, coalesce(try_cast(v AS DOUBLE), 0.5))) AS trust FROM (
  SELECT event_id, CASE WHEN event_id % 7 > 3 THEN '0.' || (event_id % 90 + 10) WHEN event_id % 7 = 0 THEN 'high' WHEN event_id % 7 = 1 THEN NULL
    ELSE ((event_id % 40) - 10)::VARCHAR END AS v FROM events)"""


def truncate_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.truncate(_text(), 300).alias("text"))


TRUNCATE = f"SELECT doc_id, {o.truncate('text', 300)} AS text FROM documents"


def norm_key(spark, sf):
    key = F.concat(F.lit(" Ключ Ё "), F.substring("text", 1, 60), F.lit(" 42 "))
    return fx.table(spark, sf, "documents").select("doc_id", tx.norm_key(key).alias("key"))


NORM_KEY = f"""SELECT doc_id, regexp_replace(replace({o.blanks("lower(' Ключ Ё ' || substr(text, 1, 60) || ' 42 ')")}, ' ', '_'), '[^a-zа-я_]', '', 'g') AS key FROM documents"""


def dialog_items(spark, sf):
    """The recursive item extraction over each turn's JSON."""
    c = fx.table(spark, sf, "conversations")
    turn = F.struct("role", F.struct("text").alias("meta"), F.col("text").alias("content"))
    doc = F.to_json(F.struct(F.array(turn).alias("chat_history"), F.struct((F.col("turn") + 1).alias("k"), F.col("role").alias("r")).alias("extra")))
    e = c.select("conv_id", "turn", F.explode(items.session_items(doc)).alias("i"))
    return e.select("conv_id", "turn", F.col("i.raw_key").alias("raw_key"), F.col("i.item").alias("item"))


DIALOG = f"""SELECT conv_id, turn, 'chat_history' AS raw_key, '[' || role || '] ' || {o.blanks('text')} AS item FROM conversations
UNION ALL SELECT conv_id, turn, 'extra', 'k: ' || (turn + 1) || '; r: ' || role FROM conversations"""

TIME_FORMS = ("yyyyMMdd_HHmm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_time(spark, sf):
    e, i = fx.table(spark, sf, "events"), F.col("event_id") % 9
    text = F
    for n, form in enumerate(TIME_FORMS):
        text = text.when(i == n, F.date_format("ts", form))
    text = (text.when(i == 5, F.concat(F.date_format("ts", "yyyyMMdd_HHmm"), F.lit("_10")))
            .when(i == 6, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(i == 7, F.lit("  ")))
    return e.select("event_id", F.date_format(tx.parse_time(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


PARSE_TIME = """SELECT event_id, strftime(CASE event_id % 9 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN ts
  WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('day', ts)::TIMESTAMP WHEN 5 THEN date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events"""

_FM_HEAD = "---\nTags: [ '#a', b ,, \"c\"]\nProject: \"proj one\"\nempty:\nno colon\nsource: # x:y #\ntags: [z"


def front_matter(spark, sf):
    """Header present; closing line missing; closing line too far down."""
    tail = F.when(_doc() % 3 == 0, F.lit("]\n --- \n")).when(_doc() % 3 == 1, F.lit("]\n")).otherwise(F.lit("]\n" + "k: v\n" * 60 + "---\n"))
    raw = F.concat(F.lit(_FM_HEAD), _doc().cast("string"), tail, tx.strip(_text()))
    fm = fx.table(spark, sf, "documents").select("doc_id", tx.front_matter(raw).alias("m"))
    entries = F.col("m")["entries"]
    return fm.select(
        "doc_id", F.array_join(tx.meta_list(entries, "tags"), "|").alias("tags"), tx.meta_value(entries, "project").alias("project"),
        tx.meta_value(entries, "source").alias("source"), _md5(F.col("m")["body"]).alias("body_md5"))


FRONT = f"""WITH r AS (SELECT doc_id, {o.blanks('text')} AS body, '{_FM_HEAD.replace("'", "''").replace(chr(10), "' || chr(10) || '")}' || doc_id || ']' || {_NL} AS head FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'z' || doc_id ELSE '' END AS tags, CASE WHEN doc_id % 3 = 0 THEN 'proj one' END AS project,
  CASE WHEN doc_id % 3 = 0 THEN 'x:y' END AS source,
  md5(CASE doc_id % 3 WHEN 0 THEN body WHEN 1 THEN head || body ELSE head || repeat('k: v' || {_NL}, 60) || '---' || {_NL} || body END) AS body_md5 FROM r"""


def doc_tags(spark, sf):
    given = F.when(_doc() % 3 == 0, F.array(F.lit("a"), F.lit("#b"))).when(_doc() % 3 == 1, F.array(F.lit("doc"), F.concat(F.lit("lang_"), "lang"))).otherwise(
        F.array(F.lit("#source:text")))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(tx.doc_tags(given, F.lit("text")), ",").alias("tags"))


DOC_TAGS = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '#a,#b,#source:text,#doc' WHEN 1 THEN '#doc,#lang_' || lang || ',#source:text' ELSE '#source:text,#doc' END AS tags FROM documents"""


def sanitize_filename(spark, sf):
    name = F.concat(F.lit("_ "), F.substring("text", 1, 200), F.lit('?:|"'))
    return fx.table(spark, sf, "documents").select("doc_id", tx.sanitize_filename(name).alias("name"))


SANITIZE = """SELECT doc_id, trim(substr(regexp_replace(regexp_replace('_ ' || substr(text, 1, 200) || '?:|"', '[<>:"/\\\\|?* ]', '_', 'g'), '_{2,}', '_', 'g'), 1, 80), '_') AS name FROM documents"""


def normalize_ws(spark, sf):
    raw = F.concat(F.lit("\n "), F.replace(F.replace(_text(), F.lit("\n"), F.lit(" \t\r\n\n\n\n")), F.lit(". "), F.lit(".  \n")))
    return fx.table(spark, sf, "documents").select("doc_id", tx.normalize_ws(raw).alias("text"))


NORM_WS = f"""SELECT doc_id, {o.blanks(f"regexp_replace(regexp_replace(replace(replace(text, {_NL}, {_NL} || {_NL} || {_NL} || {_NL}), '. ', '.' || {_NL}), '[ \\t]+\\n', {_NL}, 'g'), '\\n{{3,}}', {_NL} || {_NL}, 'g')")} AS text FROM documents"""

QUERIES = {
    "scan_raw_files": (scan_raw_files, SCAN),
    "file_kind": (file_kind, FILE_KIND),
    "decode_text": (decode_text, DECODE),
    "norm_json": (norm_json, NORM_JSON),
    "norm_jsonl": (norm_jsonl, NORM_JSONL),
    "csv_to_markdown": (csv_to_markdown, CSV),
    "html_to_text": (html_to_text, f"SELECT page_id, {HTML_TEXT} AS text FROM pages"),
    "extract_docx": (extract_docx, DOCX),
    "extract_epub": (extract_epub, EPUB),
    "web_page_report": (web_page_report, PAGE_REPORT),
    "page_front_matter": (page_front_matter, PAGE_FRONT),
    "log_tail": (log_tail, LOG_TAIL),
    "strip_front_matter": (strip_front_matter, STRIP),
    "chunk_id": (chunk_id, "SELECT doc_id, md5(text) AS chunk_id FROM documents"),
    "tokenize": (tokenize, TOKENIZE),
    "features": (features, FEATURES),
    "feature_hash": (feature_hash, FEATURE_HASH),
    "embed": (embed, EMBED),
    "embed_dense": (embed_dense, EMBED),
    "vector_cosine": (vector_cosine, COSINE),
    "source_trust": (source_trust, TRUST),
    "url_host": (url_host, f"WITH {_SQL_SOURCES}, {_HOSTS} SELECT page_id, host FROM host"),
    "trusted_domain": (trusted_domain, f"WITH {_SQL_SOURCES}, {_HOSTS} SELECT page_id, {_TRUSTED} AS trusted FROM host"),
    "clamp_trust": (clamp_trust, CLAMP),
    "truncate_text": (truncate_text, TRUNCATE),
    "norm_key": (norm_key, NORM_KEY),
    "dialog_items": (dialog_items, DIALOG),
    "parse_time": (parse_time, PARSE_TIME),
    "front_matter": (front_matter, FRONT),
    "doc_tags": (doc_tags, DOC_TAGS),
    "sanitize_filename": (sanitize_filename, SANITIZE),
    "url_filename": (url_filename, URL_FILENAME),
    "html_main_content": (html_main_content, f"SELECT page_id, {MAIN_CONTENT} AS content FROM pages"),
    "html_title": (_titles, f"SELECT page_id, {TITLE} AS title FROM pages"),
    "favicon": (favicon, FAVICON),
    "normalize_ws": (normalize_ws, NORM_WS),
    "chunk_preview": (chunk_preview, PREVIEW),
}
