"""Registered queries: the note store, ranking, chunking and ingestion (S15, P, R, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.vectors import EMBEDDER
from recollect.operators import chunking as cg
from recollect.operators import chunks as ck
from recollect.operators import embed as em
from recollect.operators import search as se
from recollect.operators.index import VectorIndex
from recollect.operators.keyword_index import KeywordIndex
from recollect.operators.result_cache import ResultCache
from recollect.plans import fixtures as fx
from recollect.plans import oracle as o
from recollect.session import work_dir
from recollect.settings import DEFAULTS

_NL = "chr(10)"
QUERY = "of the"
TOP = 10


def _chunks(spark, sf, columns=ck.NOTE_COLUMNS):
    return ck.deduplicate(fx.notes(spark, sf), columns)


_KEPT: dict[tuple, str] = {}


def _kept(spark, sf, kind):
    """An index of this application's notes: made once, then opened and brought up to date by each query."""
    key = (spark.sparkContext.applicationId, sf, kind)
    index = kind(spark, _KEPT.setdefault(key, work_dir(spark, "index")))
    index.sync(fx.notes(spark, sf))
    return index


def _kept_index(spark, sf) -> VectorIndex:
    return _kept(spark, sf, VectorIndex)


def chunk_dedup(spark, sf):
    kept = _chunks(spark, sf, ["project_id", "agent_id", "source", "trust", "created_at"])
    return kept.select("chunk_id", "seq", "project_id", "agent_id", "source", "trust", "created_at")


def chunk_insert(spark, sf):
    """Insert of all notes into a store that already holds the labelled documents."""
    notes = fx.notes(spark, sf)
    held = notes.join(fx.table(spark, sf, "labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi")
    return ck.new_chunks(notes, held.select("chunk_id"), ["project_id"])


CHUNK_INSERT = f"""WITH {o.CHUNKS} SELECT chunk_id, seq, project_id FROM chunks
WHERE chunk_id NOT IN (SELECT chunk_id FROM notes WHERE seq IN (SELECT doc_id FROM labels))"""


def tag_index(spark, sf):
    return ck.tag_index(fx.notes(spark, sf))


def _listed(df):
    return df.select("seq", "chunk_id", "project_id", "agent_id")


def filter_tags_all(spark, sf):
    return _listed(ck.scope(_chunks(spark, sf, ["tags", "project_id", "agent_id"]), tags=["#lang_de", "#doc"]))


def filter_project(spark, sf):
    return _listed(ck.scope(_chunks(spark, sf, ["project_id", "agent_id"]), project_id="src7"))


def filter_agent_visibility(spark, sf):
    return _listed(ck.scope(_chunks(spark, sf, ["project_id", "agent_id"]), agent_id="agent_2"))


_FILTER = f"WITH {o.CHUNKS} SELECT seq, chunk_id, project_id, agent_id FROM chunks WHERE "


def keyword_search(spark, sf):
    return _listed(_kept(spark, sf, KeywordIndex).search("Er The")).orderBy("seq")


def keyword_search_scan(spark, sf):
    """The same without an index: one scan."""
    return _listed(ck.keyword_search(_chunks(spark, sf), "Er The")).orderBy("seq")


def keyword_candidates(spark, sf):
    """How many notes of each language the postings leave to be tested for a needle, and how many have it."""
    index = _kept(spark, sf, KeywordIndex)
    lang = F.element_at("tags", -1)
    tested = index.rows().join(index.candidates("er the"), "seq", "left_semi")
    found = F.contains(F.lower(ck.rendered(tested)), F.lit("er the"))
    return tested.groupBy(lang.alias("lang")).agg(F.count("*").alias("tested"), F.count_if(found).alias("found"))


_GRAMS = ("er ", "r t", " th", "the")


def keyword_search_header(spark, sf):
    """A term that only front matter holds, within an agent's view."""
    return _listed(_kept(spark, sf, KeywordIndex).search("NOTES/1", agent_id="agent_3")).orderBy("seq")


def keyword_search_empty(spark, sf):
    return _listed(_kept(spark, sf, KeywordIndex).search("", tags=["#lang_fr"])).orderBy("seq")


def index_sync_stats(spark, sf):
    """An index over the labelled documents, partly of an older embedder, and over texts the store lacks."""
    notes = _chunks(spark, sf)
    labels = fx.table(spark, sf, "labels").join(
        fx.notes(spark, sf).select(F.col("seq").alias("doc_id"), "chunk_id"), "doc_id")
    known = labels.groupBy("chunk_id").agg(F.max("toxic").alias("old"))
    stale = fx.table(spark, sf, "benchmark").select(tx.chunk_id(F.col("text")).alias("chunk_id"), F.lit(0).alias("old")).distinct()
    index = known.unionByName(stale).select(
        "chunk_id", F.when(F.col("old") == 1, "other").otherwise(EMBEDDER).alias("embedder"), F.lit(DEFAULTS.semantic.dim).alias("dim"))
    return em.sync_stats(index, notes)


SYNC = f"""WITH {o.CHUNKS}, idx AS (
  SELECT n.chunk_id, max(toxic) AS old FROM labels l JOIN notes n ON n.seq = l.doc_id GROUP BY 1
  UNION ALL SELECT DISTINCT md5(text), 0 FROM benchmark),
j AS (SELECT i.old = 0 AS usable, c.chunk_id IS NOT NULL AS here, coalesce(regexp_matches(lower(c.content), '[а-яёa-z0-9]'), false) AS ok, i.chunk_id IS NOT NULL AS known
  FROM idx i FULL JOIN chunks c ON c.chunk_id = i.chunk_id)
SELECT count(*) FILTER (coalesce(usable, false) AND here OR here AND NOT coalesce(usable, false) AND ok) AS total,
  count(*) FILTER (here AND NOT coalesce(usable, false) AND ok) AS added,
  count(*) FILTER (coalesce(usable, false) AND NOT here) AS removed,
  coalesce(bool_or(known AND NOT usable), false) AS rebuilt FROM j"""


def _synced_index(spark, sf):
    """Three syncs: labelled documents by an older embedder; those of good quality by today's; then all but the toxic ones."""
    notes, labels = fx.notes(spark, sf), fx.table(spark, sf, "labels")
    path = work_dir(spark, "index")
    flagged, chosen = notes.select("chunk_id", "seq").join(labels.select(F.col("doc_id").alias("seq"), "quality", "toxic"), "seq", "left"), work_dir(spark, "flagged")
    flagged.write.parquet(chosen)
    flagged = spark.read.schema(flagged.schema).parquet(chosen)
    states = ("quality is not null", "quality = 1", "coalesce(toxic, 0) = 0")
    log = []
    for name, state in zip(("older", EMBEDDER, EMBEDDER), states):
        index = VectorIndex(spark, path, name=name)
        log.append(index.sync(notes, flagged.where(state)))
    return index, log


def index_sync(spark, sf):
    """The index after added, removed and re-embedded notes."""
    rows = _synced_index(spark, sf)[0].rows()
    slots = F.filter(F.transform("vec", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return rows.select(
        "chunk_id", "seq", "embedder", "project_id", F.size(slots).cast("bigint").alias("slots"),
        F.aggregate(slots, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("slot_sum"))


_SYNC_STATES = ("quality IS NOT NULL", "quality = 1", "coalesce(toxic, 0) = 0")
_FLAGGED = f"{o.NOTES}, flagged AS (SELECT n.*, quality, toxic FROM notes n LEFT JOIN labels l ON l.doc_id = n.seq)"
INDEX_SYNC = f"""WITH {_FLAGGED}, kept AS (SELECT * FROM flagged WHERE {_SYNC_STATES[2]} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq) = 1),
{o.weights('kept', 'chunk_id', 'content', 'w')}
SELECT chunk_id, seq, '{EMBEDDER}' AS embedder, project_id, count(*) AS slots, sum(idx)::BIGINT AS slot_sum FROM kept JOIN w USING (chunk_id) WHERE w <> 0 GROUP BY ALL"""


def index_sync_log(spark, sf):
    """What each of the three syncs did."""
    log = _synced_index(spark, sf)[1]
    rows = [(i, s.total, s.added, s.removed, s.rebuilt) for i, s in enumerate(log)]
    return spark.createDataFrame(rows, "sync bigint, total bigint, added bigint, removed bigint, rebuilt boolean")


_STATE = ", ".join(f"""s{i} AS (SELECT chunk_id, min(seq) AS seq FROM flagged WHERE {state} AND regexp_matches(lower(content), '[а-яёa-z0-9]') GROUP BY 1)""" for i, state in enumerate(_SYNC_STATES))
_SIZE = "(SELECT count(*) FROM s{})"
INDEX_SYNC_LOG = f"""WITH {_FLAGGED}, {_STATE}
SELECT 0 AS sync, {_SIZE.format(0)} AS total, {_SIZE.format(0)} AS added, 0 AS removed, false AS rebuilt
UNION ALL SELECT 1, {_SIZE.format(1)}, {_SIZE.format(1)}, 0, true
UNION ALL SELECT 2, {_SIZE.format(2)}, (SELECT count(*) FROM s2 ANTI JOIN s1 USING (chunk_id, seq)), (SELECT count(*) FROM s1 ANTI JOIN s2 USING (chunk_id, seq)), false"""


def index_version(spark, sf):
    return em.index_version(_chunks(spark, sf, []))


_half = lambda start: f"coalesce(sum(('0x' || substr(chunk_id, {start}, 12))::UBIGINT::HUGEINT), 0)::VARCHAR"
VERSION = f"WITH {o.CHUNKS} SELECT substr(md5(concat_ws(',', count(*)::VARCHAR, {_half(1)}, {_half(13)})), 1, 12) AS version FROM chunks"


def _hits(df):
    return df.select("seq", "chunk_id", "project_id", "cosine", "keyword_hit", "score")


_HITS = "SELECT seq, chunk_id, project_id, cosine, keyword_hit, score FROM hits"


def semantic_search(spark, sf):
    return _hits(_kept_index(spark, sf).search(QUERY, TOP))


def semantic_search_vector(spark, sf):
    return _hits(_kept_index(spark, sf).search(QUERY, TOP, hybrid=False))


def semantic_search_hybrid(spark, sf):
    """Bonus without damping."""
    index = _kept_index(spark, sf)
    return _hits(VectorIndex(spark, index.path, DEFAULTS.overlay({"trust": {"weight": 0.0}})).search(QUERY, TOP))


def semantic_search_scoped(spark, sf):
    """All three filters, taken before anything is embedded."""
    return _hits(se.search_inline(_chunks(spark, sf), QUERY, ["#lang_en"], "src5", "agent_1", top_k=3))


SCOPED = o.ranking(QUERY, 3, where="list_contains(tags, '#lang_en') AND project_id = 'src5'")


def related_chunks(spark, sf):
    """Neighbours of the first stored note."""
    index = _kept_index(spark, sf).rows()
    first = fx.notes(spark, sf).agg(F.min_by("chunk_id", "seq")).first()[0]
    return se.related(index, first, TOP).select("seq", "chunk_id", "score")


RELATED = f"""WITH {o.CHUNKS}, {o.weights('chunks', 'chunk_id', 'content', 'w')}, base AS (SELECT idx, w FROM w WHERE chunk_id = (SELECT min_by(chunk_id, seq) FROM notes))
SELECT seq, chunk_id, {o.round4('c')} AS score FROM (
  SELECT chunk_id, sum(w.w * base.w) AS c FROM w JOIN base USING (idx) WHERE chunk_id <> (SELECT min_by(chunk_id, seq) FROM notes) GROUP BY 1) JOIN chunks USING (chunk_id)
WHERE c > 0 ORDER BY score DESC, seq LIMIT {TOP}"""


def related_embeddings(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return se.related(e, 0, TOP, "vec_id", "embedding", "vec_id").select("vec_id", "label", "score")


RELATED_EMB = f"""SELECT e.vec_id, e.label, {o.round4('c')} AS score FROM (
  SELECT e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS c
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE e.vec_id <> 0) e WHERE c > 0 ORDER BY score DESC, vec_id LIMIT {TOP}"""


def context_prompt(spark, sf):
    block = _kept_index(spark, sf).context_prompt(QUERY)
    return block.select("text", F.array_join("chunks", ",").alias("chunks"), F.col("chars").cast("bigint").alias("chars"))


_HEADER = se.PROMPT_HEADER.format(query=QUERY)
PROMPT = f"""WITH {o.ranking(QUERY, 5)},
e AS (SELECT rank, chunk_id, {o.blanks('content')} AS body, '[' || rank || '] score=' || printf('%.3f', score) || ' | project: ' || coalesce(project_id, 'general')
  || ' | tags: ' || array_to_string(tags, ', ') || {_NL} AS title, (1800 - {len(_HEADER) + 1}) // (SELECT count(*) FROM hits) AS per FROM hits),
b AS (SELECT '{_HEADER}' || {_NL} || {_NL} || {o.blanks(f"string_agg(title || substr(body, 1, per - length(title) - 1) || {_NL}, {_NL} ORDER BY rank)")} AS text,
  string_agg(chunk_id, ',' ORDER BY rank) AS chunks FROM e)
SELECT {o.cut('text', 1800, 1800)} AS text, chunks, length({o.cut('text', 1800, 1800)})::BIGINT AS chars FROM b"""


def semantic_search_batch(spark, sf):
    hits = se.semantic_search_batch(_kept_index(spark, sf).rows(), fx.table(spark, sf, "benchmark"), "item_id", "text", 5)
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score")


def semantic_search_cached(spark, sf):
    """The batch once more, half of its queries answered before: their results come from the cache."""
    index, queries = _kept_index(spark, sf), fx.table(spark, sf, "benchmark")
    cache = ResultCache(spark, work_dir(spark, "results"), 1 << 20)
    cache.search_batch(index, queries.where("item_id % 2 = 0"), "item_id", "text", 5)
    hits = cache.search_batch(index, queries, "item_id", "text", 5)
    return hits.select(F.col("query_id").alias("item_id"), "cached", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score")


BATCH = f"""WITH {o.CHUNKS}, {o.weights('chunks', 'chunk_id', 'content', 'w')}, {o.weights('benchmark', 'item_id', 'text', 'qw', None)},
cos AS (SELECT item_id, chunk_id, sum(w.w * qw.w) AS c FROM w JOIN qw USING (idx) GROUP BY ALL HAVING sum(w.w * qw.w) > 0),
scored AS (SELECT item_id, k.*, {o.round4('c')} AS cosine, contains(lower({o.blanks('content')}), lower({o.blanks('b.text')})) AS hit
  FROM cos JOIN chunks k USING (chunk_id) JOIN benchmark b USING (item_id)),
raised AS (SELECT *, cosine + CASE WHEN hit AND row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, seq) <= 20 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS r FROM scored),
bonus AS (SELECT *, {o.round4('r')} AS hybrid FROM raised),
damp AS (SELECT *, hybrid * (0.75::DOUBLE + 0.25::DOUBLE * trust::DOUBLE) AS d FROM bonus),
final AS (SELECT *, {o.round4('d')} AS score FROM damp)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, hybrid DESC, cosine DESC, seq) AS rank, chunk_id, score
FROM final QUALIFY rank <= 5"""


# --- chunking -----------------------------------------------------------------

def _exploded(df, chunks):
    return df.select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).select("doc_id", "pos", "chunk")


def chunk_plain(spark, sf):
    return _exploded(fx.table(spark, sf, "documents"), cg.chunk_plain(F.col("text")))


def chunk_plain_packed(spark, sf):
    """Every line a paragraph, so that packing has work."""
    return _exploded(fx.table(spark, sf, "documents"), cg.chunk_plain(F.replace("text", F.lit("\n"), F.lit("\n \n"))))


def _plain_sql(text):
    parts = f"list_filter(list_transform(string_split(regexp_replace({text}, '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: {o.blanks('x')}), lambda x: x <> '')"
    return f"""SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INTEGER AS pos, unnest(c) AS chunk
FROM (SELECT doc_id, {o.pack(parts, _NL + ' || ' + _NL, 1200)} AS c FROM documents)"""


_SPACED = F"replace(text, {_NL}, {_NL} || ' ' || {_NL})"


def _markdown():
    """A heading before every third line, levels 1 to 7 (7 is no heading)."""
    lines = F.split("text", "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.when(
        i % 3 == 2, F.concat(F.repeat(F.lit("#"), (i % 7 + 1).cast("int")), F.lit(" part "), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x)), "\n")


_SQL_MARKDOWN = f"""array_to_string(list_transform(string_split(text, {_NL}), lambda x, i: CASE WHEN i % 3 = 0
  THEN repeat('#', ((i - 1) % 7 + 1)::INTEGER) || ' part ' || i || {_NL} || x ELSE x END), {_NL})"""


def chunk_markdown(spark, sf):
    return _exploded(fx.table(spark, sf, "documents"), cg.chunk_markdown(_markdown()))


def _markdown_sql(text):
    sections = f"list_transform(string_split(regexp_replace({_NL} || {text}, '\\n(#{{1,6}}[ \\t])', chr(1) || '\\1', 'g'), chr(1)), lambda x, i: CASE WHEN i = 1 THEN substr(x, 2) ELSE x END)"
    packed = o.pack(f"string_split(s, {_NL})", _NL, 1200)
    return f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS pos, chunk FROM (
  SELECT doc_id, i, unnest(range(1, len(c) + 1)) AS j, {o.blanks('unnest(c)')} AS chunk FROM (
    SELECT doc_id, i, CASE WHEN length({o.blanks('s')}) <= 1200 THEN [{o.blanks('s')}] ELSE {packed} END AS c FROM (
      SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS s FROM (SELECT doc_id, {sections} AS x FROM documents)))) WHERE chunk <> ''"""


def _kind():
    return F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("text")


def chunk_dispatch(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, _markdown()).otherwise(F.replace("text", F.lit("\n"), F.lit("\n \n")))
    d = fx.table(spark, sf, "documents").select("doc_id", text.alias("body"), _kind().alias("kind"))
    return _exploded(d, cg.chunks_of(F.col("body"), F.col("kind")))


DISPATCH = f"""SELECT * FROM ({_markdown_sql(_SQL_MARKDOWN)}) WHERE doc_id % 2 = 0
UNION ALL SELECT * FROM ({_plain_sql(_SPACED)}) WHERE doc_id % 2 = 1"""

_EXT = (".md", ".txt", ".jsonl", ".gif", ".md", ".txt")
_FRONT = "---\ntags: [doc, extra]\nproject: alpha\nsource: https://docs.python.org/3/\n---\n"


def _ingested(spark, sf):
    """Documents as raw files of six sorts: front matter, plain, lines, unsupported, headings, blank."""
    d, n = fx.table(spark, sf, "documents"), F.col("doc_id") % 6
    raw = (
        F.when(n == 0, F.concat(F.lit(_FRONT), _markdown()))
        .when(n == 1, F.replace("text", F.lit("\n"), F.lit("\n \n")))
        .when(n == 4, _markdown()).when(n == 5, F.lit(" \n\t ")).otherwise(F.col("text"))
    )
    path = F.concat(F.lit("input/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, _EXT)), (n + 1).cast("int")))
    return cg.ingest(d.select("doc_id", path.alias("path"), raw.alias("raw")))


def ingest_documents(spark, sf):
    done = _ingested(spark, sf)
    return done.select(
        "doc_id", "path", "kind", "status", "reason", F.array_join("tags", ",").alias("tags"), "project_id",
        F.when(F.col("status") == "ingested", F.col("source")).alias("source"), F.size("chunks").cast("bigint").alias("chunks"),
        F.md5(F.array_join("chunks", "|").cast("binary")).alias("chunks_md5"))


INGEST = f"""WITH md AS ({_markdown_sql(_SQL_MARKDOWN)}), pl AS ({_plain_sql(_SPACED)}),
ch AS (SELECT doc_id, pos, chunk FROM md WHERE doc_id % 6 IN (0, 4) UNION ALL SELECT doc_id, pos, chunk FROM pl WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, 0, array_to_string(list_filter(string_split(text, {_NL}), lambda x: {o.blanks('x')} <> ''), {_NL}) FROM documents WHERE doc_id % 6 = 2),
ag AS (SELECT doc_id, count(*) AS n, string_agg({o.blanks('chunk')}, '|' ORDER BY pos) AS t FROM ch WHERE {o.blanks('chunk')} <> '' GROUP BY 1)
SELECT doc_id, 'input/' || doc_id || {list(_EXT)}[doc_id % 6 + 1] AS path,
  ['markdown', 'text', 'jsonl', 'unknown', 'markdown', 'text'][doc_id % 6 + 1] AS kind,
  CASE WHEN doc_id % 6 = 3 THEN 'skipped' WHEN doc_id % 6 = 5 OR n IS NULL THEN 'error' ELSE 'ingested' END AS status,
  CASE WHEN doc_id % 6 = 3 THEN 'unsupported format .gif' WHEN doc_id % 6 = 5 THEN 'empty content' WHEN n IS NULL THEN 'no chunks produced' END AS reason,
  CASE WHEN n IS NOT NULL THEN CASE doc_id % 6 WHEN 0 THEN '#doc,#extra,#source:markdown' WHEN 1 THEN '#source:text,#doc' WHEN 2 THEN '#source:jsonl,#doc' WHEN 4 THEN '#source:markdown,#doc' END END AS tags,
  CASE WHEN doc_id % 6 = 0 THEN 'alpha' END AS project_id,
  CASE WHEN n IS NOT NULL THEN CASE WHEN doc_id % 6 = 0 THEN 'https://docs.python.org/3/' ELSE 'input/' || doc_id || {list(_EXT)}[doc_id % 6 + 1] END END AS source,
  coalesce(n, 0)::BIGINT AS chunks, md5(coalesce(t, '')) AS chunks_md5 FROM documents LEFT JOIN ag USING (doc_id)"""


def ingest_report(spark, sf):
    return cg.ingest_report(_ingested(spark, sf))


REPORT = f"""SELECT count(*) AS scanned, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'error') AS errors FROM ({INGEST})"""


def since_filter(spark, sf):
    d = fx.decisions(spark, sf)
    late = F.when(F.col("seq") % 50 == 0, F.lit("unknown")).otherwise(F.col("recorded_at"))
    bound = tx.parse_time(F.lit("20240115_1200"))
    return d.where(ck.since(tx.parse_time(late), bound)).select("seq", "recorded_at")


def since_unknown(spark, sf):
    """A bound that does not parse lets everything pass."""
    d = fx.decisions(spark, sf)
    return d.where(ck.since(tx.parse_time(F.col("recorded_at")), tx.parse_time(F.lit("soon")))).select("seq", "recorded_at")


SINCE = f"WITH {o.DECISIONS} SELECT seq, recorded_at FROM decisions WHERE seq % 50 <> 0 AND recorded_at >= '2024-01-15T12:00:00'"

QUERIES = {
    "chunk_dedup": (chunk_dedup, f"WITH {o.CHUNKS} SELECT chunk_id, seq, project_id, agent_id, source, trust::DOUBLE AS trust, created_at FROM chunks"),
    "chunk_insert": (chunk_insert, CHUNK_INSERT),
    "tag_index": (tag_index, f"WITH {o.NOTES} SELECT DISTINCT unnest(tags) AS tag, chunk_id FROM notes"),
    "filter_tags_all": (filter_tags_all, _FILTER + "list_has_all(tags, ['#lang_de', '#doc'])"),
    "filter_project": (filter_project, _FILTER + "project_id = 'src7'"),
    "filter_agent_visibility": (filter_agent_visibility, _FILTER + "agent_id = 'agent_2' OR project_id IS NOT NULL"),
    "keyword_search": (keyword_search, _FILTER + f"contains(lower({o.rendered()}), 'er the') ORDER BY seq"),
    "keyword_search_scan": (keyword_search_scan, _FILTER + f"contains(lower({o.rendered()}), 'er the') ORDER BY seq"),
    "keyword_candidates": (keyword_candidates, f"""WITH {o.CHUNKS}, t AS (SELECT tags[-1] AS lang, lower({o.rendered()}) AS t FROM chunks)
SELECT lang, count(*) AS tested, count(*) FILTER (contains(t, 'er the')) AS found FROM t WHERE {' AND '.join(f"contains(t, '{g}')" for g in _GRAMS)} GROUP BY lang"""),
    "keyword_search_header": (keyword_search_header, _FILTER + f"contains(lower({o.rendered()}), 'notes/1') AND (agent_id = 'agent_3' OR project_id IS NOT NULL) ORDER BY seq"),
    "keyword_search_empty": (keyword_search_empty, _FILTER + "list_contains(tags, '#lang_fr') ORDER BY seq"),
    "index_sync_stats": (index_sync_stats, SYNC),
    "index_sync": (index_sync, INDEX_SYNC),
    "index_sync_log": (index_sync_log, INDEX_SYNC_LOG),
    "index_version": (index_version, VERSION),
    "semantic_search": (semantic_search, f"WITH {o.ranking(QUERY, TOP)} {_HITS}"),
    "semantic_search_vector": (semantic_search_vector, f"WITH {o.ranking(QUERY, TOP, hybrid=False)} {_HITS}"),
    "semantic_search_hybrid": (semantic_search_hybrid, f"WITH {o.ranking(QUERY, TOP, weight='0')} {_HITS}"),
    "semantic_search_scoped": (semantic_search_scoped, f"WITH {SCOPED} {_HITS}"),
    "related_chunks": (related_chunks, RELATED),
    "related_embeddings": (related_embeddings, RELATED_EMB),
    "context_prompt": (context_prompt, PROMPT),
    "semantic_search_batch": (semantic_search_batch, BATCH),
    "semantic_search_cached": (semantic_search_cached, f"""SELECT item_id, text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) AS cached, rank, chunk_id, score
FROM ({BATCH}) JOIN benchmark USING (item_id)"""),
    "chunk_plain": (chunk_plain, _plain_sql("text")),
    "chunk_plain_packed": (chunk_plain_packed, _plain_sql(_SPACED)),
    "chunk_markdown": (chunk_markdown, _markdown_sql(_SQL_MARKDOWN)),
    "chunk_dispatch": (chunk_dispatch, DISPATCH),
    "ingest_documents": (ingest_documents, INGEST),
    "ingest_report": (ingest_report, REPORT),
    "since_filter": (since_filter, SINCE),
    "since_unknown": (since_unknown, f"WITH {o.DECISIONS} SELECT seq, recorded_at FROM decisions"),
}
