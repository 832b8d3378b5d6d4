"""The maintained index: versions, tombstones, bounds, and searches that skip blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions.vectors import embed, sparse
from recollect.operators import chunks as ck
from recollect.operators import embed as em
from recollect.operators import index as ix
from recollect.operators import keyword_index as ki
from recollect.operators import note_index as ni
from recollect.operators import search as se
from recollect.operators.chunks import NOTE_COLUMNS, scope
from recollect.operators.result_cache import ResultCache
from recollect.settings import DEFAULTS

SCHEMA = "seq bigint, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string"


def notes(spark, contents, start=0):
    rows = [(start + i, c, ["#t"], "p" if i % 2 else None, f"a{i % 3}", None, [None, 0.0, 0.4, 1.0][i % 4], "2024") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("chunk_id", F.md5(F.col("content").cast("binary")))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "index")


def held(index):
    return sorted((r.seq, r.content) for r in index.rows().select("seq", "content").collect())


def test_versions(spark, path):
    index = ix.VectorIndex(spark, path)
    assert index.rows().count() == 0 and index.search("one").count() == 0
    first = notes(spark, ["one cat", "two", "one cat", "?!", "three"])
    assert index.sync(first) == ni.Synced(3, 3, 0, False, False)
    assert held(index) == [(0, "one cat"), (1, "two"), (4, "three")]
    version = index.version
    assert index.sync(first) == ni.Synced(3, 0, 0, False, False) and index.version == version
    # One note goes, one comes, one stands elsewhere now.
    more = notes(spark, ["two", "four"], 1).unionByName(notes(spark, ["one cat"], 9))
    done = index.sync(more)
    assert (done.total, done.added, done.removed) == (3, 2, 2)
    assert held(index) == [(1, "two"), (2, "four"), (9, "one cat")]
    # What was taken out may come back, and go again.
    assert index.sync(first).total == 3 and held(index) == [(0, "one cat"), (1, "two"), (4, "three")]
    assert index.sync(more).total == 3 and held(index) == [(1, "two"), (2, "four"), (9, "one cat")]
    # The same folder, opened anew.
    again = ix.VectorIndex(spark, path)
    assert held(again) == held(index) and again.version == index.version
    vectors = {r.chunk_id: list(r.vec) for r in again.rows().collect()}
    assert vectors == {r.chunk_id: list(r.vec) for r in em.with_vectors(more).collect()}
    assert index.sync(more.where("false")).total == 0 and held(index) == []


def test_sync_of_some_of_the_notes(spark, path):
    """A choice is made over ids and places; of a content's copies the first chosen one counts."""
    index = ix.VectorIndex(spark, path)
    table = notes(spark, ["one cat", "two", "one cat", "three", "?!"])
    chosen = table.select("chunk_id", "seq")
    assert index.sync(table, chosen.where("seq in (2, 3, 4)")) == ni.Synced(2, 2, 0, False, False)
    assert held(index) == [(2, "one cat"), (3, "three")]
    assert index.sync(table, chosen.where("seq < 3")).removed == 2 and held(index) == [(0, "one cat"), (1, "two")]


def test_another_embedder_starts_anew(spark, path):
    one = notes(spark, ["one", "two"])
    ix.VectorIndex(spark, path, name="older").sync(one)
    index = ix.VectorIndex(spark, path)
    assert index.sync(one) == ni.Synced(2, 2, 0, True, False)
    assert {r.embedder for r in index.rows().collect()} == {"hashing-v1"}
    lengths = ix.VectorIndex(spark, path, DEFAULTS.overlay({"semantic": {"dim": 2}}), "lengths", lambda text: F.array(F.length(text).cast("double"), F.lit(1.0)))
    assert lengths.sync(one).rebuilt and {len(r.vec) for r in lengths.rows().collect()} == {2}
    assert [r.seq for r in lengths.search("any", 1, hybrid=False, query_vector=[1.0, 0.0]).collect()] == [0]


def test_compaction(spark, path, monkeypatch):
    monkeypatch.setattr(ni, "BLOCK_BITS", 1)
    index = ix.VectorIndex(spark, path)
    words = [f"word{i} common" for i in range(40)]
    index.sync(notes(spark, words[:30]))
    done = index.sync(notes(spark, words[:20] + ["gone"] * 0 + words[30:35]))
    assert done.compacted and index.count("gone") == 0 and len(index._folders("rows")) == 1
    blocks = index.rows().groupBy("block").agg(F.count("*").alias("n"), F.max("seq").alias("hi"), F.min("seq").alias("lo")).orderBy("lo").collect()
    assert all(b.n <= 2 for b in blocks) and all(a.hi < b.lo for a, b in zip(blocks, blocks[1:]))
    assert sum(b.n for b in blocks) == index.count("rows") == done.total


def corpus(n=900):
    r = np.random.default_rng(3)
    common, rare = ["vacuum", "tuning", "cat", "guide", "of"], [f"term{i}" for i in range(300)]
    return [" ".join([*r.choice(common, r.integers(0, 4)), *r.choice(rare[i // 30 * 10: i // 30 * 10 + 10], r.integers(1, 5))]) + " ." * (i % 7) for i in range(n)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    old = ni.BLOCK_BITS
    ni.BLOCK_BITS = 4
    index = ix.VectorIndex(spark, str(tmp_path_factory.mktemp("kept")))
    table = notes(spark, corpus())
    index.sync(table.where("seq < 850"))
    index.sync(table.where("seq >= 30"))
    ni.BLOCK_BITS = old
    return index


def test_bounds_hold(kept):
    """No row has a weight above its block's, and no score above its block's bound."""
    bounds = {(r.block, r.slot): (r.hi, r.lo) for r in kept.bounds().collect()}
    vector = embed("vacuum term7 of cats", 512)
    found = {r.block: (r.cosine, r.low) for r in kept._bounded(vector).collect()}
    for r in kept.all_rows().collect():
        for slot in np.flatnonzero(r.vec):
            hi, lo = bounds[r.block, int(slot)]
            assert lo <= r.vec[slot] <= hi
        cosine = float(np.dot(r.vec, vector))
        if cosine > 0:
            trust = 0.5 if r.trust is None else r.trust
            assert cosine <= found[r.block][0] and round(cosine, 4) * (0.75 + 0.25 * trust) <= found[r.block][1]


@pytest.mark.parametrize("query", ["term123 vacuum", "vacuum tuning", "cat . .", "?"])
@pytest.mark.parametrize("options", [{}, {"hybrid": False}, {"project_id": "p", "agent_id": "a1", "top_k": 2}])
def test_search_equals_the_full_scan(kept, query, options):
    rows = kept.rows()
    want = [tuple(r) for r in se.semantic_search(rows, query, **options).select("seq", "score", "keyword_hit", "cosine").collect()]
    assert [tuple(r) for r in kept.search(query, **options).select("seq", "score", "keyword_hit", "cosine").collect()] == want


def test_blocks_are_skipped(kept):
    total = kept.all_rows().select("block").distinct().count()
    needed = kept.needed_blocks(embed("term123 term125", 512), 1, True, lambda rows: scope(rows))
    assert total > 50 and 0 < len(needed) < total / 2
    assert kept.needed_blocks(embed("?", 512), 1, True, lambda rows: rows) == []


def test_scoring_reads_no_text(kept):
    rows = kept.rows()
    scored = se.score_chunks(rows, sparse(embed("term3", 512))).withColumn("low", F.col("cosine"))
    plan = se.selected(scored, 4, 5)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line and "vec" in line]
    assert schemas and not any("content" in line.split("ReadSchema")[1] for line in schemas)


def test_more_blocks_than_can_be_named(kept, monkeypatch):
    monkeypatch.setattr(ix, "NAMED_BLOCKS", 1)
    assert kept.needed_blocks(embed("vacuum", 512), 5, True, lambda rows: rows) is None
    assert kept.search("vacuum").count() == 5


def test_batch_and_prompt_over_the_index(spark, kept):
    texts = ["term3", "vacuum of", "?", "", "term200 cat"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "q int, text string")
    batch = se.semantic_search_batch(kept.rows(), queries, "q", "text", 3).collect()
    for i, text in enumerate(texts):
        assert sorted((r.rank, r.seq, r.score) for r in batch if r.query_id == i) == [(n + 1, r.seq, r.score) for n, r in enumerate(kept.search(text, 3).collect())]
    assert not [r for r in batch if r.query_id == 9]
    assert kept.context_prompt("term3 vacuum").first() == se.context_prompt(kept.rows(), "term3 vacuum").first()


def test_results_are_kept(spark, kept, tmp_path, monkeypatch):
    texts = ["term3", "vacuum of", "?", "term3", "", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    cache = ResultCache(spark, str(tmp_path / "results"), 3)
    plain = sorted((r.query_id, r["rank"], r.seq, r.score, r.hybrid) for r in se.semantic_search_batch(kept.rows(), queries, "q", "text", 3).collect())
    rows = lambda df: sorted((r.query_id, r["rank"], r.seq, r.score, r.hybrid) for r in df.collect())
    first = cache.search_batch(kept, queries.where("q < 3"), "q", "text", 3)
    assert cache.computed == 3 and {r.cached for r in first.collect()} == {False}
    second = cache.search_batch(kept, queries, "q", "text", 3)
    assert cache.computed == 1 and rows(second) == plain and {r.cached for r in second.collect()} == {True}  # NULL is '', which finds nothing
    assert cache.computed == 1
    # Other options are other entries; of five entries the three newest are looked up.
    cache.search_batch(kept, queries.where("q = 1"), "q", "text", 2)
    assert cache.computed == 1
    again = cache.search_batch(kept, queries, "q", "text", 3)
    assert 1 <= cache.computed <= 3 and rows(again) == plain
    monkeypatch.setattr(kept, "version", kept.version + 1)
    cache.search_batch(kept, queries, "q", "text", 3)
    assert cache.computed == 4


def test_columns_of_the_index(kept):
    assert set(NOTE_COLUMNS) < set(kept.rows().columns)


# --- keywords ---------------------------------------------------------------


def test_grams_and_containers(monkeypatch):
    text = "aбc😀" * 50 + "xyz"
    want = sorted({tuple(map(ord, text[i: i + 3])) for i in range(len(text) - 2)})
    split = lambda g: (g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF)
    assert sorted(split(int(g)) for g in ki.grams_of(text)) == want
    monkeypatch.setattr(ki, "PIECE", 7)
    assert sorted(split(int(g)) for g in ki.grams_of(text)) == want
    assert len(ki.grams_of("ab")) == len(ki.grams_of("")) == 0
    for n in (0, 1, 255, 256, 4096):
        places = np.sort(np.random.default_rng(n).choice(4096, n, replace=False))
        held = ki.container(places)
        assert np.flatnonzero(ki.members(held)).tolist() == places.tolist() and len(held) <= 512


def test_postings_leave_in_small_batches(monkeypatch):
    texts = [f"text {i % 7} of {i}" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4080, 4140)), pa.array(texts)], ["seq", "text"])
    want = {(g, seq) for seq, text in enumerate(texts, 4080) for g in ki.grams_of(text).tolist()}
    for gathered, rows in ((100, 8), (1 << 20, 16)):
        monkeypatch.setattr(ki, "GATHERED", gathered)
        monkeypatch.setattr(ki, "ROWS", rows)
        parts = list(ki._postings(iter([batch])))
        assert len(parts) > 3 and max(p.num_rows for p in parts) <= rows
        got = [(r["gram"], (r["block"] << ki.PLACE_BITS) + p) for part in parts for r in part.to_pylist() for p in np.flatnonzero(ki.members(r["places"])).tolist()]
        assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    contents = [f"Note {i} of {'alpha' if i % 3 == 0 else 'beta'} needle{i % 400}" for i in range(9_000)] + ["", "ab", "ABC", "the é ß Ünder", "x" * 5_000 + "End"]
    table = notes(spark, contents)
    index = ki.KeywordIndex(spark, str(tmp_path_factory.mktemp("words")))
    index.sync(table.where("seq < 8000"))
    index.sync(table.where("seq >= 100"))
    return index, table.where("seq >= 100")


NEEDLES = ["needle399", "NEEDLE39", "alpha", "", "ab", "é", "created_at: 2024", "xxxEND", "ünder", "no such text", "alp ha", "a1\ntrust"]


def test_keyword_search_equals_the_scan(words):
    index, table = words
    for needle in NEEDLES:
        want = sorted(r.seq for r in ck.keyword_search(table, needle).collect())
        assert sorted(r.seq for r in index.search(needle).collect()) == want, needle
    scoped = {"project_id": "p", "agent_id": "a1", "tags": ["#t"]}
    assert sorted(r.seq for r in index.search("needle39", **scoped).collect()) == sorted(r.seq for r in ck.keyword_search(table, "needle39", **scoped).collect())


def test_few_notes_are_candidates(words, monkeypatch):
    index, table = words
    assert index.candidates("ab") is None and index.candidates("zzz top").count() == 0
    found = index.candidates("needle399").count()
    assert 0 < found < 0.05 * table.count()
    blocks = index.candidates("needle399").select((F.col("seq") / 4096).cast("int")).distinct().count()
    assert blocks <= 3
    assert index.candidates("xxxend").count() == 1
    few = index.search("needle399").count()
    monkeypatch.setattr(ki, "NAMED", 1)
    assert index.search("needle399").count() == few > 1


def test_keyword_index_follows_the_notes(spark, path):
    index = ki.KeywordIndex(spark, path)
    first = notes(spark, ["one cat", "two dogs"])
    index.sync(first)
    index.sync(first.where("seq = 1"))
    assert index.search("cat").count() == 0 and index.search("dogs").count() == 1
    index.sync(first)
    assert [r.seq for r in index.search("cat").collect()] == [0]
