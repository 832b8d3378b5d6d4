import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import vectors
from recollect.functions.numbers import fixed3, round4, round4_array
from recollect.functions.vectors import embed, embed_all, sparse
from recollect.operators import chunks as ck
from recollect.operators import embed as em
from recollect.operators import search as se
from recollect.settings import DEFAULTS

CORPUS = [
    # content, tags, project, agent, trust
    ("Postgres vacuum tuning guide for large tables", ["#db"], "p1", "a", 1.0),
    ("Настройка вакуума в базе данных Postgres", ["#db", "#ru"], "p1", "b", 0.4),
    ("Vacuum cleaner buying guide", ["#home"], None, "b", 0.5),
    ("Large tables need vacuum; vacuum tuning helps", ["#db"], "p2", None, 0.8),
    ("The cat sat on the mat", ["#cat"], None, "a", None),
    ("vacuum tuning", ["#db"], "p2", "a", 0.0),
    ("!!! ???", [], None, None, 0.5),
    ("tuning vacuum", ["#db"], None, "c", 0.5),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, c, t, p, a, None, tr, f"2024-01-0{i + 1}") for i, (c, t, p, a, tr) in enumerate(CORPUS)]
    df = spark.createDataFrame(
        rows, "seq bigint, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string")
    return df.withColumn("chunk_id", F.md5(F.col("content").cast("binary")))


@pytest.fixture(scope="module")
def index(chunks):
    return em.with_vectors(chunks)


def brute(query, top_k, hybrid=True, weight=0.25, keep=lambda c: True, corpus=CORPUS):
    """The ranking as three stable sorts over a plain list, with Python's own rounding."""
    q = embed(query, 512)
    rows = []
    for seq, (content, tags, project, agent, trust) in enumerate(corpus):
        v = np.round(embed(content, 512), 6)
        cos = math.fsum(q * v)
        if keep(corpus[seq]) and cos > 0:
            rows.append([seq, round(cos, 4), content, 0.5 if trust is None else trust])
    rows.sort(key=lambda r: -r[1])
    needle = query.strip().lower()
    if hybrid:
        for r in rows[: top_k * 4]:
            if needle and needle in r[2].strip().lower():
                r[1] = round(r[1] + 0.25, 4)
        rows.sort(key=lambda r: -r[1])
    for r in rows:
        r[1] = round(r[1] * (1.0 - weight + weight * r[3]), 4)
    rows.sort(key=lambda r: -r[1])
    return [(r[0], r[1]) for r in rows[: max(1, top_k)]]


def test_round4_is_exact(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(3000), rng.integers(0, 200000, 3000) / 100000, rng.integers(0, 1 << 16, 500) / (1 << 16), [0.0, 0.27735, -0.27735]])
    want = [round(float(v), 4) for v in values]
    assert [float(v) for v in round4_array(values)] == want
    df = spark.createDataFrame(list(enumerate(map(float, values))), "i int, v double")
    assert [r.r for r in df.select("i", round4(F.col("v")).alias("r")).orderBy("i").collect()] == want


def test_three_decimals_follow_the_value(spark):
    """0.0045 lies below its decimal form, and is shown as 0.004."""
    values = [i / 10000 for i in range(12501)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.t for r in df.select("i", fixed3(F.col("v")).alias("t")).orderBy("i").collect()] == [f"{v:.3f}" for v in values]


def test_prompt_shows_the_score_by_value(index):
    hit = index.where("seq = 0").select("seq", "chunk_id", "project_id", "tags", "trust", *[F.lit(0.0045).alias(c) for c in ("cosine", "hybrid", "score")])
    assert "[1] score=0.004 | " in se.context_prompt(index, "vacuum", hits=hit).first().text


def ranked(df):
    return [(r.seq, r.score) for r in df.collect()]


def test_embedding_forms_agree(chunks):
    dense = {r.chunk_id: r.vec for r in em.with_vectors(chunks).collect()}
    assert len(dense) == 7  # a text without tokens has no vector
    sparse = em.rounded_weights(em.embedding_weights(chunks)).collect()
    for r in sparse:
        assert math.isclose(dense[r.chunk_id][r.idx], r.w, abs_tol=1e-9)
    assert len(sparse) == sum(sum(1 for x in v if x) for v in dense.values())


def test_texts_embedded_together(monkeypatch):
    """The same vectors as one by one, whatever the lengths of words and pairs (up to 55 bytes fit one block of the digest)."""
    odd = ["", None, "?", "a", "a b a b a", "x" * 54 + " y", "x" * 55 + " " + "z" * 55, "x" * 56, "q" * 300 + " w", "ё" * 27 + " ёж", "я" * 28, "Привет МИР мир",
           "a" * 27 + " " + "b" * 27, "a" * 27 + " " + "b" * 28, "ſ İ K", *[" ".join(f"w{j * i % 97}" for j in range(i)) for i in range(0, 300, 7)]]
    for dim in (512, 7):
        want = np.stack([embed(x or "", dim) for x in odd])
        assert np.abs(embed_all(odd, dim) - want).max() < 1e-14
        monkeypatch.setattr(vectors, "_CHARS", 40)
        parts = list(vectors.embedded(pa.array(odd), dim))
        assert len(parts) > 20 and np.abs(np.concatenate([m for _, m in parts]) - want).max() < 1e-14


def test_long_form_is_narrow(chunks):
    """Features are counted where their text lies: nothing is sorted or shuffled."""
    plan = em.embedding_weights(chunks)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Aggregate", "Window"))


@pytest.mark.parametrize("query", ["vacuum tuning", " VACUUM ", "postgres вакуума", "cat", "guide for large"])
@pytest.mark.parametrize("top_k", [0, 1, 2, 5])
def test_search_matches_brute_force(index, query, top_k):
    assert ranked(se.semantic_search(index, query, top_k)) == brute(query, top_k)
    assert ranked(se.semantic_search(index, query, top_k, hybrid=False)) == brute(query, top_k, hybrid=False)


def test_trust_can_lift_a_row_from_outside_the_head(index):
    flat = DEFAULTS.overlay({"trust": {"weight": 1.0}})
    for k in (1, 2):
        assert ranked(se.semantic_search(index, "vacuum tuning", k, settings=flat)) == brute("vacuum tuning", k, weight=1.0)


def test_no_tokens_no_hits(index):
    assert ranked(se.semantic_search(index, "", 5)) == []
    assert ranked(se.semantic_search(index, "?!", 5)) == []


def test_filters(index):
    got = ranked(se.semantic_search(index, "vacuum tuning", 5, tags=["#db"], agent_id="a"))
    assert got == brute("vacuum tuning", 5, keep=lambda c: "#db" in c[1] and (c[3] == "a" or c[2]))
    got = ranked(se.semantic_search(index, "vacuum tuning", 5, project_id="p2"))
    assert got == brute("vacuum tuning", 5, keep=lambda c: c[2] == "p2")


def test_batch_equals_single(spark, index):
    texts = ["vacuum tuning", "postgres вакуума", "?", "cat", " "]
    queries = spark.createDataFrame(list(enumerate(texts)), "q bigint, text string")
    rows = se.semantic_search_batch(index, queries, "q", "text", 2).orderBy("query_id", "rank").collect()
    for i, text in enumerate(texts):
        assert [(r.seq, r.score) for r in rows if r.query_id == i] == ranked(se.semantic_search(index, text, 2))


def test_batch_splits_queries_into_blocks(spark, index, monkeypatch):
    monkeypatch.setattr(se, "BLOCK_VECTORS", 2)
    monkeypatch.setattr(se, "_BROADCAST_BYTES", 0)
    queries = spark.createDataFrame([(i, "vacuum tuning") for i in range(5)], "q bigint, text string")
    rows = se.semantic_search_batch(index, queries, "q", "text", 1).collect()
    assert sorted(r.query_id for r in rows) == list(range(5))


def test_a_task_keeps_the_best_of_all_its_blocks(spark, monkeypatch):
    """What leaves a task is bounded by its queries, not by the blocks of notes that it meets."""
    rng = np.random.default_rng(8)
    corpus = [(" ".join(rng.choice(["vacuum", "tuning", "cat", "guide", "of"], rng.integers(1, 9))) + " ." * (i % 5), [], None, None, float(rng.choice([0.0, 0.4, 1.0]))) for i in range(700)]
    rows = [(i, c, t, p, a, None, tr, "2024") for i, (c, t, p, a, tr) in enumerate(corpus)]
    df = spark.createDataFrame(rows, "seq bigint, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string")
    index = em.with_vectors(df.withColumn("chunk_id", F.md5(F.col("content").cast("binary"))).coalesce(1))
    texts = ["vacuum tuning", "cat of", "guide", "?", "tuning vacuum of cat"]
    queries = spark.createDataFrame(list(enumerate(texts)), "q bigint, text string").coalesce(1)
    monkeypatch.setattr(se, "BLOCK_VECTORS", 32)
    kept, sizes = se._kept, {}

    def counted(df, purpose):
        out = kept(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(se, "_kept", counted)
    got = se.semantic_search_batch(index, queries, "q", "text", 2).orderBy("query_id", "rank").collect()
    for i, text in enumerate(texts):
        assert [(r.seq, r.score) for r in got if r.query_id == i] == brute(text, 2, corpus=corpus)
    assert sizes["partial-results"] <= len(texts) * (8 + 10)


def test_related_excludes_itself(index):
    first = index.where("seq = 5").select("chunk_id").first()[0]
    rows = se.related(index, first, 10).collect()
    assert 5 not in [r.seq for r in rows] and rows[0].seq in (3, 7)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert se.related(index, "absent", 3).count() == 0


def test_prompt_block(index):
    row = se.context_prompt(index, "vacuum tuning", max_chunks=2, max_chars=400).first()
    assert row.text.startswith("### ") and "[1] score=" in row.text and row.chars == len(row.text) <= 401
    assert len(row.chunks) == 2
    none = se.context_prompt(index, "?", project_id="p1").first()
    assert none.chunks == [] and "(проект: p1)" in none.text and none.chars == len(none.text)


def test_dedup_first_writer_wins(spark):
    notes = spark.createDataFrame([(2, "x", "p2"), (1, "x", "p1"), (3, "y", None)], "seq bigint, content string, project_id string")
    kept = ck.deduplicate(notes.withColumn("chunk_id", F.md5(F.col("content").cast("binary"))), ["content", "project_id"])
    assert sorted((r.content, r.seq, r.project_id) for r in kept.collect()) == [("x", 1, "p1"), ("y", 3, None)]


def test_insert_is_idempotent(chunks):
    assert ck.new_chunks(chunks, chunks).count() == 0
    assert ck.new_chunks(chunks, chunks.where("seq < 3")).count() == 5


def test_keyword_search_reads_front_matter(chunks):
    find = lambda *a, **k: sorted(r.seq for r in ck.keyword_search(chunks, *a, **k).collect())
    assert find("VACUUM") == [0, 2, 3, 5, 7]
    assert find("project_id: p1") == [0, 1]
    assert find("#home") == [2]
    assert find("") == list(range(8))
    assert find("", agent_id="a") == [0, 1, 3, 4, 5]
    assert find("", tags=["#db", "#ru"]) == [1]
    assert find("nothing like this") == []


def test_header_with_rule_shifts_the_body(chunks):
    odd = chunks.where("seq = 4").withColumn("source", F.lit("https://x/a---b"))
    assert odd.select(ck.stored_body(odd)).first()[0].startswith("b\nagent_id: a\n")


def test_index_sync(chunks, index):
    held = index.where("seq < 4").select("chunk_id", "embedder", "dim")
    old = index.where("seq = 4").select("chunk_id", F.lit("other").alias("embedder"), "dim")
    gone = index.limit(1).select(F.lit("gone").alias("chunk_id"), "embedder", "dim")
    state = held.unionAll(old).unionAll(gone)
    assert tuple(em.sync_stats(state, chunks).first()) == (7, 3, 1, True)


def test_index_version_is_order_free(chunks):
    one = em.index_version(chunks).first()[0]
    assert len(one) == 12 and em.index_version(chunks.orderBy("content").repartition(3)).first()[0] == one
    assert em.index_version(chunks.limit(2)).first()[0] != one


def test_search_plan_has_no_join_and_reuses_its_exchange(index):
    scored = se.score_chunks(index, sparse(embed("vacuum tuning", 512))).withColumn("low", F.col("cosine"))
    found = se.selected(scored, 8, 10)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Join" not in final and "ReusedExchange" in final and final.count("ArrowEvalPython") == 1


def test_other_embedder(chunks):
    lengths = em.with_vectors(chunks, 2, lambda text: F.array(F.length(text).cast("double"), F.lit(1.0)), "lengths")
    rows = se.semantic_search(lengths, "any", 1, hybrid=False, query_vector=[1.0, 0.0]).collect()
    assert [r.seq for r in rows] == [0] and lengths.first().embedder == "lengths"


def test_many_slots_score_the_same(index):
    """Beyond the unrolled form the dot product runs over arrays."""
    long = " ".join(c[0] for c in CORPUS)
    assert ranked(se.semantic_search(index, long, 4)) == brute(long, 4)


def test_a_third_of_the_notes_tie(spark):
    """Copies that differ only in punctuation share a vector; batches are small, so every cut is exercised."""
    rng = np.random.default_rng(5)
    corpus = []
    for i in range(1500):
        words = "vacuum tuning" if i % 3 == 0 else " ".join(rng.choice(["vacuum", "tuning", "cat", "guide", "tables", "of"], rng.integers(1, 5)))
        corpus.append((f"{words} {'.' * i}", [], None, None, float(rng.choice([0.0, 0.4, 0.5, 0.8, 1.0]))))
    rows = [(i, c, t, p, a, None, tr, "2024") for i, (c, t, p, a, tr) in enumerate(corpus)]
    df = spark.createDataFrame(
        rows, "seq bigint, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string")
    index = em.with_vectors(df.withColumn("chunk_id", F.md5(F.col("content").cast("binary"))).repartition(7)).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        queries = spark.createDataFrame([(0, "vacuum tuning"), (1, "guide of tables"), (2, "cat ....")], "q bigint, text string")
        batch = se.semantic_search_batch(index, queries, "q", "text", 4).orderBy("query_id", "rank").collect()
        for q, text in ((r.q, r.text) for r in queries.collect()):
            want = brute(text, 4, corpus=corpus)
            assert ranked(se.semantic_search(index, text, 4)) == want
            assert [(r.seq, r.score) for r in batch if r.query_id == q] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        index.unpersist()
