"""The pipeline's stages against brute force, each on what its predecessor kept."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
ODD = [
    (None, None, None, None, None), (None, "no id but words of some kind are in this text", "en", "s", 3), (100_001, "", "en", "s", 0), (100_002, None, "en", "s", None),
    (100_003, "the same row twice is one document for the join of the near copies here", "en", "s", 5), (100_003, "the same row twice is one document for the join of the near copies here", "en", "s", 5),
    (100_004, "x " * 30_000, "en", "s", 60_000),
]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.work_table(stage(spark, out[-1], SF), "test-stage"))
    return [[r.asDict() for r in d.collect()] for d in out], [d.columns for d in out]


def test_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_keeps_clean_and_drops_junk(spark, stages):
    rows, _ = stages
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows[1]}
    clean = [d for d, x in labels.items() if x == (1, 0)]
    junk = [d for d, x in labels.items() if x[0] == 0]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)
    assert sum(d in kept for d in junk) <= 0.1 * len(junk)
    assert not any((r["text"] or "") == "" for r in rows[1])


def test_one_of_each_group_stays(stages):
    rows, _ = stages
    docs = sorted(((r["doc_id"], r["text"]) for r in rows[1]), key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    root, sets = brute.groups(docs)
    want = [docs[i] for i in range(len(docs)) if root[i] == i]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in rows[2])


def test_repeats_are_cut(stages):
    rows, _ = stages
    docs = [(r["doc_id"], r["text"]) for r in rows[2]]
    want = {(d, kept if gone else t) for (d, t), (_, kept, _, gone) in zip(docs, brute.words_kept(docs))}
    assert want == {(r["doc_id"], r["text"]) for r in rows[3]} and len(rows[2]) == len(rows[3])
    assert any(gone for _, _, _, gone in brute.words_kept(docs))


def test_contaminated_go(spark, stages):
    rows, _ = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in rows[3]]
    found = brute.contamination(docs, items)
    want = [d for d, (_, n, hit, _) in zip(docs, found) if not (hit and 20 * hit >= n)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in rows[4]) and len(want) < len(docs)


def test_pieces_are_lossless(stages):
    rows, _ = stages
    assert len(rows[5]) == len(rows[4]) and all(r["lossless"] for r in rows[5])
    assert sum(len(r["piece_ids"]) for r in rows[5]) > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = cp.work_table(stage(spark, docs, SF), "empty-stage")
        assert docs.count() == 0


def test_foreign_columns_pass(spark):
    """Columns called like an operator's own keep their values, and no column is asked for but ids and texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = {c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in ("tag", "n_words", "keep", "_key", "kept", "n_removed", "junk_score", "starts")}
    docs = docs.withColumns(own)
    for _, stage in cp.STAGES[:-1]:
        docs = cp.work_table(stage(spark, docs, SF), "foreign-stage")
        assert docs.columns == ["doc_id", "text", *own]
    rows = docs.collect()
    assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in own)
