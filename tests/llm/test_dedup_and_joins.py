"""Operators 1, 2, 5 and 10 on odd rows against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import components, decontamination, filters, jaccard_join, repeats, substring_dedup, suffix_dedup
from recollect.llm import texts as tx
from tests.llm import brute


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randrange(60)) for _ in range(n)]


def odd_documents():
    base = prose(1, 120)
    edited = [w if i % 60 else w + "x" for i, w in enumerate(base)]
    passage = " ".join(prose(2, 40))
    docs = [
        (1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base)), (9, " ".join(base).upper()), (4, passage + " tail one"), (5, "head two\n" + passage), (6, ""), (7, None),
        (8, "one two three"), (10, "one  two\tthree"), (11, "a " * 400), (12, "b " + "a " * 380), (13, "ab" * 3000), (14, passage + " " + passage), (15, "ß" * 300), (16, "x" * 99), (17, "x" * 100),
        (18, " ".join(prose(3, 12))), (19, " ".join(prose(3, 13))), (20, " ".join(prose(3, 13))),
    ]
    return docs


SCHEMA = "doc_id bigint, text string, n int, starts int, kept string, tag int"


@pytest.fixture(scope="module")
def table(spark):
    # Columns named like the operators' own, and a NULL id.
    rows = [(d, t, 1, 2, "mine", 3) for d, t in odd_documents()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_byte_windows(table):
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(table).collect()}
    for doc, kept, removed, runs in brute.bytes_kept(odd_documents()):
        assert (bytes(got[doc].kept), got[doc].n_removed, got[doc].n_spans) == (kept, removed, runs), doc
    assert all(r.tag == 3 and r.n == 1 for r in got.values())


def test_byte_windows_dealt_one_by_one(table, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_SPANS", 1)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(table.select("doc_id", "text")).collect()}
    assert all((bytes(got[d].kept), got[d].n_spans) == (kept, runs) for d, kept, _, runs in brute.bytes_kept(odd_documents()))


def test_word_windows(table, monkeypatch):
    want = brute.words_kept(odd_documents())
    for limit in (repeats.GROUP_SPANS, 1):
        monkeypatch.setattr(repeats, "GROUP_SPANS", limit)
        got = {r.doc_id: r for r in substring_dedup.without_repeats(table).collect()}
        for doc, kept, n, gone in want:
            assert (got[doc].kept, got[doc].n_words, got[doc].n_removed) == (kept, n, gone), doc


def test_ids_that_repeat_or_lack(spark):
    long = " ".join(prose(5, 30))
    rows = [(None, long), (None, long), (1, long), (1, long), (1, "other " + long), (2, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.without_repeats(df).collect())
    assert got == [("1", 30), ("1", 30), ("1", 30), ("2", 30), ("None", 0), ("None", 0)]
    alone = df.where("doc_id = 1")
    assert [r.n_removed for r in substring_dedup.without_repeats(alone).collect()] == [0, 0, 0]
    # By bytes a later place in the same id counts: "other " moves the copy behind.
    assert sorted(r.n_removed for r in suffix_dedup.without_repeats(alone).collect()) == sorted([0, 0, len(long.encode())])


def test_scan_of_one_long_text(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("ab cd") for _ in range(30_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    kind = suffix_dedup.kind()
    monkeypatch.setattr(suffix_dedup, "_PIECE", 5_000)
    s = kind.scan(batch)
    cover = np.concatenate([np.arange(a, a + n) for a, n in zip(s.start, s.count)])
    assert sorted(cover.tolist()) == list(range(30_000 - 99))


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    words = [r.choice("the a of cat dog ran".split()) for _ in range(60)]
    kind = substring_dedup.kind()
    named = {}
    for before, after in (("", ""), ("x y z ", " q"), ("the the ", " the the the"), ("a " * 9, "")):
        batch = pa.RecordBatch.from_arrays([pa.array([before + " ".join(words) + after])], ["text"])
        s, skip = kind.scan(batch), len(before.split())
        for a, n, shift, anchor in zip(s.start.tolist(), s.count.tolist(), s.shift.tolist(), s.anchor.tolist()):
            for k in range(n):
                if 0 <= a + k - skip <= 60 - 13:
                    assert named.setdefault(a + k - skip, (anchor, shift - k)) == (anchor, shift - k)
    assert len(named) == 48


def test_near_duplicates(table):
    docs = odd_documents()
    root, sets = brute.groups(docs)
    least = {}
    for (doc, _), r in zip(docs, root):
        least[r] = min(least.get(r, doc), doc)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(table).collect()}
    for (doc, _), r, s in zip(docs, root, sets):
        assert (got[doc].n_shingles, got[doc].component_id) == (len(s), least[r]), doc
    assert len(got) == len(docs)


def test_many_near_copies(spark):
    """A group without a common original, and texts that only share a passage."""
    base, docs = prose(7, 150), []
    for i in range(60):
        w = list(base)
        for p in random.Random(i).sample(range(150), 1 + i % 5):
            w[p] = f"edit{i}"
        docs.append((i, " ".join(w)))
    passage = " ".join(prose(8, 60))
    docs += [(100 + i, passage + " " + " ".join(prose(100 + i, 40))) for i in range(30)]
    root, _ = brute.groups(docs)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[d] for d, _ in docs] == [docs[r][0] for r in root]


@pytest.mark.parametrize("limit", [1 << 19, 40])
def test_contamination(spark, table, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", limit)
    items = [(1, " ".join(prose(2, 40)[5:30])), (2, "ONE two, three"), (3, ""), (4, None), (None, "xi"), (5, " ".join(prose(1, 120)[:13])), (5, "zz"), (6, "two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contamination(table, bench).collect()}
    for doc, n, hit, found in brute.contamination(odd_documents(), items):
        assert (got[doc].n_words, got[doc].n_hit, list(got[doc].item_ids)) == (n, hit, found), doc
    assert len(got) == len(odd_documents())


def test_contamination_of_repeated_and_null_rows(spark):
    rows = [(None, "one two three"), (1, "one two three"), (1, "one two three"), (1, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([("a", "two three")], "item_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_hit, list(r.item_ids)) for r in got) == [("1", 0, []), ("1", 2, ["a"]), ("1", 2, ["a"]), ("None", 2, ["a"])]
    none = spark.createDataFrame([], "item_id string, text string")
    assert sum(r.n_hit for r in decontamination.contamination(docs, none).collect()) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.without_repeats(none).count() == substring_dedup.without_repeats(none).count() == jaccard_join.near_duplicates(none).count() == 0
    assert decontamination.contamination(none, spark.createDataFrame([(1, "x")], "item_id bigint, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100


def test_filter_has_no_false_negatives(spark):
    keys = tx.mix(np.arange(5_000, dtype=np.uint64))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k bigint")
    held = filters.bloom(df)
    assert filters.held_in(held, keys).all()
    assert filters.held_in(held, tx.mix(np.arange(10_000, 20_000, dtype=np.uint64))).mean() < 0.01


def test_digests(spark):
    df = spark.createDataFrame([(1, "a  b")], "doc_id bigint, text string")
    row = substring_dedup.digests(substring_dedup.without_repeats(df)).first()
    assert row.kept_sha256 == hashlib.sha256(b"a b").hexdigest()
