"""Operators 11 and 13 on odd rows against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.llm import collocations as co
from recollect.llm import filters
from recollect.llm import periodic_runs as pr
from recollect.llm import queries
from recollect.llm import texts as tx
from tests.llm import brute

# --- 13 ---------------------------------------------------------------------


def plain_runs(words, periods=4, least=6):
    """Every lag in turn; a stretch counts under its least lag."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, periods * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(texts, periods=4, least=6):
    data, offsets = tx.text_bytes(pa.array(texts, pa.string()))
    starts, ends, before = tx.word_spans(data, offsets, tx.SPACED)
    found = [[] for _ in texts]
    for owner, *run in zip(*(x.tolist() for x in pr.find_runs(tx.word_ids(data, starts, ends), before, periods, least))):
        found[owner].append(tuple(run))
    return [sorted(f) for f in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6), st.sampled_from([(4, 6), (3, 1), (5, 9), (4, 9)]))
def test_runs_equal_every_lag_in_turn(blocks, limits):
    words = [w for block, times in blocks for w in block * times]
    assert runs_of([" ".join(words), "", "b a " + " ".join(words[::-1])], *limits) == [plain_runs(words, *limits), [], plain_runs(["b", "a", *words[::-1]], *limits)]


def test_seeds_are_guaranteed():
    for periods in (3, 4, 7):
        for least in (1, 6, 30):
            for lag in (1, 2, 4, 8, 16):
                assert pr.seed_length(lag, periods, least) == min(max(least, periods * q) - q for q in range(lag, 2 * lag))


def test_long_texts_of_one_word_and_of_a_long_period():
    assert runs_of(["a " * 300_000]) == [[(0, 300_000, 1)]]
    block = [str(i) for i in range(40_000)]
    assert runs_of(["x " + " ".join(block * 5)]) == [[(1, 200_000, 40_000)]]
    half = [str(i % 20_000) for i in range(40_000)]  # the period is the block's half
    assert runs_of([" ".join(half * 3)]) == [[(0, 120_000, 20_000)]]


ROWS = [
    (1, "a b a b a b a b a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "q " * 9, "x"), (4, "w\tw\nw  w w\x0bw", "x"), (4, "w w w w w w", "x"), (5, "ä ä ä ä ä ä ä", "x"),
    (6, "k l m k l m k l m k l m k l k l k l k l k l", "x"),
]


def test_runs_of_odd_rows(spark):
    # Columns named like the operator's own are replaced.
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, runs string").withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1)).repartition(3)
    got = sorted(pr.with_runs(df).collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    for (doc, text, _), r in zip(sorted(ROWS, key=lambda r: (str(r[0]), r[1] or "")), got):
        words = brute.spaced(text)
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) == (doc, len(words), runs, 1)
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert pr.with_runs(df.where("false")).count() == 0
    named = df.select("doc_id", F.col("text").alias("runs"))
    assert sorted(r.n_words for r in pr.with_runs(named, text="runs").collect()) == sorted(len(brute.spaced(t)) for _, t, _ in ROWS)
    with pytest.raises(ValueError):
        pr.with_runs(df, periods=2)


def test_run_digests(spark):
    df = spark.createDataFrame([(1, "a a a a a a b b b b b b x y x y x y x y"), (2, "no run")], "doc_id bigint, text string")
    one, none = pr.digests(pr.with_runs(df)).orderBy("doc_id").collect()
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (3, 12, 8, 2, 4000)
    assert one.runs_sha256 == hashlib.sha256(b"0,6,1\n6,6,1\n12,8,2\n").hexdigest()
    assert one.collapsed_sha256 == hashlib.sha256(b"a b x y").hexdigest()
    assert (none.n_runs, none.start, none.length, none.period, none.exponent_milli, none.runs_sha256) == (0, None, None, None, None, hashlib.sha256(b"").hexdigest())


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b")]
    got = {r.doc_id: r.text for r in queries._with_periods(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    planted = 0
    for doc, text in rows:
        words, h = text.split(), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if doc is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        assert got[doc].split() == words
    assert planted > 10


# --- 11 ---------------------------------------------------------------------


def plain_collocations(rows, threshold, longest=5, best=2000):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i: i + k])] += 1
    f = {key: a for key, a in f.items() if a >= threshold}
    inside = collections.defaultdict(int)
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i: i + k]] = max(inside[lang, p[i: i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and inside[lang, p] < a:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best]))


def speech():
    r = random.Random(3)
    words = "the cat sat on a mat and Then ran ÄH ß x y q".split(" ")
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) if r.random() < 0.6 else "new york city hall" for _ in range(40))
        rows.append((text.replace(" on ", r.choice([", ", "\t", "  ", ".\n", "! "])), [None, "en", "de"][i % 3]))
    return rows + [(None, "en"), ("", None), (".,;", "fr"), ("lone", "fr"), ("New York " * 50, "en")] + [("the cat sat", "en")] * 7


@pytest.mark.parametrize("threshold, gathered, counters, least", [(4, 1 << 21, 1 << 21, 1 << 16), (4, 300, 200, 1), (9, 50, 100, 4), (25, 500, 1 << 21, 1)])
def test_collocations(spark, monkeypatch, threshold, gathered, counters, least):
    monkeypatch.setattr(co, "GATHERED", gathered)
    monkeypatch.setattr(co, "COUNTERS", counters)
    monkeypatch.setattr(co, "LEAST_CAPACITY", least)
    monkeypatch.setattr(tx, "SLICE_BYTES", 400)
    rows = speech()
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("mine")).withColumn("n", F.lit(1)).repartition(4)
    got = sorted(tuple(r) for r in co.collocations(df, threshold=threshold).collect())
    assert got == plain_collocations(rows, threshold) and got


def test_best_of_each_language_and_empty_table(spark):
    rows = speech()
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(df, threshold=5, best=3).collect()) == plain_collocations(rows, 5, best=3)
    assert sorted(tuple(r) for r in co.collocations(df, longest=2, threshold=5).collect()) == plain_collocations(rows, 5, longest=2)
    assert co.collocations(df.where("false")).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "a", big), ("en", "b", 2 * big)], "lang string, phrase string, n bigint")
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, n bigint")
    monkeypatch.setattr(co, "frequent_phrases", lambda *a: (phrases, totals))
    assert [r.score for r in co.collocations(phrases).collect()] == [1000 * big * 7 * big // (big * 2 * big)]


def test_no_frequent_name_is_lost():
    """Summaries in any order of merging, with every hot and rare name."""
    r = np.random.default_rng(5)
    for threshold in (5, 20):
        names = np.concatenate([np.repeat(np.arange(50), threshold), r.integers(100, 5_000, 20_000), np.full(30_000, 7)]).astype(np.uint64)
        r.shuffle(names)
        capacity = 2 * len(names) // threshold + 1
        capacity, keys, counts, off = min(capacity, 3_000), np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for part in np.array_split(names, 17):
            fresh, n = np.unique(part, return_counts=True)
            keys, counts = co.merged([keys, fresh], [counts, n])
            keys, counts, less = co.cut(keys, counts, capacity, threshold - 1 - off)
            off += less
        truth = dict(zip(*(x.tolist() for x in np.unique(names, return_counts=True))))
        kept = dict(zip(keys.tolist(), counts.tolist()))
        assert off < threshold and all(kept.get(k, 0) + off >= n >= kept.get(k, 0) for k, n in truth.items())
        assert all(k in kept for k, n in truth.items() if n >= threshold)


def test_equal_hashes_of_other_phrases_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(tx, "window_hashes", lambda symbols, n: np.zeros(max(0, len(symbols) - n + 1), np.uint64))
    rows = [("a b c d a b x y a b c d", "en")] * 5
    data = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array([1] * 5), pa.array([t for t, _ in rows])], ["lang", "lang_key", "text"])
    s = next(co._slices(iter([data])))
    assert len(s.windows(2)[0]) == 55 and len(np.unique(s.windows(2)[1])) == 1
    held = filters.bloom(spark.createDataFrame([(int(tx.mix(co._named(s.windows(n)[1][:1], 6)).view(np.int64)[0]),) for n in range(2, 6)], "name bigint"))

    class Sent:
        value = held

    made = []

    class Rows:
        def mapInArrow(self, function, schema):
            made.extend(function(iter([data])))

    alike = co._Survivors(Sent, 6)
    co._counted(Rows(), alike, alike, 5, 3)
    got = collections.Counter()
    for batch in co._summed(1)(iter(made)):
        for lang, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
            got[phrase] += n
    words = rows[0][0].split()
    want = collections.Counter(" ".join(words[i: i + k]) for k in range(2, 6) for i in range(len(words) - k + 1))
    assert got == collections.Counter({p: 5 * n for p, n in want.items()})
