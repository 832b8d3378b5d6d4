import json
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import rewriting
from recollect.functions.items import session_items
from recollect.operators import sessions as ss
from recollect.settings import Summaries

CAPS = {"done": 10, "decisions": 10, "next": 10, "dialog": 5, "other": 10}
KEYS = ["actions", "Done", "decision", "todo", "chat_history", "metric", "сделано", "Дальше"]
SIDE = {"actions": "done", "Done": "done", "decision": "decisions", "todo": "next", "chat_history": "dialog", "сделано": "done", "Дальше": "next"}
MARK = " (обрезано: ещё есть данные в архиве)"


def clip(text, limit=300):
    text = re.sub(r"\s+", " ", text).strip()
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "…"


def brute_buckets(data):
    out = {b: [] for b in CAPS}

    def put(bucket, texts):
        for text in texts:
            if len(out[bucket]) == CAPS[bucket]:
                out[bucket][-1] = clip(out[bucket][-1] + MARK)
                return
            out[bucket].append(clip(text))

    for key, texts in data.items():
        if key in SIDE:
            put(SIDE[key], texts)
        else:
            for text in texts:
                put("other", [f"{key}: {text}"])
    return out


def random_session(rng):
    keys = rng.sample(KEYS, rng.randint(1, len(KEYS)))
    return {k: ["w" * rng.randint(1, 9) + " " * rng.randint(0, 2) + "v" * rng.choice([1, 5, 150, 299, 400]) for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 25]))] for k in keys}


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(7)
    data = [random_session(rng) for _ in range(60)]
    rows = [(i, f"agent_{i % 3}", f"2024010{1 + i % 9}_12{i:02d}", f"f{i}", "collapsed" if i % 10 == 9 else "archived", json.dumps(d, ensure_ascii=False)) for i, d in enumerate(data)]
    sessions = spark.createDataFrame(rows, "session_no bigint, agent_id string, session_ts string, file string, status string, data string")
    items = sessions.select("session_no", F.explode(session_items("data")).alias("i")).select("session_no", "i.*").cache()
    return data, sessions.cache(), items


def test_buckets_match_brute_force(archive):
    data, sessions, items = archive
    full = ss.with_buckets(sessions, ss.bucket_rows(items, ["session_no"]), ["session_no"])
    for r in full.collect():
        assert {b: r[b] for b in CAPS} == brute_buckets(data[r.session_no]), r.session_no


def test_hot_session_keeps_its_first_items(spark):
    """One session with most of the rows: same result, and the cut happens before the shuffle."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, 0).otherwise(F.col("id")).alias("session_no"), F.lit(0).alias("key_pos"),
        F.col("id").alias("item_pos"), F.lit("actions").alias("raw_key"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("item"))
    kept = ss.bucket_rows(rows.repartition(8), ["session_no"])
    hot = kept.where("session_no = 0").orderBy("pos").collect()
    assert [r.text for r in hot] == [f"item {i}" for i in range(9)] + ["item 9" + MARK]
    assert kept.count() == 10_010
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_summary_document(spark, archive):
    data, sessions, items = archive
    full = ss.with_buckets(sessions, ss.bucket_rows(items, ["session_no"]), ["session_no"])
    row = full.where("session_no = 3").select("*", ss.summary_text().alias("s")).first()
    lines = row.s.split("\n")
    assert lines[0] == "# Автосводка сессии (agent_0)" and lines[1].endswith("**Источник:** f3")
    for b, title in ss.SUMMARY_SECTIONS:
        assert (f"## {title}" in lines) == bool(row[b])
    empty = ss.with_buckets(sessions.limit(1), ss.bucket_rows(items.limit(0), ["session_no"]), ["session_no"])
    assert empty.select(ss.summary_text()).first()[0].endswith("\n\nСессия не содержит структурированных данных (архив пуст).")


def test_collapse(archive):
    data, sessions, items = archive
    for keep in (0, 1, 5):
        lines = ss.collapse_history(sessions, items, "session_no", keep).orderBy("agent_id", "section", "sort_key").collect()
        for agent in ("agent_0", "agent_1", "agent_2"):
            mine = sorted((f"2024010{1 + i % 9}_12{i:02d}", brute_buckets(d)) for i, d in enumerate(data) if i % 10 != 9 and f"agent_{i % 3}" == agent)
            folded = mine[: len(mine) - keep]
            decisions = list(dict.fromkeys(x for _, b in folded for x in b["decisions"]))
            got = [r.line for r in lines if r.agent_id == agent]
            assert sum(x.startswith("- **2024") for x in got) == len(folded)
            assert f"\n## Решения (агрегировано: {len(decisions)})" in got
            at = got.index(f"\n## Решения (агрегировано: {len(decisions)})")
            assert got[at + 1: at + 1 + min(10, len(decisions))] == [f"- {d}" for d in decisions[:10]]
            ts, b = folded[0]
            counts = ", ".join(f"{k}={len(v)}" for k, v in b.items() if v)
            assert got[4] == f"- **{ts}** — {b['done'][0] if b['done'] else '—'}" + (f" · ({counts})" if counts else "")
    report = {r.agent_id: r for r in ss.collapse_report(sessions, 100).collect()}
    assert report["agent_0"].status == "nothing_to_collapse" and report["agent_0"].collapsed == 0


def test_compress_shrinks_in_steps(archive):
    data, sessions, items = archive
    full = ss.with_buckets(sessions, ss.bucket_rows(items, ["session_no"]), ["session_no"]).withColumn("in_chars", F.length("data").cast("bigint"))
    for budget in (200, 1200, 2400, 5000, 100_000):
        for r in ss.compress(full, budget).collect():
            assert len(r.markdown) == r.out_chars <= budget
            assert len(r.done) <= 8 and len(r.other) <= 4
            assert r.ratio == pytest.approx(r.in_chars / r.out_chars, abs=0.051)
    upper = ss.compress(full, 5000, rewrite=lambda prompt: F.upper(prompt)).first()
    assert upper.llm.startswith("СОЖМИ") and "**Уровень сжатия:** 2" in upper.markdown
    plain = ss.compress(full, 5000).first()
    assert (plain.level, plain.llm, plain.llm_status) == (1, None, None) and ss.compress(full, 5000, level=2).first().llm_status == "skipped"


def test_a_failing_rewriter_leaves_level_one(archive):
    data, sessions, items = archive
    full = ss.with_buckets(sessions, ss.bucket_rows(items, ["session_no"]), ["session_no"]).withColumn("in_chars", F.length("data").cast("bigint"))

    def model(prompts):
        if any(len(p) % 2 for p in prompts):
            raise RuntimeError("odd")
        return [f"  {len(p)} " for p in prompts]

    rows = ss.compress(full, 5000, rewriter=rewriting.rewriter(model, 3)).collect()
    plain = {r.session_no: r.markdown for r in ss.compress(full, 5000).collect()}
    assert {r.llm_status for r in rows} == {"ok", "error"} and len(rows) == len(plain)
    for r in rows:
        if r.llm_status == "ok":
            assert r.level == 2 and int(r.llm) % 2 == 0 and "**Уровень сжатия:** 2" in r.markdown and r.llm_error is None
        else:
            assert r.level == 1 and r.llm is None and r.llm_error == "RuntimeError: odd" and r.markdown == plain[r.session_no]


def test_rewriter_of_odd_answers(spark):
    def model(prompts):
        return [None] if len(prompts) == 1 else []  # the wrong number, then nothing

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, t string")
    got = {r.i: r.x for r in df.select("i", rewriting.rewriter(model)(F.col("t")).alias("x")).collect()}
    assert got[1].text == got[3].text == "" and got[1].error is None and got[2] is None


def test_archive_stamps_number_clashes(spark):
    rows = [(i, "a" if i % 2 else "b", "20240101_1200" if i < 8 else "20240101_1201") for i in range(10)]
    df = spark.createDataFrame(rows, "n bigint, agent_id string, minute string")
    got = {r.n: r.session_ts for r in ss.archive_stamps(df, "n", "minute", block_rows=3).collect()}
    assert [got[i] for i in (0, 2, 4, 6, 8)] == ["20240101_1200", "20240101_1200_1", "20240101_1200_2", "20240101_1200_3", "20240101_1201"]


def test_latest_session_and_stamp_text_order(spark):
    df = spark.createDataFrame([("a", "20240101_1200_2", "archived"), ("a", "20240101_1200_10", "archived"), ("a", "20240102_0000", "collapsed")], "agent_id string, session_ts string, status string")
    assert ss.latest_session(df).first().session_ts == "20240101_1200_2"  # stamps compare as text


def test_stale_matrix(spark):
    rows = [("old", "20240101_0000", "archived"), ("fresh", "20240101_1150", "archived"), ("done", "20240101_0000", "summarized"),
            ("lost", "??", "archived"), ("edge", "20240101_0600", "archived")]
    df = spark.createDataFrame(rows, "agent_id string, session_ts string, status string")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert sorted(r.agent_id for r in ss.stale(df, now, 360).collect()) == ["lost", "old"]
    assert "fresh" in [r.agent_id for r in ss.stale(df, now, 0).collect()]  # at least one minute


def test_overflow_marks_fill_long_items(spark):
    """More repeats of the marker than a short item has room for."""
    limit, n = 2000, 90
    rows = [("s", 0, i, "misc", f"item {i}") for i in range(n)]
    items = spark.createDataFrame(rows, "sid string, key_pos int, item_pos int, raw_key string, item string")
    conf = Summaries(max_item_chars=limit)
    got = {r.pos: r.text for r in ss.bucket_rows(items, ["sid"], conf).collect()}
    want = "misc: item 9"
    for _ in range(n - conf.max_items):
        flat = " ".join((want + ss.OVERFLOW).split())
        want = flat if len(flat) <= limit else flat[: limit - 1].rstrip() + "…"
    assert len(got) == conf.max_items and got[conf.max_items] == want and len(want) == limit
