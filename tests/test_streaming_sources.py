import hashlib
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from recollect.operators.common import first_by, number_in_group
from recollect.plans import fixtures as fx
from recollect.plans import stream_queries as sq
from recollect.plans.packaging import _docx, _epub
from recollect.session import work_dir
from recollect.settings import DEFAULTS, Settings, typed_value
from recollect.sources import documents as docs
from recollect.sources import files as fs
from recollect.sources import web as ws
from recollect.streaming import autoclose as ac
from recollect.streaming import ingest as ig
from tests.helpers import evaluate


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_stream_ingest_is_incremental(spark, tmp_path):
    raw, store, log, check = (str(tmp_path / d) for d in ("raw", "store", "log", "check"))
    put(tmp_path / "raw/a.md", "---\nproject: p\n---\n# one\nx\n# two\ny")
    put(tmp_path / "raw/sub/b.txt", "привет".encode("cp1251"))
    put(tmp_path / "raw/c.gif", "?")
    put(tmp_path / "raw/d.docx", _docx("para one\n\npara two"))

    def run():
        ig.start_ingest(spark, raw, store, log, check).awaitTermination()
        return ig.read_table(spark, store, ig.STORE_SCHEMA), ig.read_table(spark, log, ig.LOG_SCHEMA)

    notes, files = run()
    rows = notes.orderBy("seq").collect()
    assert [r.content for r in rows] == ["# one\nx", "# two\ny", "para one\n\npara two", "привет"]
    assert rows[0].project_id == "p" and rows[3].source == "sub/b.txt" and rows[3].tags == ["#source:text", "#doc"]
    put(tmp_path / "raw/e.md", "# two\ny\n# three\nz")
    put(tmp_path / "raw/f.txt", "  ")
    notes, files = run()
    rows = notes.orderBy("seq").collect()
    assert [r.content for r in rows][4:] == ["# three\nz"] and rows[4].seq > rows[3].seq
    totals = ig.running_totals(ig.batch_counts(files)).orderBy("batch_id").collect()
    assert [(r.scan_count, r.total_ingested, r.total_errors) for r in totals] == [(1, 3, 0), (2, 4, 1)]
    assert run()[0].count() == 5  # nothing new


def test_streams_of_tables_in_one_file_or_several(spark, tmp_path):
    docs = [(i, f"text {i % 30}", "en", f"s{i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.chunk_id, r.project_id, r.trust) for r in sq.stream_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((hashlib.md5(f"text {i}".encode()).hexdigest(), f"s{i}", 0.5) for i in range(30))
    put(tmp_path / "one/t.parquet", next((tmp_path / "documents.parquet").glob("part-*.parquet")).read_bytes())
    for sf, name, n in ((tmp_path, "documents", 40), (tmp_path / "one", "t", 10)):
        fx.table_stream(spark, str(sf), name).writeStream.format("parquet").option("path", f"{sf}/out").option("checkpointLocation", f"{sf}/check").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"{sf}/out").count() == n


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(300):
        put(tmp_path / f"raw/{i}/a.txt", f"text {i % 200}")
    query = ig.start_ingest(spark, *(str(tmp_path / d) for d in ("raw", "store", "log", "check")))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 256
    assert ig.read_table(spark, str(tmp_path / "store"), ig.STORE_SCHEMA).count() == 200


def test_raw_text_folder_holds_the_same_files(spark, tmp_path):
    texts = [None if i % 7 == 0 else "" if i % 11 == 0 else f"one {i}\n\nmore  " for i in range(180)]
    rows = [(i, t) for i, t in enumerate(texts) if not 60 <= i < 110]  # files with fewer than fifty documents
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    apart, flat = (Path(make(spark, str(tmp_path))) for make in (fx.raw_text_files, fx.raw_text_folder))
    assert sorted(p.read_bytes() for p in flat.glob("*.txt")) == sorted(p.read_bytes() for p in apart.rglob("*.txt"))
    assert len(list(flat.glob("*.txt"))) == 4


def test_watcher_lifecycle(spark, tmp_path):
    raw, store, log, check = (str(tmp_path / d) for d in ("raw", "store", "log", "check"))
    put(tmp_path / "raw/a.txt", "one")
    query = ig.start_ingest(spark, raw, store, log, check, archive_dir=str(tmp_path / "done"), poll_seconds=1)
    try:
        query.processAllAvailable()
        put(tmp_path / "raw/b.txt", "two")
        query.processAllAvailable()
        assert query.isActive and query.lastProgress is not None
    finally:
        query.stop()
    assert not query.isActive
    assert sorted(r.content for r in ig.read_table(spark, store, ig.STORE_SCHEMA).collect()) == ["one", "two"]
    assert list((tmp_path / "done").rglob("a.txt"))  # moved once its batch was complete


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = ig.create_table(spark, str(tmp_path / "s"), ig.STORE_SCHEMA)

    def notes(*texts):
        rows = [(i, t, ["#x"], None, None, None, "2024") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "ord bigint, content string, tags array<string>, project_id string, agent_id string, source string, created_at string")

    ig.insert_notes(notes("a", "b", "a"), store, 0)
    for _ in range(2):
        ig.insert_notes(notes("b", "c"), store, 1)
    rows = ig.read_table(spark, store, ig.STORE_SCHEMA).orderBy("seq").collect()
    assert [(r.content, r.batch_id) for r in rows] == [("a", 0), ("b", 0), ("c", 1)]


def test_idle_sessions_match_brute_force(spark):
    rng = random.Random(3)
    events = []
    for user in range(20):
        t = rng.randint(0, 10**6)
        for _ in range(rng.choice([1, 5, 200 if user else 2000])):
            t += rng.choice([0, 1, 600, 3599, 3600, 3601, 9000])
            events.append((user, t))
    want = []
    for user in range(20):
        times = sorted(t for u, t in events if u == user)
        start = prev = times[0]
        n = 0
        for t in times:
            if t - prev > 3600:
                want.append((user, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        want.append((user, start, prev, n))
    df = spark.createDataFrame(events, "u int, s bigint").select("u", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    got = ac.idle_sessions(df, "u", "ts", 60).select("u", second("started"), second("last_seen"), "events").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_extractors(spark):
    package = _epub("<h1>A</h1><p>b</p>")
    assert docs.docx_text(_docx("one\n\n two & three ")) == "one\n\ntwo & three"
    assert docs.epub_text(package) == "# A\n\nb\n\n# end"
    bad = [b"no zip", None]
    for extract in (docs.extract_docx, docs.extract_epub, docs.extract_pdf, docs.ocr_extract):
        assert evaluate(spark, bad, extract, "v binary") == ["", None]


def test_ocr_report(spark):
    df = spark.createDataFrame([("d/a.PNG", b"x"), ("d/b.txt", b"y")], "path string, content binary")
    assert [tuple(r) for r in docs.ocr_scan(df).collect()] == [("a.PNG", "failed", None, None)]


def test_scan_and_log_tail(spark, tmp_path):
    put(tmp_path / "x/b.md", "b")
    put(tmp_path / "x/y/a.TXT", "a")
    files = fs.scan_raw_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.path.split("/x/")[1], r.kind, r.length) for r in files] == [("b.md", "markdown", 1), ("y/a.TXT", "text", 1)]
    lines = [json.dumps({"ts": str(i), "level": "info", "msg": f"m{i}"}) for i in range(15)]
    lines[13:14] = ["{broken", "", lines[13]]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    tail = fs.log_tail(df, "line", "n").collect()
    assert [r.msg for r in tail] == [f"m{i}" for i in range(14, 4, -1)] and tail[0].level == "INFO"


def test_fetch_and_save_pages(spark):
    urls = spark.createDataFrame([("https://a.b/x",), ("https://a.b/x?2",), ("https://down.example/",)], "url string")
    pages = ws.fetch_pages(urls, get=lambda u: None if "down" in u else f"<head><title>T</title></head><p>{u[-1]}</p>").withColumn("n", F.when(F.col("url").endswith("2"), 2).otherwise(1))
    assert [(r.url[-7:], r.status, r.reason) for r in pages.where("status <> 'fetched'").collect()] == [("xample/", "failed", "unreachable")]
    assert ws.fetch_pages(spark.createDataFrame([("no url",)], "url string")).first().status == "failed"
    pages = pages.where("status = 'fetched'")
    saved = {r.n: r for r in ws.saved_pages(ws.page_report(pages), "n", F.lit("2024"), F.lit("web")).collect()}
    assert [saved[1].file, saved[2].file] == ["a_bx.html", "a_bx_1.html"]
    assert saved[2].document == "---\nsource: https://a.b/x?2\ntitle: T\nsaved_at: 2024\nproject: web\n---\n2"


def test_group_helpers_on_a_hot_key(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 2).alias("v"))
    numbered = number_in_group(df, ["k"], "id", F.floor(F.col("id") / 700), "n")
    hot = numbered.where("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in hot] == list(range(len(hot))) and numbered.count() == 20_000
    assert first_by(df, ["k"], "id", ["v"]).where("k = 'hot'").first()[1:] == (1, 2)


def test_settings():
    own = DEFAULTS.overlay({"digest": {"max_chunks": 3}, "trust": {"domains": ["a.b"]}})
    assert own.digest.max_chunks == 3 and own.digest.max_items == 4 and DEFAULTS.digest.max_chunks == 8
    assert Settings.from_json(own.to_json()) == own
    assert own.set("ingestion.max_chunk_chars", "900").get("ingestion.max_chunk_chars") == 900
    assert [typed_value(t) for t in ("None", "YES", "0", "1", "12", "1.5", "x")] == [None, True, False, True, 12, 1.5, "x"]


def test_work_dir_follows_the_session(spark):
    a, b = work_dir(spark, "t"), work_dir(spark, "t")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
