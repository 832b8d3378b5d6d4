import datetime as dt

import pytest

from recollect.memory import Memory
from recollect.streaming import ingest as ig


@pytest.fixture()
def memory(spark, tmp_path):
    clock = {"now": dt.datetime(2026, 9, 11, 3, 38)}

    def tick():
        clock["now"] += dt.timedelta(microseconds=1)
        return clock["now"]

    m = Memory(spark, str(tmp_path / "store"), clock=tick)
    m.later = lambda **kw: clock.__setitem__("now", clock["now"] + dt.timedelta(**kw))
    return m


def document(df):
    keys = [c for c in ("block", "section", "agent_id", "rank", "part") if c in df.columns]
    return "\n".join(r.line for r in df.orderBy(*keys).collect())


def test_notes_roundtrip(memory):
    first = memory.add_note("Vacuum tuning for Postgres", ["#db"], "p", "https://docs.python.org/3/")
    assert memory.add_note("Vacuum tuning for Postgres", ["#other"], "q") == first
    memory.add_note("Cats sleep", ["#cat"], agent_id="me", trust=7)
    assert [(r.project_id, r.trust) for r in memory.keyword_search("").collect()] == [("p", 1.0), (None, 1.0)]
    assert [r.chunk_id for r in memory.semantic_search("vacuum", 3).collect()] == [first]
    memory.add_note("Vacuum the cats", [])
    assert len(memory.semantic_search("vacuum cats", 5).collect()) == 3
    assert memory.index().rows().count() == 3 and memory.related(first).count() >= 1
    assert "[1] score=" in memory.context_prompt("vacuum").first().text


def test_writers_never_overwrite_each_other(spark, memory, tmp_path):
    folders = [tmp_path / "one", tmp_path / "two"]
    for f in folders:
        f.mkdir()
    memory.add_note("alpha words here", [])
    (folders[0] / "a.txt").write_text("first file text")
    memory.ingest(str(folders[0])).awaitTermination()
    memory.add_note("gamma words there", [])
    (folders[1] / "b.txt").write_text("second file text")
    memory.ingest(str(folders[1])).awaitTermination()
    (folders[0] / "c.txt").write_text("third file text")
    memory.ingest(str(folders[0])).awaitTermination()
    memory.ingest(str(folders[0])).awaitTermination()
    expected = ["alpha words here", "first file text", "gamma words there", "second file text", "third file text"]
    rows = memory.table("notes").orderBy("seq").collect()
    assert [r.content for r in rows] == expected and len({r.seq for r in rows}) == 5
    assert {memory.semantic_search(t, 1).first().chunk_id for t in expected} == {r.chunk_id for r in rows}
    # A batch that runs again replaces itself only, and the index follows.
    by_hand = [r for r in rows if r.writer == "notes"]
    again = spark.createDataFrame([(0, "delta words", [], None, None, None, "t", None)], "ord bigint, content string, tags array<string>, project_id string, source string, agent_id string, created_at string, trust double")
    ig.insert_notes(again, memory.path("notes"), by_hand[0].batch_id)
    left = sorted(r.content for r in memory.table("notes").collect())
    assert left == sorted(["delta words", *expected[1:]])
    assert sorted(r.chunk_id for r in memory.index().rows().collect()) == sorted(r.chunk_id for r in memory.table("notes").collect())


def test_session_life(memory):
    data = {"actions": ["built it"], "decisions": ["use X"], "next_steps": ["ship"]}
    assert memory.end_session("", data)["status"] == memory.end_session("a", {})["status"] == "invalid_input"
    stamps = []
    for i in range(3):
        out = memory.end_session("a", {**data, "actions": [f"step {i}"]}, "p")
        stamps.append(out["session_ts"])
        assert f"- step {i}" in out["summary"]
    assert stamps == ["20260911_0338", "20260911_0338_1", "20260911_0338_2"]
    assert {r.status for r in memory.sessions().collect()} == {"summarized"}
    assert memory.collapse("a", 1) == 2 and memory.collapse("a", 1) == 0
    assert "step 0" in memory.summarize("a", stamps[0])  # a named session leaves the latest summary in place
    memory.record_decision("p", "go", ["a", "b"], "because")
    text = document(memory.context("a", "p"))
    assert "- step 2" in text and "- **Decision:** go" in text and "# Проектный дайджест: p" in text
    assert memory.compress("a").first().markdown.startswith("# Сжатая сессия (a)")
    assert memory.decisions("p").first().n == 1


def test_auto_close(memory):
    memory.archive_session("a", {"done": ["x"]})
    assert memory.auto_close(60)["closed"] == 0
    memory.later(hours=2)
    memory.archive_session("b", ["fresh"])
    assert memory.auto_close(60)["closed"] == 1 and memory.auto_close(60)["closed"] == 0
    assert {(r.agent_id, r.status) for r in memory.sessions().collect()} == {("a", "summarized"), ("b", "archived")}


def test_watched_sessions(memory):
    memory.archive_session("a", {"done": ["x"]})
    memory.archive_session("b", {"done": ["y"]})
    memory.watch_sessions(60).awaitTermination()
    assert {r.status for r in memory.sessions().collect()} == {"archived"}
    memory.summarize("b")
    memory.later(hours=2)
    memory.archive_session("c", ["fresh"])
    for _ in range(2):
        memory.watch_sessions(60).awaitTermination()
        assert {(r.agent_id, r.status) for r in memory.sessions().collect()} == {("a", "summarized"), ("b", "summarized"), ("c", "archived")}
        assert memory.table("summaries").count() == 2


def test_tasks_and_ingest(memory, tmp_path):
    memory.start_task("t1", "a", "p", "do it")
    memory.start_task("t2", "a", "p")
    memory.cancel_task("t2")
    memory.end_task("t1", "a", {"done": ["finished"]}, "p")
    assert {(r.task_id, r.status) for r in memory.tasks().collect()} == {("t1", "completed"), ("t2", "cancelled")}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "n.md").write_text("# a\nb")
    memory.ingest(str(tmp_path / "raw")).awaitTermination()
    kinds = {(r.kind, r.name): r.n for r in memory.status().collect()}
    assert kinds == {("project", "general"): 1, ("author", "-"): 1, ("sessions", "a"): 1}


def test_scans_are_counted(memory, tmp_path):
    raw = tmp_path / "watched"
    raw.mkdir()
    assert memory.scan_totals().count() == 0
    with memory.scan_log(str(raw)) as log:
        for text in ("one", None):
            if text:
                (raw / "a.txt").write_text(text)
            query = memory.ingest(str(raw))
            query.awaitTermination()
            log.wait(query)
    total = memory.scan_totals().first()
    assert (total.scan_count, total.batches, total.empty_scans, total.failed_scans, total.rows, total.last_error) == (2, 1, 1, 0, 1, None)
    (raw / "b.txt").write_text("two")
    memory.ingest(str(raw)).awaitTermination()  # nobody listens
    assert memory.scan_totals().first().scan_count == 2


def test_a_broken_session_is_reported(memory):
    memory.archive_session("me", {"actions": ["built it"]}, "p")
    row = memory.table("archives").first().asDict()
    memory._append("archives", [tuple((row | {"session_ts": row["session_ts"] + "x", "data": "{"}).values())])
    memory.later(days=2)
    assert memory.auto_close(60) == {"checked": 2, "closed": 1, "errors": 1}
    assert memory.auto_close(60) == {"checked": 1, "closed": 0, "errors": 1}


def test_unknown_tasks_are_refused(memory):
    assert not memory.end_task("t9", "me", {"actions": ["x"]}) and not memory.cancel_task("t9")
    assert memory.sessions().count() == 0 and memory.tasks().count() == 0
    memory.start_task("t1", "me", "proj", "do it")
    assert memory.end_task("t1", session_data={"actions": ["did it"]})
    assert [(r.agent_id, r.project_id) for r in memory.sessions().collect()] == [("me", "proj")]
    done = memory.tasks().first()
    assert done.status == "completed" and done.result.stats["done"] == 1 and done.result.archive.endswith(".json") and not done.context_loaded
    memory.start_task("t2", "me", "proj", "more", model="m", variant="v", tags=["#x"])
    again = memory.tasks(status="running").first()
    assert again.context_loaded and "did it" in memory.context("me", "proj").where("block = 0").agg({"line": "max"}).first()[0] + again.context_preview
    assert (again.model, again.variant, again.tags) == ("m", "v", ["#x"])
    assert {(r.level, r.name, r.total_tasks) for r in memory.task_statistics().collect()} == {("total", None, 2), ("agent", "me", 2), ("project", "proj", 2)}
    assert memory.clear_tasks() == 2 and memory.tasks().count() == 0
