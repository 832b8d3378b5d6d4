import pytest

from recollect.operators import digest as dg
from recollect.operators import tasks as tk


@pytest.fixture(scope="module")
def world(spark):
    sessions = spark.createDataFrame(
        [(i, f"agent_{i % 2}", "p" if i < 18 else "q", f"202401{10 + i}_1000", f"f{i}", "collapsed" if i == 17 else "archived") for i in range(20)],
        "session_no bigint, agent_id string, project_id string, session_ts string, file string, status string")
    items = spark.createDataFrame([(i, 0, j, "actions", f"did {i}.{j}") for i in range(20) for j in range(6)],
                                  "session_no bigint, key_pos int, item_pos int, raw_key string, item string")
    decisions = spark.createDataFrame(
        [("p", i, f"choose {i}", ["x", "y"] if i % 2 else [], "why" if i % 3 else "", None if i == 0 else f"2024-01-{10 + i}T00:00:00") for i in range(12)],
        "project_id string, seq bigint, decision string, by_agents array<string>, reason string, recorded_at string")
    chunks = spark.createDataFrame(
        [(i, f"{i:032d}", "note " * 60 if i else " ", ["#t"], "p", None if i % 2 else "agent_1", None, 0.5, f"2024-01-{10 + i}T00:00:00") for i in range(10)],
        "seq bigint, chunk_id string, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string")
    return sessions, items, decisions, chunks


def document(df):
    keys = [c for c in ("block", "section", "agent_id", "rank", "part") if c in df.columns]
    return [r.line for r in df.orderBy(*keys).collect()]


def test_digest_document(world):
    lines = document(dg.project_digest(*world, "session_no", "p"))
    assert lines[0] == "# Проектный дайджест: p"
    assert lines[1] == "**Сессий:** 12 · **Агентов:** 2 · **Решений:** 8 · **Заметок:** 8"
    assert lines[4] == "\n### agent_0 (сессий: 6)" and lines[5] == "- **20240126_1000**"
    assert lines[6] == "    - Сделано: did 16.0; did 16.1; did 16.2; did 16.3"
    at = lines.index("\n## Совместные решения (8)")
    assert lines[at + 1] == "- 2024-01-21 **choose 11** — агенты: x, y" and lines[at + 2] == "    - Причина: why"
    assert any(x.endswith("**choose 10** — агенты: ?") for x in lines)
    notes = lines[lines.index("\n## Свежие заметки проекта (8)") + 1:]
    assert notes[0] == "- 2024-01-19: " + ("note " * 28).strip() + " …" and "(agent_1)" in notes[1]


def test_since_bounds(world):
    assert document(dg.project_digest(*world, "session_no", "p", since_ts="2024-01-26"))[1].startswith("**Сессий:** 1 ·")
    all_, bad = (document(dg.project_digest(*world, "session_no", "p", since_ts=s)) for s in (None, "soon"))
    assert all_ == bad  # a bound that does not parse does not bind
    later = "2030-01-01"
    assert document(dg.project_digest(*world, "session_no", "p", since_ts=later))[0].startswith("Нет данных по проекту `p`")
    assert document(dg.project_digest(*world, "session_no", "p", since_ts=later, empty_notice=False)) == []


def test_agent_choice(world):
    only = document(dg.project_digest(*world, "session_no", "p", only_agent="agent_1"))
    rest = document(dg.project_digest(*world, "session_no", "p", exclude_agent="agent_1"))
    assert "\n### agent_0 (сессий: 6)" not in only and "\n### agent_0 (сессий: 6)" in rest


def test_plan_computes_entries_once(world):
    df = dg.project_digest(*world, "session_no", "p")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_context_blocks(spark, world):
    sessions, items, decisions, chunks = world
    summaries = spark.createDataFrame([("agent_0", "S0")], "agent_id string, body string")
    folded = spark.createDataFrame([("agent_1", 0, "0", "C1")], "agent_id string, section int, sort_key string, line string")
    args = (summaries, folded, sessions, items, decisions, chunks, "session_no", "session_no")
    lines = document(dg.agent_context("agent_0", "p", *args))
    assert lines[:3] == ["S0", "---", "## Shared Project Knowledge (p)"]
    assert lines[3:6] == ["- **Decision:** choose 0", "  - **By Agents:** ", "  - **Reason:** \n"]
    assert "---" not in lines[3:]  # nothing newer than the agent's own last session
    assert document(dg.agent_context("agent_1", None, *args)) == ["C1"]
    assert document(dg.agent_context("nobody", "none", *args)) == []
    early = (summaries, folded, sessions.where("session_no < 2 or agent_id = 'agent_1'"), items, decisions, chunks, "session_no", "session_no")
    lines = document(dg.agent_context("agent_0", "p", *early))
    assert lines.count("---") == 2 and lines[lines.index("---", 2) + 1] == "# Проектный дайджест: p"


def test_decision_numbers(world):
    rows = dg.decisions_list(world[2], "p", block_rows=5).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 13)) and rows[1].by_agents == "x, y"


def test_task_lifecycle(spark):
    log = [("t1", "a", "p", "start"), ("t2", "b", "p", "start"), ("t1", "a", "p", "end"), ("t3", "a", "q", "start"), ("t3", "a", "q", "cancel"),
           ("ghost", "a", "p", "end"), ("t2", "b", "p", "cancel"), ("t2", "c", "q", "start")]
    events = spark.createDataFrame([(*e[:3], i, f"at{i}", e[3], "d") for i, e in enumerate(log)],
                                   "task_id string, agent_id string, project_id string, seq bigint, at string, action string, description string")
    tasks = tk.task_status(events)
    got = {r.task_id: (r.agent_id, r.status, r.started_at, r.ended_at) for r in tasks.collect()}
    assert got == {"t1": ("a", "completed", "at0", "at2"), "t2": ("c", "running", "at7", None), "t3": ("a", "cancelled", "at3", "at4")}
    assert tuple(tk.task_stats(tasks).first()) == (3, 1, 1, 1, 2, 2)
    agents = {r.agent_id: tuple(r)[1:] for r in tk.agent_stats(tasks, events).collect()}
    assert agents == {"a": (2, 0, 1, 1, "t3", "q"), "b": (0, 0, 0, 0, "t2", "p"), "c": (1, 1, 0, 0, "t2", "q")}
    assert sorted(map(tuple, tk.project_stats(tasks).collect())) == [("p", 1, 1), ("q", 2, 2)]
    assert sorted(map(tuple, tk.project_agents(tasks).collect())) == [("p", "a"), ("q", "a"), ("q", "c")]
    assert tk.filter_tasks(tasks, agent_id="a", status="cancelled").count() == 1


def test_task_log_fields(spark):
    def event(task, action, agent=None, project=None, context=None, archive=None, stats=None, tags=None):
        return (task, agent, project, None, "at", action, f"{action} it", "m", "v", tags, context, archive, stats)

    log = [
        event("old", "start", "x", "gone"), event(None, "clear"), event("t1", "start", "a", "p", "c" * 300, tags=["#x"]), event("t1", "end", archive="f1", stats={"done": 1}),
        event("t2", "start", "a", "p", ""), event("t2", "end", archive="f2", stats={"done": 2}), event("t2", "start", "b", "q", None), event("t2", "cancel"),
        event("t3", "start", "b", "q", "short"), event("t3", "end", archive="f3", stats={"done": 3}), event("t3", "end"), event("t3", "note"), event("old", "end"),
    ]
    events = spark.createDataFrame([(*e[:3], i, f"at{i}", *e[5:]) for i, e in enumerate(log)], tk.EVENT)
    got = {r.task_id: r for r in tk.task_log(events.repartition(3)).collect()}
    assert set(got) == {"t1", "t2", "t3"}
    t1, t2, t3 = (got[k] for k in ("t1", "t2", "t3"))
    assert (t1.context_loaded, t1.context_preview, t1.tags, t1.model, t1.variant) == (True, "c" * 200, ["#x"], "m", "v")
    assert (t1.status, t1.result.archive, t1.result.stats) == ("completed", "f1", {"done": 1})
    # Begun anew by another agent: the first result is forgotten.
    assert (t2.agent_id, t2.status, t2.result, t2.context_loaded, t2.context_preview, t2.tags) == ("b", "cancelled", None, False, None, [])
    assert (t3.status, t3.ended_at, t3.result.archive) == ("completed", "at10", "f3")
    stats = {(r.level, r.name): tuple(r)[2:] for r in tk.task_statistics(events).collect()}
    assert stats == {
        ("total", None): (3, 0, 2, 1, 2, 2, None, None), ("agent", "a"): (1, 0, 1, 0, None, None, "t2", "p"), ("agent", "b"): (2, 0, 1, 1, None, None, "t3", "q"),
        ("project", "p"): (1, 0, 1, 0, 1, None, None, None), ("project", "q"): (2, 0, 1, 1, 1, None, None, None),
    }
    none = tk.task_statistics(events.where("false")).collect()
    assert [tuple(r)[:3] for r in none] == [("total", None, 0)]
    # A log without the newer columns.
    short = tk.task_log(events.select("task_id", "agent_id", "project_id", "seq", "at", "action", "description")).where("task_id = 't1'").first()
    assert (short.status, short.result, short.tags, short.context_loaded) == ("completed", None, [], False)
