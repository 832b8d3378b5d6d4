"""Auto-close of archives by timers: order, repeats, restarts and forgetting, against a plain form."""

import datetime as dt
import random

from recollect.streaming import archives as ar

START = dt.datetime(2024, 1, 1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


class Stream:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.raw, self.checkpoint, self.options, self.got = spark, str(tmp_path / "raw"), str(tmp_path / "checkpoint"), options, []

    def put(self, *rows):
        full = [(a, s, kind, at(m), *(("p", f"{a}/{s}") if kind == "archive" else (None, None))) for a, s, kind, m in rows]
        self.spark.createDataFrame(full, ar.EVENT).coalesce(1).write.mode("append").parquet(self.raw)

    def run(self):
        events = self.spark.readStream.schema(ar.EVENT).option("maxFilesPerTrigger", 1).parquet(self.raw)
        before = len(self.got)
        ar.start_autoclose(events, lambda due, _: self.got.extend(due.collect()), self.checkpoint, 60, "5 minutes", **self.options).awaitTermination()
        return sorted((r.agent_id, r.session_ts) for r in self.got[before:])


def test_timers_over_batches_and_restarts(spark, tmp_path):
    s = Stream(spark, tmp_path)
    # "late" is summarized before its archive is seen, "edge" at the last moment, "over" a minute after.
    s.put(("a", "plain", "archive", 0), ("a", "late", "summary", 10), ("b", "edge", "archive", 3), ("b", "over", "archive", 4), ("b", "plain", "archive", 5))
    s.put(("a", "late", "archive", 9), ("a", "plain", "archive", 30), ("b", "plain", "summary", 40), ("z", "", "tick", 41))
    assert s.run() == []
    s.put(("b", "edge", "summary", 63), ("b", "over", "summary", 65))
    assert s.run() == [("a", "plain")]
    s.put(("z", "", "tick", 80))
    assert s.run() == [("b", "over")]
    row = s.got[-1]
    assert (row.project_id, row.file, row.archived_at, row.due_at) == ("p", "b/over", at(4), at(64))
    # Repeats after the end tell nothing again.
    s.put(("a", "plain", "archive", 90), ("b", "over", "summary", 91), ("b", "plain", "archive", 92), ("z", "", "tick", 200))
    assert s.run() == []


def test_equals_the_rule_on_random_events(spark, tmp_path):
    r = random.Random(7)
    rows, want = [], []
    for k in range(60):
        name, opened = (f"a{k % 4}", f"s{k}"), r.randrange(0, 300)
        rows += [(*name, "archive", opened)] + [(*name, "archive", opened + r.randrange(0, 50))] * r.randrange(0, 2)
        summed = [opened + r.choice([5, 59, 60, 61, 90])] * r.randrange(0, 2)
        rows += [(*name, "summary", m) for m in summed]
        if not any(m <= opened + 60 for m in summed) and opened + 60 <= 400 - 5:
            want.append(name)
    rows = sorted([*rows, ("z", "", "tick", 400)], key=lambda x: x[3])
    rows = [x for x in rows if x[3] <= 400]
    s = Stream(spark, tmp_path)
    for part in range(3):
        s.put(*[x for i, x in enumerate(rows) if i * 3 // len(rows) == part])
    s.run()
    assert sorted((x.agent_id, x.session_ts) for x in s.got) == sorted(want)
