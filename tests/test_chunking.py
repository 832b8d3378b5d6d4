import re

from hypothesis import HealthCheck, given, settings, strategies as st

from recollect.operators import chunking as cg
from tests.helpers import evaluate


def plain(text, limit):
    out, buf, used = [], [], 0
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if buf and used + len(p) + 2 > limit:
            out.append("\n\n".join(buf))
            buf, used = [], 0
        buf.append(p)
        used += len(p) + 2
    return out + (["\n\n".join(buf)] if buf else [])


def markdown(text, limit):
    sections = [[]]
    for line in text.splitlines():
        if re.match(r"#{1,6}\s", line):
            sections.append([])
        sections[-1].append(line)
    out = []
    for lines in sections:
        whole = "\n".join(lines).strip()
        if len(whole) <= limit:
            out.append(whole)
            continue
        buf, used = [], 0
        for line in lines:
            if buf and used + len(line) + 1 > limit:
                out.append("\n".join(buf).strip())
                buf, used = [], 0
            buf.append(line)
            used += len(line) + 1
        out.append("\n".join(buf).strip())
    return [c for c in out if c]


TEXT = st.text(alphabet="ab#  \n\n\t", max_size=120)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=25), st.integers(3, 30))
def test_chunkers_match_brute_force(spark, texts, limit):
    assert evaluate(spark, texts, lambda c: cg.chunk_plain(c, limit)) == [plain(t, limit) for t in texts]
    assert evaluate(spark, texts, lambda c: cg.chunk_markdown(c, limit)) == [markdown(t, limit) for t in texts]


def test_size_edges(spark):
    texts = ["x" * 1200, "x" * 1201, "# h\n" + "y" * 1300, "a" * 599 + "\n\n" + "b" * 597, "a" * 599 + "\n\n" + "b" * 598, "\n \n\t\n", ""]
    assert evaluate(spark, texts, cg.chunk_plain) == [plain(t, 1200) for t in texts]
    assert evaluate(spark, texts, cg.chunk_markdown) == [markdown(t, 1200) for t in texts]


def test_ingest_statuses(spark):
    files = spark.createDataFrame([
        ("in/a.md", "---\ntags: [x]\nproject: p\nsource: s\n---\n# t\nbody"), ("in/b.txt", "hello"), ("in/c.gif", "zz"),
        ("in/d.txt", " \n"), ("in/e.md", "---\nk: v\n---\n"), ("in/f.csv", "a,b\n1"), ("in/g.html", "<p>hi</p>"), ("in/h.json", '{"a":1}'),
    ], "path string, raw string")
    rows = {r.path: r for r in cg.ingest(files).collect()}
    assert [rows[p].status for p in sorted(rows)] == ["ingested", "ingested", "skipped", "error", "error", "ingested", "ingested", "ingested"]
    a = rows["in/a.md"]
    assert (a.tags, a.project_id, a.source, a.chunks) == (["#x", "#source:markdown", "#doc"], "p", "s", ["# t\nbody"])
    assert rows["in/b.txt"].source == "in/b.txt" and rows["in/f.csv"].chunks == ["| a | b |\n|---|---|\n| 1 |  |"]
    assert rows["in/c.gif"].reason == "unsupported format .gif" and rows["in/d.txt"].reason == "empty content"
    assert rows["in/e.md"].reason == "no chunks produced"
    assert tuple(cg.ingest_report(cg.ingest(files)).first()) == (8, 5, 1, 2)
    assert cg.file_chunks(cg.ingest(files), "path").count() == 5
