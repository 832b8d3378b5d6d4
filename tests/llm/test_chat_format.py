"""Operator 12 on odd rows, against a plain Python form."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from recollect.llm import chat_format as cf

T = cf.DEFAULT
TEXTS = [
    "", "plain", "</s>[INST] ok [/INST]", "␛", "␛␛␛", "<␛/s>", "a␛</s>␛<|turn|>", "<<|turn|><|end|>", "<|says|>x\n", "<", "[", "[INST", "<<SYS>><</SYS>>", "line\nline", "日本 <|im_end|>" * 3, "x" * 200_000,
]


def plain_escape(text):
    out, text = [], text.replace(T.escape, T.escape * 2)
    for i, c in enumerate(text):
        out.append(c)
        if any(text.startswith(m, i) for m in T.controls):
            out.append(T.escape)
    return "".join(out)


def test_escape_is_reversible_and_leaves_no_mark(spark):
    texts = TEXTS + ["".join(x) for x in itertools.product(["<", "/s>", "␛", "[INST]", "|turn|>"], repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", cf.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and r.e == plain_escape(r.t)
        assert not any(m in r.e for m in T.controls)


def test_texts_in_a_row_make_no_mark(spark):
    cuts = [[m[:i], m[i:]] for m in T.controls for i in range(1, len(m))] + [["<", "", "/s>"], ["<", "␛/s>"], ["<<", "SYS>>"], ["<␛", "/s>"]]
    rows = [(i, 0, "assistant", [("text", t, None, None, None, None, None) for t in parts]) for i, parts in enumerate(cuts)]
    turns = cf.format_turns(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{cf.PART}>"))
    found = cf.format_conversations(turns)
    for r in found.select("conv", "turns", cf.read_turns(cf.conversation_text(F.col("turns"))).alias("back"), cf.read_loss(F.col("turns")).alias("loss")).collect():
        body = r.turns[0].formatted.removeprefix("<|turn|>assistant<|says|>").removesuffix("<|end|>")
        assert not any(m in body for m in T.controls)
        assert r.back[0].text == r.loss == "".join(cuts[r.conv])


@pytest.fixture(scope="module")
def rows():
    conversations = {c: [("user" if t % 2 == 0 else "assistant", TEXTS[(c * 5 + t) % len(TEXTS)]) for t in range(c % 4 + 1)] for c in range(12)}
    out = [(c, t, role, text, "mine") for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    # Out of order, a NULL turn, role, text and conversation, and a repeated row.
    return out[::-1] + [(50, None, "system", "first", "m"), (50, 0, None, "no role", "m"), (50, 1, "assistant", None, "m"), (None, 0, "assistant", "lost", "m")] + [(51, 0, "assistant", "twice", "m")] * 2


def test_conversations(spark, rows):
    # Columns named like the operator's own.
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").withColumn("n_tokens", F.lit("x")).repartition(4)
    got = {r.conv: r for r in cf.digests(cf.format_conversations(cf.format_turns(df, parts=cf.text_parts(F.col("text"))))).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    assert len(got) == len({r[0] for r in rows})
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        text = "".join(T.turn + plain_escape(role) + T.says + plain_escape(t) + T.end for role, t in turns)
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].formatted_chars) == (len(turns), len(loss), len(text))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    parts = [
        part("text", "see "), part("image", ref="a.png", width=57, height=28), None, part("image", ref=None), part("text", "and </s>"), part("audio", ref="b.wav", seconds=2.0), part("audio"),
        part("document", ref="c.pdf", pages=3), part("video", ref="d.mp4"), part(None), part("text"),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], f"conv_id int, turn int, role string, parts array<{cf.PART}>")
    first, none, empty = cf.format_turns(df).orderBy("turn").collect()
    assert first.formatted == "<|turn|>assistant<|says|>see <|image|><|image|>and <␛/s><|audio|><|audio|><|document|><|attachment|><|attachment|><|end|>"
    assert [tuple(a) for a in first.attachments] == [
        (0, "image", "a.png", 3), (1, "image", None, 256), (2, "audio", "b.wav", 25), (3, "audio", None, 0), (4, "document", "c.pdf", 3072), (5, "video", "d.mp4", 0), (6, "unknown", None, 0)]
    assert first.n_tokens == 3 + 256 + 25 + 3072
    assert [first.formatted[s.start: s.start + s.length] for s in first.loss] == ["see ", "and <␛/s>"]
    assert none.formatted == empty.formatted == "<|turn|>user<|says|><|end|>" and not none.loss and not empty.attachments


def test_visitors_of_new_kinds(spark):
    class Tables(cf.Visitor):
        def visit_table(self, part):
            return self._seen(part, F.lit("<|attachment|>"), F.lit("table"), F.lit(7))

    df = spark.createDataFrame([(1, 0, "user", [("table", None, "t", None, None, None, None)])], f"conv_id int, turn int, role string, parts array<{cf.PART}>")
    assert cf.format_turns(df, visitor=Tables()).first().n_tokens == 7


def test_native_plan_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    found = cf.digests(cf.format_conversations(cf.format_turns(df, parts=cf.text_parts(F.col("text")))))
    assert found.count() == 0
    plan = spark.range(1).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    text = cf.digests(cf.format_conversations(cf.format_turns(plan, parts=cf.text_parts(F.col("text")))))._jdf.queryExecution().toString()
    assert "Python" not in text and "InArrow" not in text


def test_marks_are_checked():
    with pytest.raises(ValueError):
        cf.Template(turn="<|turn|>", says="<|turn|>x")
    with pytest.raises(ValueError):
        cf.Template(end="a␛")
