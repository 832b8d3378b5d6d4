import datetime as dt
import hashlib
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from recollect.functions import formats, html, items
from recollect.functions import text as tx
from recollect.functions import web
from tests.helpers import evaluate

BLANK_MIX = "a \x1f b \r\n\x0b\x85c\xa0\nd　\n\n\n\ne\rf\x1c "


def test_white_space_follows_unicode(spark):
    lines, tidy, flat = (evaluate(spark, [BLANK_MIX], f)[0] for f in (tx.lines_of, tx.normalize_ws, tx.one_line))
    assert lines == BLANK_MIX.splitlines()
    assert flat == re.sub(r"\s+", " ", BLANK_MIX).strip()
    assert tidy == re.sub("\n{3,}", "\n\n", "\n".join(x.rstrip() for x in BLANK_MIX.splitlines())).strip()


def test_lines_of_edges(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na"]
    assert evaluate(spark, texts, tx.lines_of)[1:] == [t.splitlines() for t in texts[1:]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ é ёЖ09_-.\n\t", max_size=40), min_size=1, max_size=20))
def test_tokens_and_features_match_python(spark, texts):
    got = evaluate(spark, texts, lambda c: tx.token_features(tx.tokens(c)))
    for text, features in zip(texts, got):
        words = re.findall("[а-яёa-z0-9]+", text.lower())
        assert features == words + [f"{a}_{b}" for a, b in zip(words, words[1:])]


def test_feature_hash(spark):
    words = ["alpha", "alpha_beta", "слово", "x"]
    slots = evaluate(spark, words, lambda c: F.array(tx.feature_slot(c, 512), tx.feature_sign(c)))
    for word, (slot, sign) in zip(words, slots):
        digest = hashlib.md5(word.encode()).hexdigest()
        assert slot == int(digest[:8], 16) % 512
        assert sign == (1 if int(digest[8:16], 16) % 2 == 0 else -1)


def test_truncate(spark):
    assert evaluate(spark, ["a  b\n c", "x" * 10, "x" * 11, "ab cdefghi jk"], lambda c: tx.truncate(c, 10)) == [
        "a b c", "x" * 10, "x" * 9 + "…", "ab cdefgh…"]


def test_norm_key(spark):
    assert evaluate(spark, ["Next Steps", " Сделано ", "done1", "ёлка"], tx.norm_key) == ["next_steps", "сделано", "done", "лка"]


def test_parse_time(spark):
    good = dt.datetime(2026, 9, 11, 3, 38)
    cases = {
        "20260911_0338": good, "20260911_0338_2": good, "20260911_0338_10": good,
        "2026-09-11T03:38:00": good, "2026-09-11 03:38:00": good, "2026-09-11": dt.datetime(2026, 9, 11),
        "2026-09-11T03:38:00.250": good.replace(microsecond=250000), " 2026-9-1 ": dt.datetime(2026, 9, 1),
        "2026-09-11T03:38:00+02:00": None, "2026-09-11 03:38:00.5": None, "20261341_0338": None,
        "garbage": None, "": None, None: None,
    }
    assert evaluate(spark, list(cases), tx.parse_time) == list(cases.values())


def test_file_kind(spark):
    paths = ["a/b.MD", "b.tar.gz", ".md", "x.jsonl", "d.v/name", "p.HTM", "i.tif", None]
    assert evaluate(spark, paths, tx.file_kind) == ["markdown", None, None, "jsonl", None, "html", "image", None]


def test_strip_front_matter(spark):
    raw = ["---\na: 1\n---\n\nbody ", "plain ", "---\nopen", "---\ntags: [x---y]\n---\nbody"]
    assert evaluate(spark, raw, tx.strip_front_matter) == ["body", "plain", "---\nopen", "y]\n---\nbody"]


def test_front_matter(spark):
    texts = [
        "---\ntags: [#a, \"b\", ]\nProject: 'p'\nsource: u:v\nproject: q\n---\n\nbody\n",
        "no header", "---\nkey: v", "---\n" + "k: v\n" * 60 + "---\nbody", "---", "---\ntags: ab\n---\nx",
    ]

    def view(c):
        m = tx.front_matter(c)
        e = m["entries"]
        return F.struct(tx.meta_list(e, "tags").alias("t"), tx.meta_value(e, "project").alias("p"),
                        tx.meta_value(e, "source").alias("s"), m["body"].alias("b"))

    got = [tuple(r) for r in evaluate(spark, texts, view)]
    assert got[0] == (["a", "b"], "q", "u:v", "body")
    assert [g[3] for g in got[1:5]] == texts[1:5]
    assert got[5] == (["a", "b"], None, None, "x")


def test_doc_tags(spark):
    got = evaluate(spark, [["a", "#doc"], [], ["#source:text"]], lambda c: tx.doc_tags(c, F.lit("text")), "v array<string>")
    assert got == [["#a", "#doc", "#source:text"], ["#source:text", "#doc"], ["#source:text", "#doc"]]


def test_sanitize_filename(spark):
    assert evaluate(spark, ["a<b>:c  d__e", "_x_", "y" * 100], tx.sanitize_filename) == ["a_b_c_d_e", "x", "y" * 80]


def test_decode_chain(spark):
    data = ["привет".encode(), "﻿x".encode(), "привет".encode("cp1251"), b"\xe9\x98", None]
    got = evaluate(spark, data, formats.decode_text, "v binary")
    assert got == ["привет", "﻿x", "привет", "é\x98", None]


def test_json_and_csv(spark):
    assert evaluate(spark, ['{"a":[1,"é"]}', " {bad "], formats.normalize_json) == ['{\n  "a": [\n    1,\n    "é"\n  ]\n}', "{bad"]
    raw = ['name, age\nA,1,9\n"B, C"\n\n', ""]
    assert evaluate(spark, raw, formats.csv_to_markdown) == ["| name | age |\n|---|---|\n| A | 1 |\n| B, C |  |\n|  |  |", ""]


def test_html_to_text(spark):
    page = "<head><title>T</title></head><h1>A &amp; B</h1><p>x<br>y</p><script>var t='</p>';</script><ul><li>i</li></ul><div/>z"
    assert evaluate(spark, [page], html.html_to_text) == ["# A & B\n\nx\ny\n\ni\n\nz"]


def test_main_content_handles_nesting(spark):
    page = "a<nav>b<nav>c</nav>d</nav>e<svg>x</svg><header>h</header></header>f"
    want = "a\n---\n\n---\n\n---\n\n---\ne\n---\n\n---\nf"
    assert evaluate(spark, [page], html.html_main_content) == [want]


def test_title_and_icon(spark):
    pages = ["<TITLE lang=x>\n Hi </TITLE>", "<p>none</p>", '<title></title><link href="i/favicon.ico">']
    assert evaluate(spark, pages, web.html_title) == ["Hi", "Untitled", "Untitled"]
    icons = evaluate(spark, pages, lambda c: web.favicon(c, F.lit("https://a.b/c/d.html?q=/x")))
    assert icons == [None, None, "https://a.b/c/i/favicon.ico"]


def test_url_filename(spark):
    urls = ["https://www.ex.com/a/b c?q=1", "http://ex.com", "http://ex.com/p/;v=1", "https://ex.com/a__b//c.html#f"]
    assert evaluate(spark, urls, web.url_filename) == ["ex_coma_b_c.html", "ex_comindex.html", "ex_comp.html", "ex_coma_b_c.html.html"]


def test_session_items(spark):
    docs = [
        '{"chat": [{"role": "user", "content": " hi "}, {"author": "x", "text": "yo"}, ["n", null, 3]], "m": {"a": 1, "b": true, "c": ""}}',
        '"just text"', '["a", {"note": "b"}, ""]', "null",
    ]
    got = [[(r.key_pos, r.item_pos, r.raw_key, r.item) for r in rows] for rows in evaluate(spark, docs, items.session_items)]
    assert got[0] == [(0, 0, "chat", "[user] hi"), (0, 1, "chat", "[x] yo"), (0, 2, "chat", "n"), (0, 3, "chat", "3"), (1, 0, "m", "a: 1; b: True")]
    assert got[1:] == [[(0, 0, "done", "just text")], [(0, 0, "done", "a"), (0, 1, "done", "b")], []]


def test_stored_form_of_a_note(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    note = tx.render_note(lit("body"), F.array(lit("#a"), lit("#\u0431"), lit('q"')), lit("p"), none, lit("me"), lit(1.0), lit("2024"))
    assert spark.range(1).select(note).first()[0].lower() == (
        '---\ntags: ["#a", "#\\u0431", "q\\""]\nproject_id: p\nagent_id: me\ntrust: 1.0\ncreated_at: 2024\n---\n\nbody')


def test_odd_records_are_values(spark):
    odd = ["<p>a<![foo[x]]>b", "<p>a<![%[x", "plain"]
    assert evaluate(spark, odd, html.html_to_text)[2] == "plain"
    assert all(isinstance(v, str) for f in (html.html_to_text, html.html_main_content) for v in evaluate(spark, odd, f))
    deep = "[" * 100_000 + "]" * 100_000
    assert evaluate(spark, [deep], formats.normalize_json) == [deep]
    assert evaluate(spark, [deep, "{", None], items.session_items) == [None, None, None]
    nested = '{"a": ' + "[" * 500 + '"x"' + "]" * 500 + "}"
    assert [r.item for r in evaluate(spark, [nested], items.session_items)[0]] == ["x"]
