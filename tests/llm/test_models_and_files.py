"""Operators 3, 4, 6, 7, 8 and 9 on odd rows."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import html_main_text as hm
from recollect.llm import metric_search as ms
from recollect.llm import piece_sampling as ps
from recollect.llm import quality
from recollect.llm import token_counts as tc
from recollect.llm import token_files as tf
from recollect.llm.word_ids import WordEncoder

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, "Hello, world!", "hello   WORLD", "don't 's 'RE ,'re a,'re x'", "<|endoftext|> and <|STARTOFTEXT|>", "tab\tnew\nline\x0b\x1c", "日本語 ünï é ▁ mark 🎉🎉", "word " * 5000,
    "x" * 3000, "ÀÉÎ ÇA 123 4.5 a1b2", " nbsp　wide", "~~~ ***a***b!!", "a", " lead and trail ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "mine") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "mine")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(3)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_word_encoder_equals_the_library():
    encoder, plain = WordEncoder(WORD_BPE), library()
    for _ in range(2):  # once to learn, once from memory
        ids, before = encoder.encode(pa.array(TEXTS))
        for text, a, b in zip(TEXTS, before[:-1], before[1:]):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    calm = [t for t in TEXTS if "<|" not in (t or "")]
    ids, before = encoder.encode(pa.array(calm))
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in calm]


def test_token_counts_and_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    plain = library()
    want = {t: len(plain.encode(t or "", add_special_tokens=False).ids) for t in TEXTS}
    for _ in range(2):
        got = tc.token_counts(docs, WORD_BPE, cache, normalise=tc.collapsed_space).collect()
        assert len(got) == len(TEXTS) + 1 and all(r.n_tokens == want[r.text] and r.n_bytes == len((r.text or "").encode()) for r in got)
        cached = spark.read.parquet(cache)
        assert cached.count() == cached.select("digest").distinct().count()  # the second call encodes nothing
    for row in tc.token_counts(docs, WORD_BPE, str(tmp_path / "by-word"), normalise=tc.collapsed_space, by_word=True).collect():
        assert row.n_tokens == want[row.text]
    other = tc.token_counts(docs, PIECES, cache).where("text = 'a'").first()
    import sentencepiece

    assert other.n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("a"))
    assert tc.token_counts(docs.where("false"), WORD_BPE, cache).count() == 0


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], list(range(1003))])
def test_coding_round_trip(values):
    control, data = tf.pack(np.array(values, np.uint32))
    assert tf.unpack(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_token_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 100)
    path = str(tmp_path / "ids")
    tf.write_token_files(docs, WORD_BPE, 2, path)
    rows = tf.crc32(tf.read_token_files(spark, path)).orderBy("start").collect()
    plain = library()
    order = [TEXTS[3]] + [t for i, t in enumerate(TEXTS) for _ in range(1 + (i == 2)) if i != 3]
    start = 0
    for row, text in zip(rows, order):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(order)
    empty = str(tmp_path / "none")
    tf.write_token_files(docs.where("false"), WORD_BPE, 2, empty)
    assert tf.read_token_files(spark, empty).count() == 0


def test_pieces_lossless_and_reproducible(spark, docs):
    one = ps.decoded(ps.with_sampled_pieces(docs, PIECES), PIECES)
    rows = one.collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(TEXTS) + 1
    assert all(r.ok for r in ps.with_sampled_pieces(docs, PIECES, checked="ok").collect())
    vocab, texts = ps.vocabulary(PIECES), pa.array(["some text", "", "more"])
    ids, before = ps.sample_ids(vocab, texts, np.arange(3))
    assert ps.decodes_to(vocab, ids, before, pa.array(["some text", "", "mare"])).tolist() == [True, True, False]
    assert ps.decodes_to(vocab, ids, before, pa.array(["some texts", "", "more"])).tolist() == [False, True, True]
    again = ps.with_sampled_pieces(docs.repartition(1).orderBy(F.desc("doc_id")), PIECES).collect()
    assert sorted((str(r.doc_id), r.text or "", tuple(r.piece_ids)) for r in rows) == sorted((str(r.doc_id), r.text or "", tuple(r.piece_ids)) for r in again)
    assert ps.with_sampled_pieces(docs.where("false"), PIECES).count() == 0


def test_sampling_follows_the_lattice():
    import sentencepiece

    model, vocab = sentencepiece.SentencePieceProcessor(model_file=PIECES), ps.vocabulary(PIECES)
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())}
    word, paths = "▁those", []

    def walk(at, path):
        if at == len(word):
            paths.append(tuple(path))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in pieces:
                walk(end, [*path, pieces[word[at:end]]])

    walk(0, [])
    weights = np.array([math.exp(0.5 * sum(vocab.scores[p] for p in path)) for path in paths])
    n = 50_000
    ids, before = ps.sample_ids(vocab, pa.array(["those"] * n), np.arange(n), 0.5)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(before[:-1], before[1:]))
    assert set(seen) <= set(paths)
    for path, p in zip(paths, weights / weights.sum()):
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_top_products(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0, 2.0]), (2005, []), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = df.select("vec_id", ms.quantised(F.col("embedding")).alias("vector"))
    got = collections.defaultdict(list)
    for x in ms.top_products(vectors, vectors.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    sound = {i: [math.floor(256 * v) for v in e] for i, e in rows if i is not None and i not in (2000, 2001, 2002, 2003)}
    for q in (i for i in sound if i % 20 == 0):
        scored = sorted(((sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q), key=lambda s: (-s[0], s[1]))
        assert got[q] == [(i, s) for s, i in scored[:5]], q
    few = vectors.where("vec_id < 3")
    assert ms.top_products(few, few, 5).count() == 6 and ms.top_products(vectors.where("false"), few, 5).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies and that is the way it is for all of us here.</div><article><h1>Title &amp; more</h1><p>First&nbsp;paragraph
 of <b>it</b>.<p>Second one<br>goes on &#233; here.<aside>Side</aside><form><input name=q><button>Go</button></form><div class="comments"><p>A reader said that it was the best of all.</div>
<p>Short.</article><footer>&copy; me</footer></body></html>"""


def test_main_text_of_an_article():
    assert hm.main_text(PAGE) == "Title & more\nFirst paragraph of it.\nSecond one goes on é here.\nShort."


def test_main_text_without_marks():
    said = "The cat is on the mat and it was very much what we had wanted from the long day of the year, that is."
    page = f'<div id="header">Top</div><h2>A title</h2><p>{said}</p><p>Short one.</p><p>{said}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>Words<p class="sidebar">{said}'
    assert hm.main_text(page) == f"A title\n{said}\nShort one.\n{said}"


@pytest.mark.parametrize("page", [None, "", "<", "<<<<", "<![foo[x]]>", "<![%[x", "<p", "<!-- open", "<script>x", '<a "', "</p></div>", "&#xffffff; &bogus;", "<div>" * 5000])
def test_broken_pages_never_fail(page):
    assert isinstance(hm.main_text(page), str)


def test_unclosed_advert_keeps_the_article():
    assert hm.main_text('<div class="ad">buy<article><p>a <p>b</article>') == "a\nb"


def test_an_article_is_a_prior_and_density_decides():
    said = "The cat is on the mat and it was very much what we had wanted from the long day of the year, that is."
    card = '<article><h3><a href="/o">Another page to read</a></h3><p>Read on.</article>'
    assert hm.main_text(f"<div><h1>A title</h1><p>{said}</p><p>Short one.</p><p>{said}</p></div>{card}") == f"A title\n{said}\nShort one.\n{said}\nAnother page to read\nRead on."
    assert hm.main_text('<article><h1><a href="/me">A title</a></h1><p>One line.<p>Two lines.<p><a href="/n">Next page</a></article>') == "A title\nOne line.\nTwo lines."
    links = "<h4>More</h4><ul>" + "".join(f'<li><a href="/{i}">Page number {i}</a>' for i in range(4)) + "</ul>"
    assert hm.main_text(f"<article><h1>A title</h1><p>{said}<p>Few dull words</p><p>{said}</p>{links}</article>") == f"A title\n{said}\nFew dull words\n{said}"
    code = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega psi chi"
    assert hm.main_text(f"<article><p>{said}</p><pre>{code}</pre></article>") == f"{said}\n{code}"


@pytest.mark.parametrize("tag", ["svg", "math", "iframe", "object", "select", "canvas", "audio", "video", "title"])
def test_elements_without_text_end_where_they_end(tag):
    for gap in (f'<{tag} a="b"/>', f"<{tag}>", f"<{tag}/>", f"<{tag} a='b' />b <{tag}>gone</{tag}>"):
        assert hm.main_text(f"<article><p>Before {gap} after.</p><p>The end.</p></article>").replace(" b ", " ") == "Before after.\nThe end."
    for gap in (f"<{tag}>gone</{tag}>", f"<{tag}>gone<{tag}>gone</{tag}>gone</{tag}>", f'<script>"</{tag}>"</script><{tag}>gone<script>"</{tag}>"</script>gone</{tag}>'):
        assert hm.main_text(f"<article><p>Before {gap} after.</p><p>The end.</p></article>") == "Before after.\nThe end."
    assert hm.main_text(f"<{tag}>" * 20_000 + "<article><p>Still here.") == "Still here."


def test_names_of_headlines_in_an_article():
    for head in ('<header class="entry-header"><h1>A title</h1></header>', '<h1 class="page-header">A title</h1>', '<div id="post_header"><h1 class="notice">A title</h1></div>'):
        page = f'<div class="header">Top</div><article>{head}<p class="legal">It was so.</p><div class="site-header comments">Gone</div><div class="header-ad">Gone</div></article>'
        assert hm.main_text(page) == "A title\nIt was so."
    said = "The cat is on the mat and it was very much what we had wanted from the long day of the year, that is."
    assert hm.main_text(f'<h1 class="page-header">A title</h1><p>{said}</p>') == f"A title\n{said}"


def test_main_text_column(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    rows = hm.with_main_text(df).orderBy("page_id").collect()
    assert rows[0].text.startswith("Title") and rows[1].text == "" and rows[0].html == PAGE


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.3
    accuracy = [0.95, 0.9, 0.7, 0.85]
    votes = np.stack([np.where(r.random(20_000) < 0.2, -1, np.where(r.random(20_000) < a, truth, ~truth)) for a in accuracy], 1)
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(pattern, counts.astype(float))
    assert np.abs(model.accuracy - accuracy).max() < 0.05 and abs(model.share - 0.3) < 0.05


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.with_quality(docs.select("doc_id", "text"), quality.train(docs)).join(labels, "doc_id").collect()
    right = [(r.junk_score >= 0.5) == (r.quality == 0) for r in judged]
    assert np.mean(right) > 0.97
    assert np.mean([r.keep for r in judged if r.quality == 1 and r.toxic == 0]) > 0.98


def test_quality_of_odd_rows(spark, docs):
    rows = quality.with_quality(docs, quality.train(docs)).collect()
    assert len(rows) == len(TEXTS) + 1 and not any(r.keep for r in rows if not (r.text or "").strip())
    none = docs.where("false")
    assert quality.with_quality(none, quality.train(none)).count() == 0


def test_abuse_in_other_languages_is_learnt_from_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("pmod(xxhash64(doc_id, 'held out'), 2) = 0")
    scorer = quality.train(docs.select("doc_id", "text"), labels=known)
    judged = quality.with_quality(docs, scorer).join(labels.join(known, "doc_id", "left_anti"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.keep for r in judged if r.toxic and r.lang == lang]
        clean = [r.keep for r in judged if not r.toxic and r.quality and r.lang == lang]
        print(lang, "toxic", len(toxic), "gone", len(toxic) - sum(toxic), "clean", len(clean), "kept", sum(clean))
        assert 1 - np.mean(toxic) > 0.85 and np.mean(clean) > 0.98


@pytest.mark.parametrize("toxic", [0, 1, 6, 60])
def test_rare_abuse_goes_and_clean_texts_stay(spark, toxic):
    r = np.random.default_rng(1)
    words = np.array("the house of a river and in is that was to for on with as long green quiet market paper winter garden engine letter".split())
    insults = sorted(set(quality.INSULTS) | set(quality.CONTEMPT))
    texts = [" ".join(r.choice(words, 40)) for _ in range(3000)]
    texts[:toxic] = [f"{t} you {insults[i % len(insults)]} {insults[7 * i % len(insults)]}" for i, t in enumerate(texts[:toxic])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    judged = quality.with_quality(docs, quality.train(docs)).collect()
    assert {r.doc_id for r in judged if r.abuse_score >= 0.5} == set(range(toxic)) and not any(r.keep for r in judged if r.doc_id < toxic)
