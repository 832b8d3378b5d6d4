"""Words as the operators take them: hashes that do not collide by structure, and tokens that equal the library's."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recollect.llm import decontamination, jaccard_join, substring_dedup
from recollect.llm import texts as tx
from recollect.llm.word_ids import WordEncoder
from tests.llm import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SF = Path("/root/testdata/sf0.01/documents.parquet")


def complementary(n):
    """Two words of n characters that every polynomial with an odd base confuses modulo 2**64 from n = 1024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(words):
    data, offsets = tx.text_bytes(pa.array(words))
    return tx.span_hashes(data, offsets[:-1], offsets[1:])


def test_hashes_of_long_complementary_words():
    for n in (8, 64, 248, 256, 264, 1024, 2048, 4096):
        a, b = hashes(complementary(n))
        assert a != b


def test_hashes_see_every_byte_and_the_length():
    r = random.Random(1)
    words = {"", "a"} | {"\0" * n for n in range(1, 300)} | {"x" * n for n in range(300)}
    for n in (1, 7, 8, 9, 63, 255, 256, 257, 1000):
        base = "".join(r.choice("abcdef") for _ in range(n))
        words |= {base} | {base[:i] + "Z" + base[i + 1:] for i in range(n)}
    words = sorted(words)
    found = hashes(words)
    assert len(np.unique(found)) == len(words)
    # The same wherever a word stands, and another with another seed.
    assert hashes(words[::-1])[::-1].tolist() == found.tolist()
    data, offsets = tx.text_bytes(pa.array(words))
    assert not np.isin(tx.span_hashes(data, offsets[:-1], offsets[1:], 1)[1:], found).any()


def test_word_numbers_are_exact():
    texts = pa.array(["a b a", "", None, "b c\ta", "ä a"])
    data, offsets = tx.text_bytes(texts)
    starts, ends, _ = tx.word_spans(data, offsets, tx.SPACED)
    assert tx.word_ids(data, starts, ends).tolist() == [0, 1, 0, 1, 2, 0, 3, 0]


@pytest.mark.parametrize("n", [1024, 4096])
def test_operators_tell_long_words_apart(spark, n):
    x, y = complementary(n)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(docs).collect()}
    assert removed == {d: gone for d, (_, _, _, gone) in zip((1, 2, 3), brute.words_kept(rows))} and removed[2] == 0
    words = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(words).collect()} == {1: 1, 2: 2, 3: 1}
    item = spark.createDataFrame([("i", x)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(docs, item).collect()} == {1: 1, 2: 0, 3: 1}


def check_tokens(texts):
    from tokenizers import Tokenizer

    encoder, plain = WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for at in range(0, len(texts), 2_000):
        part = texts[at: at + 2_000]
        ids, before = encoder.encode(pa.array(part))
        want = plain.encode_batch_fast(part, add_special_tokens=False)
        wrong = [t for t, a, b, w in zip(part, before[:-1], before[1:], want) if ids[a:b].tolist() != w.ids]
        assert not wrong, wrong[:5]


def test_tokens_of_combining_marks_equal_the_library():
    r = random.Random(9)
    parts = ["H", "h", "T", "J", "W", "Y", "al-H", "e", "E", "ß", "İ", "ı", "ﬁ", "가", "ᄀ", "ᅡ", "日", "🎉", "'", "'s", ".", "-", " ", "  ", "\t", "\n", " ", "1", "12", "a1", "_", "Å"]
    marks = [chr(c) for c in (0x300, 0x301, 0x308, 0x30A, 0x30C, 0x327, 0x331, 0x323, 0x345, 0x200D, 0xFE0F)]
    texts = ["".join(r.choice(marks) if r.random() < 0.35 else r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(20_000)]
    check_tokens(texts)


def test_tokens_of_long_words_equal_the_library():
    words = [*complementary(1032), *complementary(4096), "x" * 255, "x" * 257, "É" * 700]
    check_tokens([f"{a} {b}" for a in words for b in words])


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_tokens_of_the_documents_equal_the_library():
    check_tokens([t or "" for t in pq.read_table(SF, columns=["text"])["text"].to_pylist()])
