"""Benchmark decontamination by a prefix-filtered set join (operator 1).

A window of a benchmark item is a set of word shingles, and a text contains the
window only if it has all of them. So one shingle is the necessary prefix: the
window's rarest over the corpus. Texts are probed with the prefix shingles
alone; the place of a shingle in its window gives the only start at which the
window can lie (positional bound), the window's words must fit into the text
there (length bound), and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.word_ids import concat_ranges
from recollect.session import ship, work_dir

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Windows that are broadcast at once, about 150 bytes each; more go in further blocks.
BLOCK_WINDOWS = 1 << 19
#: Candidate pairs that numpy verifies at once.
_CANDIDATES = 1 << 18


@dataclass
class Block:
    """Distinct windows, sorted by prefix shingle: its hash, its place, the window's words and number."""

    prefixes: np.ndarray
    places: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    numbers: np.ndarray
    sizes: tuple[int, ...]


def _words(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and for each text its first word and the one after its last."""
    data, offsets = tx.text_bytes(batch.column(column))
    data = tx.LOWER[data]
    starts, ends, before = tx.word_spans(data, offsets, tx.ALNUM)
    return tx.span_hashes(data, starts, ends), before[:-1], before[1:]


def item_windows(benchmark: DataFrame, item: str, text: str, window_words: int) -> DataFrame:
    """``item_id, words`` (binary, the 64-bit hashes of the words in a row): each window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                hashes, first, last = _words(batch)
                for at, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                    size = min(window_words, b - a)
                    if size:
                        cuts = [hashes[i: i + size].tobytes() for i in range(a, b - size + 1)]
                        ids = pa.array([batch.column("item_id")[at].as_py()] * len(cuts), pa.string())
                        yield pa.RecordBatch.from_arrays([ids, pa.array(cuts, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item_id string, words binary")


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return tx.window_hashes(hashes, size) if size > 1 else hashes


def _rarest(rows: list, docs: DataFrame, shingle_words: int) -> Block:
    """The block of these windows; their shingles' frequencies are counted over all documents."""
    windows = [np.frombuffer(r.words, np.uint64) for r in rows]
    sizes = [min(shingle_words, len(w)) for w in windows]
    shingles = [_shingles(w, s) for w, s in zip(windows, sizes)]
    wanted = {s: np.unique(np.concatenate([x for x, size in zip(shingles, sizes) if size == s])) for s in sorted(set(sizes))}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: np.zeros(len(keys) + 1, np.int64) for s, keys in sent.value.items()}
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                hashes, first, last = _words(batch)
                for s, keys in sent.value.items():
                    found, slot = _probe(hashes, first, last, s, keys)
                    totals[s] += np.bincount(slot, minlength=len(keys) + 1)
        for s, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(used), pa.int32()), pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["size", "slot", "n"])

    counted = docs.select("text").mapInArrow(count, "size int, slot bigint, n bigint").groupBy("size", "slot").agg(F.sum("n").alias("n"))
    frequency = {s: np.zeros(len(keys), np.int64) for s, keys in wanted.items()}
    for r in counted.toLocalIterator():  # at most one row per shingle of the block
        frequency[r["size"]][r["slot"]] = r["n"]
    places = np.array([int(np.argmin(frequency[s][np.searchsorted(wanted[s], x)])) for x, s in zip(shingles, sizes)], np.int64)
    prefixes = np.array([x[p] for x, p in zip(shingles, places)], np.uint64)
    order = np.argsort(prefixes, kind="stable")
    width = max(map(len, windows))
    words = np.zeros((len(windows), width), np.uint64)
    for row, w in zip(words, (windows[i] for i in order)):
        row[: len(w)] = w
    return Block(
        prefixes[order], places[order], np.array([len(windows[i]) for i in order], np.int64), words,
        np.array([rows[i].number for i in order], np.int64), tuple(wanted),
    )


def _probe(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose shingle of ``size`` words, inside one text, is a key; and the key's slot."""
    grams = _shingles(hashes, size)
    slot = np.searchsorted(keys, grams)
    slot[slot == len(keys)] = 0
    inside = np.ones(len(grams), bool)
    for back in range(1, size):
        cut = last - back
        inside[cut[(cut >= first) & (cut < len(grams))]] = False
    found = np.flatnonzero((keys[slot] == grams) & inside) if len(keys) else np.empty(0, np.int64)
    return found, slot[found]


def _occurrences(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start word and index into the block of each window that occurs."""
    starts, windows = [], []
    keys, begin, count = np.unique(block.prefixes, return_index=True, return_counts=True)
    text_of = np.repeat(np.arange(len(first)), last - first)
    for size in block.sizes:
        found, slot = _probe(hashes, first, last, size, keys)
        step = max(1, _CANDIDATES // max(1, int(count.max(initial=1))))
        for at in range(0, len(found), step):
            position, key = found[at: at + step], slot[at: at + step]
            window = concat_ranges(begin[key], count[key])
            start = np.repeat(position, count[key]) - block.places[window]
            text = text_of[np.repeat(position, count[key])]
            fits = (start >= first[text]) & (start + block.lengths[window] <= last[text])
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for word in range(block.words.shape[1]):
                reach = block.lengths[window] > word
                at_word = np.minimum(start + word, len(hashes) - 1)
                same &= ~reach | (hashes[at_word] == block.words[window, word])
            starts.append(start[same])
            windows.append(window[same])
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, windows))


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, tag`` (hash of its text), ``n_words, n_hit, item_ids``.

    A word is a run of ASCII letters and digits and non-ASCII characters, A-Z
    lower-cased. Windows are ``window_words`` consecutive item words, or the
    whole of a shorter item. ``n_hit`` counts words inside any occurrence of a
    window, ``item_ids`` (sorted strings) are the items with occurring windows.

    A NULL or empty text has no words, no hits and no items. Items without words
    give no window. A NULL item id hits but is not listed; items that repeat an
    id are one item. Repeated document rows each keep a row. Only the named
    columns are read, so others cannot clash. Empty tables give no rows or no hits.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))
    kept = work_dir(spark, "item-windows")
    item_windows(benchmark, item, item_text, window_words).write.parquet(kept)
    pairs = spark.read.schema("item_id string, words binary").parquet(kept).select("item_id", F.xxhash64("words").alias("number"), "words")
    windows = pairs.groupBy("number", "words").agg(F.count("*").alias("_n"))
    blocks = -(-windows.count() // BLOCK_WINDOWS)
    parts = []
    for k in range(max(1, blocks)):
        held = windows.where(F.pmod("number", F.lit(max(1, blocks))) == k).select("number", "words").collect()  # about BLOCK_WINDOWS rows
        parts.append(_scan(rows, _rarest(held, rows, shingle_words) if held else None, everything=k == 0))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("doc_id", "tag").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
            F.flatten(F.collect_list("windows")).alias("windows"), F.sum("copies").alias("copies"),
        )
        # Rows that repeat a document met in one group.
        found = found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    found = found.mapInArrow(_count_hits, "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", tag bigint, n_words bigint, n_hit bigint, windows array<bigint>")
    hits = found.where(F.size("windows") > 0).select("doc_id", "tag", F.explode("windows").alias("number")).distinct()
    items = hits.join(pairs.where(F.col("item_id").isNotNull()).select("item_id", "number").distinct(), "number")
    listed = items.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    joined = found.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    return joined.select("doc_id", "tag", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _scan(rows: DataFrame, block: Block | None, everything: bool) -> DataFrame:
    """``doc_id, tag, n_words``, the runs of hit words, the windows found, ``copies`` (1 in the part that has every row)."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                hashes, first, last = _words(batch)
                runs, numbers = {}, {}
                if block is not None and len(hashes):
                    starts, windows = _occurrences(hashes, first, last, block)
                    owner = np.searchsorted(last, starts, "right")
                    a, b = tx.runs(tx.covered(starts, starts + block.lengths[windows], len(hashes)))
                    # Runs of neighbouring texts may touch: cut them at the borders.
                    cuts = np.unique(np.concatenate((first, last)))
                    for s, e in zip(a.tolist(), b.tolist()):
                        edges = [s, *cuts[(cuts > s) & (cuts < e)].tolist(), e]
                        for x, y in zip(edges, edges[1:]):
                            at = int(np.searchsorted(last, x, "right"))
                            runs.setdefault(at, []).append((x - int(first[at]), y - int(first[at])))
                    for at, number in zip(owner.tolist(), block.numbers[windows].tolist()):
                        numbers.setdefault(at, set()).add(number)
                at = list(range(batch.num_rows)) if everything else sorted(runs)
                columns = [
                    batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("tag").take(pa.array(at, pa.int64())), pa.array((last - first)[at], pa.int64()),
                    pa.array([[x for x, _ in runs.get(i, ())] for i in at], pa.list_(pa.int64())), pa.array([[y for _, y in runs.get(i, ())] for i in at], pa.list_(pa.int64())),
                    pa.array([sorted(numbers.get(i, ())) for i in at], pa.list_(pa.int64())), pa.array([int(everything)] * len(at), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n_words", "starts", "ends", "windows", "copies"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, tag bigint, n_words bigint, starts array<bigint>, ends array<bigint>, windows array<bigint>, copies bigint")


def _count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = []
        for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
            reach = total = 0
            for a, b in sorted(zip(starts, ends)):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            hit.append(total)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), batch.column("n_words"), pa.array(hit, pa.int64()), batch.column("windows")],
            ["doc_id", "tag", "n_words", "n_hit", "windows"],
        )
