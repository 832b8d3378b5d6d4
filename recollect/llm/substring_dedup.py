"""Removal of word windows that earlier documents have, by recompression (operator 10).

Recompression rewrites a sequence in rounds: a maximal run of one symbol becomes
one symbol, then each pair of a left symbol followed by a right one becomes one
symbol, where a coin of the symbol's own name says left or right. A name is a hash
of what it stands for, so all tasks name equal runs and pairs alike in every
round. Inside equal word sequences the rounds form equal symbols, but for those
near the ends that depend on a neighbour outside. A symbol is therefore kept with
the words that it depends on; it is interior to a window that has all of them, and
equal windows have equal interior symbols.

The anchor of a window is an interior symbol of the highest round that has one,
so shared anchors reveal the possible repeats; ``repeats`` counts them over all
documents and then compares whole spans and single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import repeats as rp
from recollect.llm import texts as tx

WINDOW_WORDS = 13
ROUNDS = 2
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)


def _sequence_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = tx._powers(0x5851F42D4C957F2D, len(words))
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums, down


class Symbols:
    """The symbols of all texts of a slice after some rounds.

    ``low`` and ``high``: a symbol depends on the words [low, high). At a text's
    border it depends on the word that another text would have there.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.name, self.text = words, text
        self.low = np.arange(len(words))
        self.high = self.low + 1

    def _next(self, name, keep, low, high) -> None:
        self.name, self.low, self.high, self.text = name, low, high, self.text[keep]

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """``low`` of the symbol before and ``high`` of the symbol after each."""
        new = np.ones(len(self.name) + 1, bool)
        new[1:-1] = self.text[1:] != self.text[:-1]
        before, after = np.empty_like(self.low), np.empty_like(self.high)
        before[1:], after[:-1] = self.low[:-1], self.high[1:]
        first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        before[first], after[last] = self.low[first].clip(None, self._edge_low(first)), self.high[last].clip(self._edge_high(last))
        return before, after

    def _edge_low(self, first):
        return self.begin[self.text[first]] - 1

    def _edge_high(self, last):
        return self.end[self.text[last]] + 1

    def join_runs(self) -> None:
        before, after = self._neighbours()
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(self.name)) - 1
        size = stop - start + 1
        name = self.name[start]
        long = size > 1
        name[long] = tx.mix(name[long] * _K + size[long].astype(_U))
        self._next(name, start, before[start], after[stop])

    def join_pairs(self, round_no: int) -> None:
        before, after = self._neighbours()
        left = (tx.mix(self.name + _U(round_no)) & _U(1)).astype(bool)
        pair = np.zeros(len(self.name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.text[1:] == self.text[:-1])
        taken = np.zeros(len(self.name), bool)
        taken[1:] = pair[:-1]
        keep = np.flatnonzero(~taken)
        paired = pair[keep]
        name = self.name[keep]
        name[paired] = tx.mix(tx.mix(name[paired] + _K) * _K + self.name[keep[paired] + 1])
        # A left symbol stays alone as no right one follows, a right one as no left one precedes.
        low = np.where(left[keep], self.low[keep], before[keep])
        high = np.where(left[keep], after[keep], self.high[keep])
        self._next(name, keep, low, high)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in [lo, hi), the leftmost of equals; every range has a value."""
    tables, width, widest = [np.arange(len(values))], 1, int((hi - lo).max())
    while width * 2 <= widest:
        a, b = tables[-1][:-width], tables[-1][width:]
        tables.append(np.where(values[a] <= values[b], a, b))
        width *= 2
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    out = np.empty(len(lo), np.int64)
    for k, table in enumerate(tables):
        here = np.flatnonzero(level == k)
        a, b = table[lo[here]], table[hi[here] - (1 << k)]
        out[here] = np.where(values[a] <= values[b], a, b)
    return out


def _cut(words: np.ndarray, before: np.ndarray, length: int, rounds: int):
    """Text, start, count, shift, anchor and content of each span, and the hash of every window."""
    windows = tx.window_hashes(words, length)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    place = np.arange(len(windows))
    place = place[place + length <= before[1:][text[: len(windows)]]]
    anchor, shift, source = windows[place].copy(), np.zeros(len(place), np.int64), -1 - place
    if len(place):
        sums, down = _sequence_sums(words)
        symbols = Symbols(words, text)
        symbols.begin, symbols.end = before[:-1], before[1:]
        base = 0
        for round_no in range(rounds):
            symbols.join_runs()
            symbols.join_pairs(round_no)
            lo, hi = np.searchsorted(symbols.low, place), np.searchsorted(symbols.high, place + length, "right")
            has = np.flatnonzero(hi > lo)
            if len(has):
                low, high = symbols.low.clip(0), symbols.high.clip(None, len(words))
                name = tx.mix((sums[high] - sums[low]) * down[low] + (high - low).astype(_U) * _K + _U(round_no) + symbols.name)
                best = _least(name, lo[has], hi[has])
                anchor[has], shift[has], source[has] = name[best], low[best] - place[has], base + best
            base += len(symbols.name)
    new = np.ones(len(place), bool)
    new[1:] = (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    start = place[first]
    if len(first):
        ends = start + count + (length - 1)
        content = tx.mix((sums[ends] - sums[start]) * down[start] + shift[first].astype(_U) * _K + count.astype(_U))
    else:
        content = np.empty(0, _U)
    return text[start], start, count, shift[first], anchor[first], content, windows


def kind(length: int = WINDOW_WORDS, rounds: int = ROUNDS) -> rp.Kind:
    def scan(batch: pa.RecordBatch) -> rp.Spans:
        data, offsets = tx.text_bytes(batch.column("text"))
        starts, ends, before = tx.word_spans(data, offsets, tx.SPACED)
        words = tx.span_hashes(data, starts, ends)
        text, start, count, shift, anchor, content, found = _cut(words, before, length, rounds)

        def windows(a: int, b: int) -> bytes:
            return found[start[a]: start[b - 1] + count[b - 1]].tobytes()

        def hashes(spans: np.ndarray) -> np.ndarray:
            return unpack([windows(i, i + 1) for i in spans.tolist()], count[spans])

        return rp.Spans(text, start - before[text], count, shift, anchor, content, windows, hashes)

    def unpack(payloads: list[bytes], counts: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), _U)

    return rp.Kind(scan, unpack, length, within=False)


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = WINDOW_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``kept`` (the remaining words joined by one space), ``n_words``, ``n_removed``.

    A word is a run of other than ASCII white space. It goes if a window of
    ``length`` words that covers it also starts in a document with a smaller id.
    Windows stay inside one document and are judged on the input.

    A NULL text has no words; a text of fewer than ``length`` words keeps all. A
    NULL id comes before all others. Rows that repeat an id don't remove from each
    other; repeated rows get the same result. Columns of ``docs`` named like an
    added one are replaced; an empty table gives no rows.
    """
    rows = rp.prepared(docs, doc, text)
    removed = rp.removed_windows(rows, kind(length, rounds))
    added = ("kept", "n_words", "n_removed", "starts", "ends")
    clear = docs.drop(*[c for c in added if c not in (doc, text)])
    names = clear.columns
    runs = rp.with_runs(clear, doc, text, removed, length)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clear.schema.fields)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, text):
                kept, size, gone = [], [], []
                for value, starts, ends in zip(batch.column(text).to_pylist(), batch.column("starts"), batch.column("ends")):
                    words = (value or "").encode().split()
                    s, e = starts.as_py(), ends.as_py()
                    left = [w for a, b in zip([0, *e], [*s, len(words)]) for w in words[a:b]]
                    kept.append(b" ".join(left).decode())
                    size.append(len(words))
                    gone.append(len(words) - len(left))
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64())], [*names, *added[:3]])

    return runs.mapInArrow(keep, schema + ", kept string, n_words bigint, n_removed bigint")


def digests(kept: DataFrame, doc: str = "doc_id") -> DataFrame:
    return kept.select(doc, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
