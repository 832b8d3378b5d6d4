"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 5).

Two windows of ``length`` bytes are equal exactly if their suffixes agree to that
depth, so suffixes are ordered no further. The order is made most significant
digit first, each digit one exchange, and a suffix that is alone in its bucket
leaves the sort. A digit is a stretch of the window rather than its first bytes:
the first digit is the window's own least hashed stretch of ``digit`` bytes, which
neighbouring windows share, so one entry stands for a run of suffixes and the
sort moves a fraction of the text. The second digit is the rest of that run as a
whole, the last one the single windows. Buckets equal after it are exactly the
repeated windows: 64 bits of the first digit and 64 of the window identify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import repeats as rp
from recollect.llm import texts as tx
from recollect.llm.word_ids import concat_ranges

LENGTH = 100
DIGIT = 24
_U = np.uint64
#: Places within a slice; a longer text is cut into pieces that overlap by a window.
_PLACE_BITS = 24
_PIECE = (1 << _PLACE_BITS) - (1 << 16)
#: Span boundaries of long stretches are content's own too: a span has at most this many windows.
_BASE, _TABLE = 0x5851F42D4C957F2D, tx._seeded(7)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = tx._powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _window_keys(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, length) -> np.ndarray:
    return tx.mix((sums[starts + length] - sums[starts]) * down[starts])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, ~_U(0), _U)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def _cut(data: np.ndarray, offsets: np.ndarray, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows and place of the first digit of each span of one piece."""
    n = len(data) - length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, np.empty(0, _U), np.empty(0, _U)
    sums, down = _sums(data)
    places = np.arange(len(data) - digit + 1)
    keys = _window_keys(sums, down, places, digit)
    low = _U((1 << _PLACE_BITS) - 1)
    # Ties of the upper bits go to the leftmost place: both depend on the window alone.
    least = (_sliding_min((keys & ~low) | places.astype(_U), length - digit + 1)[:n] & low).astype(np.int64)
    whole = np.zeros(len(data) + 1, np.int32)
    ends = offsets[1:]
    np.add.at(whole, np.maximum(offsets[:-1], ends - length + 1), 1)
    np.add.at(whole, ends, -1)
    inside = np.cumsum(whole)[:n] == 0  # a window may not reach over its text's end
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.ones(n, bool)
    stop[:-1] = (least[1:] != least[:-1]) | ~inside[1:]
    count = np.flatnonzero(stop & inside) + 1 - start
    at = least[start]
    # The span's content with the digit's place in it; two hashes in one.
    content = tx.mix(_window_keys(sums, down, start, count + (length - 1)) + (at - start).astype(_U) * _U(0x9E3779B97F4A7C15) + count.astype(_U))
    return start, count, at - start, keys[at], content


def kind(length: int = LENGTH, digit: int = DIGIT) -> rp.Kind:
    def scan(batch: pa.RecordBatch) -> rp.Spans:
        data, offsets = tx.text_bytes(batch.column("text"))
        pieces = []
        if len(data) <= _PIECE:
            pieces.append((0, *_cut(data, offsets, length, digit)))
        else:  # a single long text
            for at in range(0, len(data) - length + 1, _PIECE - length + 1):
                part = data[at: at + _PIECE]
                pieces.append((at, *_cut(part, np.array([0, len(part)]), length, digit)))
        start = np.concatenate([p[1] + p[0] for p in pieces]) if pieces else np.empty(0, np.int64)
        count, shift, anchor, content = (np.concatenate([p[i] for p in pieces]) for i in (2, 3, 4, 5))
        text = np.searchsorted(offsets, start, "right") - 1

        def windows(a: int, b: int) -> bytes:
            return data[start[a]: start[b - 1] + count[b - 1] + length - 1].tobytes()

        def hashes(spans: np.ndarray) -> np.ndarray:
            return unpack([windows(i, i + 1) for i in spans.tolist()], count[spans])

        return rp.Spans(text, start - offsets[text], count, shift, anchor, content, windows, hashes)

    def unpack(payloads: list[bytes], counts: np.ndarray) -> np.ndarray:
        if not payloads:
            return np.empty(0, _U)
        sums, down = _sums(np.frombuffer(b"".join(payloads), np.uint8))
        sizes = counts + (length - 1)
        return _window_keys(sums, down, concat_ranges(np.cumsum(sizes) - sizes, counts), length)

    return rp.Kind(scan, unpack, length, within=True)


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """``docs`` with ``kept`` (binary, the remaining UTF-8 bytes), ``n_bytes``, ``n_removed``, ``n_spans``.

    A byte goes if some string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same document.
    Strings never cross documents and are judged on the input.

    A NULL text is empty; a text shorter than ``length`` keeps all its bytes. A
    NULL id comes before all others. Rows that repeat an id are compared with each
    other by place only: the same place in both is no earlier start. Repeated
    rows all get the same result. Columns of ``docs`` named like an added one are
    replaced; an empty table gives no rows.
    """
    rows = rp.prepared(docs, doc, text)
    removed = rp.removed_windows(rows, kind(length, digit))
    added = ("kept", "n_bytes", "n_removed", "n_spans", "starts", "ends")
    clear = docs.drop(*[c for c in added if c not in (doc, text)])
    names = clear.columns
    runs = rp.with_runs(clear, doc, text, removed, length)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clear.schema.fields)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, spans = [], [], [], []
            for value, starts, ends in zip(batch.column(text), batch.column("starts"), batch.column("ends")):
                held = value.as_py().encode() if value.is_valid else b""
                s, e = starts.as_py(), ends.as_py()
                kept.append(b"".join(held[a:b] for a, b in zip([0, *e], [*s, len(held)])))
                size.append(len(held))
                gone.append(len(held) - len(kept[-1]))
                spans.append(len(s))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())],
                [*names, *added[:4]],
            )

    return runs.mapInArrow(keep, schema + ", kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def digests(kept: DataFrame, doc: str = "doc_id") -> DataFrame:
    return kept.select(doc, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
