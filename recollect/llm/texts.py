"""Columns of texts as byte arrays: word boundaries and hashes for whole Arrow batches.

Every function here works on one slice of rows at a time, so a task holds a few
arrays of the slice's length and never a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of numpy works on; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64


def _is_word(separators: Iterator[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words between ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = _is_word([0x20, *range(0x09, 0x0E)])
#: Runs of lower-case letters, digits and non-ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _is_word([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: ASCII upper case to lower case, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _allocator():
    """The C library's call that gives freed memory back to the system, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


_TRIM = _allocator()


def give_back() -> None:
    """Return what the arrays of past slices took: Python workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together, or a single longer text."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets; NULL is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (n + 1 values)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each of some disjoint byte spans, equal where the bytes are equal; from 0 by first occurrence."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    held = data[np.cumsum(inside[:-1]) > 0]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])
    return spans.dictionary_encode().indices.to_numpy()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seeded(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xD1342543DE82EF95 % (1 << 64)))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_CACHED_POWERS = 2 << 20


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > _CACHED_POWERS:
            return up, down
        _POWERS[base] = up, down
    return _POWERS[base]


#: Masks that keep the first n bytes of a little-endian word, n from 0 to 8.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)
#: Spans beyond so many bytes are hashed one by one.
_LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a round, each round through ``mix``.

    No sum of byte weights, so no family of texts collides by its structure; equal hashes of
    different spans are as rare as chance has it.
    """
    size = ends - starts
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((2 * seed + 1) * 0xD1342543DE82EF95 % (1 << 64)))
    out = mix(out * _U(0xD6E8FEB86659FD93) + (at[starts] & _FIRST_BYTES[np.minimum(size, 8)]))
    offset, rest = 8, np.flatnonzero(size > 8)
    while len(rest) and offset < _LONG_SPAN:
        more = at[starts[rest] + offset] & _FIRST_BYTES[np.minimum(size[rest] - offset, 8)]
        out[rest] = mix(out[rest] * _U(0xD6E8FEB86659FD93) + more)
        offset += 8
        rest = rest[size[rest] > offset]
    if len(rest):
        view, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        out[rest] = np.frombuffer(b"".join(blake2b(view[s:e], digest_size=8, key=key).digest() for s, e in zip(starts[rest].tolist(), ends[rest].tolist())), "<u8")
    return out


def window_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive symbols, by doubling: log2(n) passes over the array."""
    have, width, out, done = symbols, 1, None, 0
    total = len(symbols) - n + 1
    if total <= 0:
        return np.empty(0, _U)
    while True:
        if n & width:
            part = have[done: done + total]
            out = part.copy() if out is None else mix(out * _U(0xD6E8FEB86659FD93) + part)
            done += width
        width *= 2
        if width > n:
            return out
        half = width // 2
        have = mix(have[: len(have) - half] * _U(0xD6E8FEB86659FD93) + have[half:])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For positions below n: whether some span [start, end) holds it."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(delta)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
