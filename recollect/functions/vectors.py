"""Hashed feature vectors and dot products."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import md5
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from recollect.functions.text import TOKEN

EMBEDDER = "hashing-v1"
DIGITS = 6

_token = re.compile(TOKEN)
# Texts embedded at once: rows, and characters unless one alone has more.
_ROWS, _CHARS = 512, 1 << 19
# MD5 of messages that fit one block: its constants, shifts, and how many are hashed at once.
_SHORT, _BLOCK, _AT_ONCE = 55, 64, 4096
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
# Queries with up to this many non-zero slots score by generated code.
_UNROLL = 96


def embed(text: str, dim: int) -> np.ndarray:
    """Signed feature hashing of unigrams and bigrams with 1 + ln(tf), unit length."""
    words = _token.findall(text.lower())
    counts = Counter(words)
    counts.update(map("_".join, zip(words, words[1:])))
    if not counts:
        return np.zeros(dim)
    digests = b"".join([md5(feature.encode()).digest() for feature in counts])
    # Big-endian words of each digest: the first gives the slot, the second's parity the sign.
    hashes = np.frombuffer(digests, ">u4").reshape(-1, 4)
    signs = 1.0 - 2.0 * (hashes[:, 1] & 1)
    weights = signs * (1.0 + np.log(np.fromiter(counts.values(), float, len(counts))))
    vec = np.bincount(hashes[:, 0] % dim, weights=weights, minlength=dim)
    norm = math.sqrt(float(vec @ vec))
    return vec / norm if norm > 0.0 else vec


def _md5_head(messages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of padded one-block messages, as :func:`_hashed` wants them."""
    x = np.ascontiguousarray(messages.view("<u4").T)
    a, b, c, d = (np.full(x.shape[1], s) for s in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += _SINES[i]
        f += x[at]
        np.left_shift(f, _SHIFTS[i], out=g)
        np.right_shift(f, 32 - _SHIFTS[i], out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap(), (b + _START[1]) >> 24


def _hashed(words: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First digest word, and sign, of every word and then of every pair ``left_right`` (numbers of words)."""
    size = np.array([len(w) for w in words])
    length = np.concatenate([size, size[left] + 1 + size[right]])
    head, parity = np.empty(len(length), np.uint32), np.empty(len(length), np.uint32)
    padded = np.frombuffer(b"".join([w[:_SHORT].ljust(_BLOCK, b"\0") for w in words]), np.uint8).reshape(-1, _BLOCK)
    short = np.flatnonzero(length <= _SHORT)
    # By length of the first part, so that the second starts at one place.
    first = np.where(short < len(words), size[np.minimum(short, len(words) - 1)], 0)
    pair = short >= len(words)
    first[pair] = size[left[short[pair] - len(words)]]
    order = np.argsort(first + pair * _BLOCK, kind="stable")
    short, first, pair = short[order], first[order], pair[order]
    for at in range(0, len(short), _AT_ONCE):
        which, one, two = (a[at: at + _AT_ONCE] for a in (short, first, pair))
        number, begins = which - len(words), which.copy()
        begins[two] = left[number[two]]
        block = padded[begins]
        for n in np.unique(one[two]).tolist():
            rows = np.flatnonzero(two & (one == n))
            block[rows, n] = ord("_")
            block[rows, n + 1:] = padded[right[number[rows]], : _BLOCK - n - 1]
        rows = np.arange(len(which))
        block[rows, length[which]] = 0x80
        block[:, 56], block[:, 57] = length[which] * 8 & 255, length[which] >> 5
        head[which], parity[which] = _md5_head(block)
    for i in np.flatnonzero(length > _SHORT).tolist():
        feature = words[i] if i < len(words) else words[left[i - len(words)]] + b"_" + words[right[i - len(words)]]
        digest = np.frombuffer(md5(feature).digest(), ">u4")
        head[i], parity[i] = digest[0], digest[1]
    return head.astype(np.int64), 1.0 - 2.0 * (parity & 1)


def embed_all(texts: list[str | None], dim: int) -> np.ndarray:
    """:func:`embed` of each text as a row; every feature of the texts is hashed once."""
    index: dict[str, int] = defaultdict(count().__next__)
    ids: list[int] = []
    sizes = []
    for text in texts:
        words = _token.findall((text or "").lower())
        sizes.append(len(words))
        ids.extend(map(index.__getitem__, words))
    if not ids:
        return np.zeros((len(texts), dim))
    word, known = np.array(ids, np.int64), len(index)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[1:] == owner[:-1]
    pairs, pair = np.unique((word[:-1] * known + word[1:])[inside], return_inverse=True)
    head, sign = _hashed([w.encode() for w in index], *np.divmod(pairs, known))
    features = known + len(pairs)
    counted, tf = np.unique(np.concatenate([owner * features + word, owner[1:][inside] * features + known + pair]), return_counts=True)
    text_no, feature = np.divmod(counted, features)
    weights = sign[feature] * (1.0 + np.log(tf))
    vecs = np.bincount(text_no * dim + head[feature] % dim, weights=weights, minlength=len(texts) * dim).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))[:, None]
    return np.divide(vecs, norm, out=vecs, where=norm > 0)


def embedded(texts: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and :func:`embed_all` of short runs of the texts."""
    size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        end = min(start + _ROWS, max(start + 1, int(np.searchsorted(size, before + _CHARS, "right"))))
        yield start, embed_all(texts.slice(start, end - start).to_pylist(), dim)
        start = end


def embedder(dim: int):
    """Arrow function text -> ``array<double>``, NULL for a zero vector.

    Declared nondeterministic only so that a filter on its result does not
    evaluate it a second time.
    """

    @arrow_udf(ArrayType(DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for _, vecs in embedded(texts, dim):
            vecs = np.round(vecs, DIGITS)
            some = vecs.any(axis=1)
            ends = np.concatenate(([0], np.cumsum(some * dim)))
            offsets = pa.array(ends, pa.int32(), mask=np.append(~some, False))
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(vecs[some].ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run.asNondeterministic()


def dot_const(vec: Column, weights: dict[int, float]) -> Column:
    """Dot product with a constant sparse vector."""
    if not weights:
        return F.lit(0.0)
    if len(weights) <= _UNROLL:
        total = F.lit(0.0)
        for slot, weight in sorted(weights.items()):
            total = total + F.get(vec, F.lit(slot)) * F.lit(float(weight))
        return total
    size = max(weights) + 1
    dense = F.lit([float(weights.get(i, 0.0)) for i in range(size)])
    return dot(F.slice(vec, 1, size), dense)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; 0 when their lengths differ or one is empty."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def sparse(vec: np.ndarray) -> dict[int, float]:
    return {int(i): float(vec[i]) for i in np.flatnonzero(vec)}
