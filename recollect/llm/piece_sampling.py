"""Sampled SentencePiece segmentations and their lossless decoding (operator 6).

All segmentations of a text into pieces form a lattice, in which a path weighs
exp(alpha * sum of its pieces' scores); the scores of a merge vocabulary are
negative ranks, read as the logarithms of Zipf frequencies. Forward filtering sums the weights of all
paths into each node; backward sampling walks from the end, taking an incoming
piece with its share of that sum. So a whole segmentation is drawn exactly, and
with random numbers that hash the row's key it is the same in every run and under
any partitioning. No piece reaches over the border from a character to a space
after it, so the lattice falls into units at those borders; equal units of a
slice of texts are filtered once, and each occurrence is sampled on its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.word_ids import concat_ranges
from recollect.session import ship

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_MARK = 0x2581  # stands for a space in pieces
_LITERAL = 0x110001  # the mark's own character in a text: only bytes spell it
#: A stretch without spaces is cut into units of at most so many characters.
UNIT_CHARS = 512
#: Weight of a piece's score; less is closer to even odds for all segmentations.
ALPHA = 0.5
#: Each length's prefix hashes in a table of so many flags, asked before the sorted keys.
_FLAG_BITS = 18
#: A lattice is about a hundred times its text.
SLICE_BYTES = 1 << 18


class Vocabulary:
    """Pieces by the hash of their code points, with every prefix that leads to one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.bytes = np.full(256, -1, np.int32)
        pieces, scores = [], []
        texts: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts[i] = piece.replace("▁", " ").encode()
                # A piece that crosses from a character to a space can't occur inside a unit.
                if "▁" not in piece.lstrip("▁"):
                    pieces.append((i, np.array([ord(c) for c in piece], _U)))
                    scores.append(model.get_score(i))
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary needs byte pieces to spell every text")
        if all(float(x).is_integer() for x in scores):
            scores = -np.log1p(-np.array(scores))
            scores = (scores - np.log(np.exp(scores).sum())).tolist()
        self.scores = np.zeros(n)
        self.scores[[i for i, _ in pieces]] = scores
        self.fallback = min(scores) - 10
        ids = np.array([i for i, _ in pieces])
        sizes = np.array([len(c) for _, c in pieces])
        flat = np.concatenate([c for _, c in pieces])
        starts = np.cumsum(sizes) - sizes
        sums, down = sequence_sums(flat)
        self.keys, self.ids, self.flags = [], [], []
        for length in range(1, int(sizes.max()) + 1):
            at = np.flatnonzero(sizes >= length)
            key = tx.mix((sums[starts[at] + length] - sums[starts[at]]) * down[starts[at]])
            piece = np.where(sizes[at] == length, ids[at], -1)
            order = np.lexsort((-piece, key))  # of equal prefixes the whole piece first
            keys, first = np.unique(key[order], return_index=True)
            self.keys.append(keys)
            self.ids.append(piece[order][first])
            flags = np.zeros(1 << _FLAG_BITS, bool)
            flags[(keys >> _U(64 - _FLAG_BITS)).astype(np.int64)] = True
            self.flags.append(flags)
        self.text_starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces in a row."""
        return self.text[concat_ranges(self.text_starts[ids], self.text_starts[ids + 1] - self.text_starts[ids])]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def sequence_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = tx._powers(0x5851F42D4C957F2D, len(codes))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(tx.mix(codes + _K) * up[: len(codes)], out=sums[1:])
    return sums, down


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with a mark for each space and before each text, the units' starts, and the units before each text."""
    data, offsets = tx.text_bytes(texts)
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = raw.copy()
    codes[raw == _MARK] = _LITERAL
    codes[raw == 0x20] = _MARK
    begins = chars[:-1][chars[1:] > chars[:-1]]
    codes = np.insert(codes, begins, _MARK)
    full = np.concatenate(([0], np.cumsum(np.diff(chars) + (np.diff(chars) > 0))))
    new = np.zeros(len(codes) + 1, bool)
    mark = codes == _MARK
    new[1:-1] = mark[1:] & ~mark[:-1]
    new[full[:-1]] = True
    starts = np.flatnonzero(new[:-1])
    lengths = np.diff(np.append(starts, len(codes)))
    if (lengths > UNIT_CHARS).any():
        parts = -(-lengths // UNIT_CHARS)
        starts = concat_ranges(np.zeros_like(parts), parts) * UNIT_CHARS + np.repeat(starts, parts)
    return codes, starts, np.searchsorted(starts, full)


class Lattice:
    """The lattice of distinct units; edges in order of the node they lead into."""

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, lengths: np.ndarray, alpha: float):
        ends = np.repeat(np.cumsum(lengths), lengths)
        place = np.arange(len(codes))
        unit = np.repeat(np.arange(len(lengths)), lengths)
        sums, down = sequence_sums(codes.astype(_U))
        at, edges, alone = place, [], np.zeros(len(codes), bool)
        for length, (keys, ids, flags) in enumerate(zip(vocab.keys, vocab.ids, vocab.flags), 1):
            at = at[at + length <= ends[at]]
            if not len(at):
                break
            key = tx.mix((sums[at + length] - sums[at]) * down[at])
            may = flags[(key >> _U(64 - _FLAG_BITS)).astype(np.int64)]
            at, key = at[may], key[may]
            slot = np.searchsorted(keys, key)
            slot[slot == len(keys)] = 0
            hit = keys[slot] == key
            at, piece = at[hit], ids[slot[hit]]
            whole = piece >= 0
            edges.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                alone[at[whole]] = True
        spelled = np.flatnonzero(~alone)
        edges.append((spelled, np.ones(len(spelled), np.int64), -1 - spelled))
        start, length, piece = (np.concatenate(x) for x in zip(*edges))
        # A unit of n characters has n + 1 nodes.
        node = start + unit[start]
        into = node + length
        order = np.argsort(into, kind="stable")
        self.source, self.piece, into = node[order], piece[order], into[order]
        weight = alpha * np.where(self.piece >= 0, vocab.scores[self.piece.clip(0)], vocab.fallback)
        self.first = np.cumsum(lengths) - lengths + np.arange(len(lengths))
        self.last = self.first + lengths
        self.end = np.searchsorted(into, np.arange(int(self.last[-1]) + 2 if len(lengths) else 1))
        depth = into - np.repeat(self.first, lengths + 1)[into] if len(into) else into
        self.reach = np.empty(len(into))
        total = np.zeros(int(self.last[-1]) + 1 if len(lengths) else 0)
        by_depth = np.argsort(depth.astype(np.int16), kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(lengths.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            here = by_depth[a:b]
            value = total[self.source[here]] + weight[here]
            target = into[here]
            group = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            size = np.diff(np.append(group, len(here)))
            top = np.maximum.reduceat(value, group)
            share = np.exp(value - np.repeat(top, size))
            running = np.cumsum(share)
            base = running[group] - share[group]
            whole = running[group + size - 1] - base
            total[target[group]] = top + np.log(whole)
            self.reach[here] = (running - np.repeat(base, size)) / np.repeat(whole, size)
        self.reach[self.end[1:][np.diff(self.end) > 0] - 1] = 1  # the last edge takes what rounding leaves
        self.codes = codes

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each occurrence in a row (negative: a character to spell), and their numbers."""
        node, stop = self.last[unit], self.first[unit]
        live = np.arange(len(unit))
        steps, drawn = np.zeros(len(unit), np.int64), []
        step = 0
        while len(live):
            u = (tx.mix(seed[live] + _U(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(11)).astype(np.float64) * 2.0**-53
            edge = self.end[node[live]]
            over = np.flatnonzero(u >= self.reach[edge])
            while len(over):  # a node has as many edges into it as pieces end there
                edge[over] += 1
                over = over[u[over] >= self.reach[edge[over]]]
            drawn.append((live, edge))
            steps[live] += 1
            node[live] = self.source[edge]
            live = live[node[live] != stop[live]]
            step += 1
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for back, (who, edge) in enumerate(drawn):
            out[ends[who] - 1 - back] = self.piece[edge]
        return out, steps


def sample_ids(vocab: Vocabulary, texts: pa.Array, keys: np.ndarray, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number before each text (n + 1 values)."""
    codes, starts, before = _units(texts)
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(before), np.int64)
    ends = np.append(starts[1:], len(codes))
    sums, down = sequence_sums(codes.astype(_U))
    hashes = tx.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _K)
    _, at, unit = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)[at]
    lattice = Lattice(vocab, codes[concat_ranges(starts[at], lengths)], lengths, alpha)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    number = np.arange(len(starts)) - before[:-1][text]
    random = tx.mix(tx.mix(keys.astype(_U) + _U(seed) * _K)[text] + number.astype(_U) * _U(0xD1342543DE82EF95))
    pieces, steps = lattice.sample(unit, random)
    counts = np.concatenate(([0], np.cumsum(steps)))[before]
    spelled = np.flatnonzero(pieces < 0)
    if len(spelled):
        chars = lattice.codes[-1 - pieces[spelled]]
        kinds, inverse = np.unique(chars, return_inverse=True)
        spell = [vocab.bytes[list(chr(_MARK if c == _LITERAL else c).encode())] for c in kinds.tolist()]
        sizes = np.ones(len(pieces), np.int64)
        sizes[spelled] = np.array([len(s) for s in spell])[inverse]
        places = np.concatenate(([0], np.cumsum(sizes)))
        wide = np.repeat(pieces, sizes)
        flat, begin = np.concatenate(spell), np.concatenate(([0], np.cumsum([len(s) for s in spell])))[:-1]
        wide[concat_ranges(places[spelled], sizes[spelled])] = flat[concat_ranges(begin[inverse], sizes[spelled])]
        return wide, places[counts]
    return pieces, counts


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of one row's ids: the pieces in a row without the mark put before the text."""
    return vocab.decode(ids).tobytes()[1:]


def decodes_to(vocab: Vocabulary, ids: np.ndarray, before: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether the ids of each text decode to it."""
    data, offsets = tx.text_bytes(texts)
    out = vocab.decode(ids)
    ends = np.concatenate(([0], np.cumsum(vocab.text_starts[ids + 1] - vocab.text_starts[ids])))[before]
    filled = np.diff(before) > 0
    same = np.diff(ends) - filled == np.diff(offsets)
    keep = np.ones(len(out), bool)
    keep[ends[:-1][filled]] = False
    if same.all():
        wrong = np.flatnonzero(out[keep] != data)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
        return same
    return np.array([decode_ids(vocab, ids[a:b]) == data[c:d].tobytes() for a, b, c, d in zip(before[:-1], before[1:], offsets[:-1], offsets[1:])], bool)


def with_sampled_pieces(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = 0, name: str = "piece_ids", checked: str | None = None
) -> DataFrame:
    """``docs`` with ``name``: array of piece ids, one sampled segmentation of each whole text.

    ``model`` is the path of a sentencepiece vocabulary with byte pieces, readable
    on every executor. Text is taken as it is; a character without a piece, and
    U+2581 itself, is spelled in bytes, so ``decoded`` gives back every text. With
    ``checked`` the ids are decoded at once, and a column of that name says whether
    that gave back the text.

    A NULL or empty text has no ids. Rows with the same key and text get the same
    segmentation, a NULL key counts as 0. Other columns pass through, one called
    ``name`` is replaced; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (name, checked)]
    names = [f.name for f in kept]
    keyed = docs.select(*[F.col(n) for n in names], F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_row_key"), F.col(text).alias("_row_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for whole in batches:
            for batch in tx.slices(whole, "_row_text", SLICE_BYTES):
                texts = batch.column("_row_text")
                ids, before = sample_ids(vocab, texts, batch.column("_row_key").to_numpy(), alpha, seed)
                added = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))]
                if checked:
                    added.append(pa.array(decodes_to(vocab, ids, before, texts)))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *added], [*names, name, *([checked] if checked else [])])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{name}` array<int>", *([f"`{checked}` boolean"] if checked else [])])
    return keyed.mapInArrow(encode, schema)


def decoded(pieces: DataFrame, model: str, name: str = "piece_ids", target: str = "decoded") -> DataFrame:
    """``pieces`` with ``target``: the text behind the ids; NULL ids give ''."""
    ship(pieces.sparkSession)
    kept = [f for f in pieces.schema.fields if f.name != target]
    names = [f.name for f in kept]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decode_ids(vocab, v.values.to_numpy()).decode() if v.is_valid else "" for v in batch.column(name)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, target])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{target}` string"])
    return pieces.select(*names).mapInArrow(decode, schema)
