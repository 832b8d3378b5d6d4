"""Token ids of whole texts, each distinct word encoded once per worker.

For vocabularies whose normaliser drops white space: no token then spans a white
space or a border between an ASCII letter and ASCII punctuation other than the
apostrophe, so a text's ids are those of its parts in a row.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from recollect.llm import texts as tx

_U = np.uint64
_SPACE, _LETTER, _PUNCT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _PUNCT
#: Whether a word begins at a byte, by the kind of the byte before it times four and its own.
_BEGINS = np.zeros(16, bool)
_BEGINS[[_SPACE * 4 + k for k in (_LETTER, _PUNCT, _OTHER)] + [_LETTER * 4 + _PUNCT, _PUNCT * 4 + _LETTER]] = True
#: Words remembered by one Python worker; beyond it the memory starts anew.
MEMORY_WORDS = 3 << 19


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + length) in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Encodes slices of texts; texts that hold an added token's string go to the library whole.

    A word is known by the hash of its bytes, and confirmed by its length and first eight bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.empty(0, _U), np.empty(0, np.int32)
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.proof = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, _U)

    def _learn(self, words: list[str], keys: np.ndarray, proof: np.ndarray) -> np.ndarray:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total = int(lengths.sum())
        if self.n_ids + total > len(self.ids):
            grown = np.empty(max(self.n_ids + total, len(self.ids) * 3 // 2), np.uint32)
            grown[: self.n_ids] = self.ids[: self.n_ids]
            self.ids = grown
        self.ids[self.n_ids: self.n_ids + total] = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, total)
        slots = np.arange(len(self.starts), len(self.starts) + len(words), dtype=np.int32)
        self.starts = np.concatenate((self.starts, self.n_ids + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.proof = np.concatenate((self.proof, proof))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.n_ids += total
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text the number of ids before it (n + 1 values)."""
        data, offsets = tx.text_bytes(texts)
        lower = tx.LOWER[data].tobytes()
        if any(s in lower for s in self.special):
            return self._whole(texts)
        # Letters stay as they are: the library composes marks before it lower-cases.
        held = data.tobytes()
        kind = np.concatenate((_KIND[data], [np.uint8(_SPACE)]))
        begins = _BEGINS[kind[:-1] | np.concatenate(([np.uint8(_SPACE)], kind[:-2])) << 2] if len(data) else np.empty(0, bool)
        begins = np.append(begins, False)
        begins[offsets[:-1]] = kind[offsets[:-1]] != _SPACE
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        stops = begins[1:] | (kind[1:] == _SPACE)
        stops[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(stops & (kind[:-1] != _SPACE)) + 1
        before = np.searchsorted(starts, offsets)
        keys, at, inverse = np.unique(tx.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        first, size = starts[at], (ends - starts)[at]
        near = np.concatenate((data, np.zeros(8, np.uint8)))[first[:, None] + np.arange(8)]
        near[np.arange(8) >= size[:, None]] = 0
        proof = tx.mix(near.view(_U)[:, 0] + size.astype(_U) * _U(0x9E3779B97F4A7C15))
        if len(self.keys) + len(keys) > MEMORY_WORDS:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        slot = np.empty(len(keys), np.int32)
        slot[known] = self.slots[place[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            words = [held[s:e].decode() for s, e in zip(first[missing].tolist(), (first + size)[missing].tolist())]
            slot[missing] = self._learn(words, keys[missing], proof[missing])
        if (self.proof[slot] != proof).any():
            return self._whole(texts)
        slot = slot[inverse]
        lengths = self.lengths[slot].astype(np.int64)
        counts = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[concat_ranges(self.starts[slot], lengths)], counts[before]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        return np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    return WordEncoder(path)
