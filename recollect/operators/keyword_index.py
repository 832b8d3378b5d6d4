"""Keyword search through an inverted index of three-letter pieces.

Beside the notes, ``postings-N``, dealt by gram and sorted by it, has one row per gram (three code points of the lower-cased
stored text) and block of ``1 << PLACE_BITS`` places: a container of the places
that have the gram, an ordered list or a bitmap, whichever is smaller. A needle's rarest
grams are intersected block by block; what is left is a candidate and is tested with the
needle itself, so the index decides nothing. Needles of fewer than three letters have no gram and
read all notes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import give_back
from recollect.operators import chunks as ck
from recollect.operators.note_index import NoteIndex

#: Places of one block of postings; a bitmap of them has 512 bytes.
PLACE_BITS = 12
_PLACES = 1 << PLACE_BITS
_BITMAP = _PLACES // 8
#: Pairs of gram and place that a task gathers, code points that it looks at at once, rows that leave it at once.
GATHERED, PIECE, ROWS = 1 << 20, 1 << 18, 1 << 15
#: Grams of a needle that are looked up, and candidates that a scan is told by name.
RAREST, NAMED = 8, 2048
POSTINGS = "gram bigint, block bigint, n int, places binary"


def grams_of(text: str) -> np.ndarray:
    """The distinct grams of a text, as numbers: three code points of 21 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    found = []
    for at in range(0, max(0, len(points) - 2), PIECE):
        p = points[at: at + PIECE + 2]
        found.append(np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:]))
    if len(found) < 2:
        return found[0] if found else np.empty(0, np.int64)
    return np.unique(np.concatenate(found))


def container(places: np.ndarray) -> bytes:
    """Ordered distinct places of a block in the fewer bytes."""
    if 2 * len(places) < _BITMAP:
        return places.astype("<u2").tobytes()
    bits = np.zeros(_PLACES, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def members(held: bytes) -> np.ndarray:
    """A block's places as flags."""
    if len(held) == _BITMAP:
        return np.unpackbits(np.frombuffer(held, np.uint8)).astype(bool)
    flags = np.zeros(_PLACES, bool)
    flags[np.frombuffer(held, "<u2")] = True
    return flags


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, places, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram = np.concatenate(grams)
        seq = np.repeat(np.array(places, np.int64), [len(g) for g in grams])
        grams.clear()
        places.clear()
        order = np.lexsort((seq, gram))
        gram, seq = gram[order], seq[order]
        del order
        block = seq >> PLACE_BITS
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]))))
        n = np.diff(np.append(first, len(gram)))
        gram, block, low = gram[first], block[first], (seq & (_PLACES - 1)).astype("<u2")
        del seq
        for at in range(0, len(first), ROWS):
            part = slice(at, at + ROWS)
            held = [container(low[a: a + k]) for a, k in zip(first[part].tolist(), n[part].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(gram[part]), pa.array(block[part]), pa.array(n[part], pa.int32()), pa.array(held, pa.binary())], ["gram", "block", "n", "places"])

    for batch in batches:
        for row in range(batch.num_rows):
            found = grams_of(batch.column("text")[row].as_py())
            grams.append(found)
            places.append(batch.column("seq")[row].as_py())
            size += len(found)
            if size > GATHERED:
                yield from flush()
                size = 0
                give_back()
    if size:
        yield from flush()
        give_back()


def _met(wanted: int):
    """Over blocks with the containers of their grams: the places that all ``wanted`` grams have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, held in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist()):
                by_gram: dict[int, np.ndarray] = {}
                for h in held:
                    flags = members(h["places"])
                    by_gram[h["gram"]] = by_gram[h["gram"]] | flags if h["gram"] in by_gram else flags
                if len(by_gram) == wanted:
                    out.append(np.flatnonzero(np.logical_and.reduce(list(by_gram.values()))) + (block << PLACE_BITS))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], ["seq"])

    return run


class KeywordIndex(NoteIndex):
    """An index of the notes' stored texts, front matter included. Places (``seq``) are not negative."""

    label = "grams-3"

    def beside(self, version: int, rows: DataFrame) -> list[tuple[str, str, int]]:
        texts = rows.select("seq", F.lower(ck.rendered(rows)).alias("text"))
        # By hash, as ranges would take a pass of their own over all texts to sample them.
        found = texts.mapInArrow(_postings, POSTINGS).repartition("gram").sortWithinPartitions("gram", "block")
        return [("postings", f"postings-{version}", self._write("postings", version, found).count())]

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def candidates(self, needle: str) -> DataFrame | None:
        """``seq`` of the places whose text has the needle's rarest grams; None if the needle has no gram."""
        grams = grams_of(needle).tolist()
        if not grams:
            return None
        # A row for each of the needle's own grams.
        found = self.postings().where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
        if len(found) < len(grams):
            return self.spark.createDataFrame([], "seq bigint")
        rarest = [r.gram for r in found[:RAREST]]
        rows = self.postings().where(F.col("gram").isin(rarest))
        # No block has more than a container for each gram, version and flush.
        blocks = rows.groupBy("block").agg(F.collect_list(F.struct("gram", "places")).alias("held"), F.count_distinct("gram").alias("met")).where(F.col("met") == len(rarest))
        return blocks.mapInArrow(_met(len(rarest)), "seq bigint")

    def search(self, query: str, tags: Sequence[str] | None = None, project_id: str | None = None, agent_id: str | None = None) -> DataFrame:
        """The rows of ``chunks.keyword_search``; only candidates are read."""
        needle = query.lower()
        places = self.candidates(needle)
        rows = self.all_rows()
        if places is not None:
            few = places.limit(NAMED + 1).collect()
            if len(few) <= NAMED:
                # Files are sorted by place, so a few names prune their row groups.
                rows = rows.where(F.col("seq").isin([r.seq for r in few]))
            else:
                rows = rows.join(places, "seq", "left_semi")
        return ck.keyword_search(self.standing(rows), query, tags, project_id, agent_id)
