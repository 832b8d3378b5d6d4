"""Phrases of words that occur together more than by chance (operator 11).

1. Words are counted exactly; a phrase is frequent only if all its words are.
2. Each task keeps a Misra-Gries summary of the pairs of frequent words, and in a second
   scan of the longer n-grams all of whose pairs have survived: counters for ``capacity`` of them; beyond that the least counts are taken off all. A
   summary is cut into hash partitions, and those of one partition are merged in
   the same way. What has been taken off is carried along. Its sum stays below the
   threshold, as capacities exceed the mass divided by it, and no cut is made that would
   reach it. So every frequent n-gram has a counter left, and its count and
   what was taken off together reach the threshold.
3. Another pass over the texts counts the survivors exactly, by their words.

Names of n-grams are hashes in the second step only, where a collision adds counts
and loses nothing; all results are by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.filters import bloom, held_in, work_table
from recollect.operators.common import top_n
from recollect.session import ship

LONGEST, THRESHOLD, BEST = 5, 100, 2000
#: A language that is not given.
UNKNOWN = "und"
#: N-grams that a task gathers before it sorts them, and counters of one summary before it is handed on.
GATHERED, COUNTERS = 1 << 20, 1 << 20
#: Entries of a tally of strings in one task.
TALLIED = 1 << 19
#: A partition's capacity, whatever its mass.
LEAST_CAPACITY = 1 << 16
_U = np.uint64
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = tx._is_word([0x20, 0x09, *np.flatnonzero(_PIECE_ENDS).tolist()])
_NAME_BITS = 40
_TALLY = "lang string, phrase string, n bigint"


class _Slice:
    """The words of some texts: bytes, spans, hashes with the language's own, and how many words the piece has from each on."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = tx.text_bytes(batch.column("text"))
        self.data = tx.LOWER[raw]
        self.starts, self.ends, before = tx.word_spans(self.data, offsets, _WORD)
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(before))
        self.lang = batch.column("lang")
        n = len(self.starts)
        ended = np.concatenate(([0], np.cumsum(_PIECE_ENDS[self.data])))[self.starts]
        last = np.ones(n, bool)
        last[:-1] = (ended[1:] != ended[:-1]) | (self.text[1:] != self.text[:-1])
        ends = np.flatnonzero(last)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        self.hashes = tx.span_hashes(self.data, self.starts, self.ends)
        own = batch.column("lang_key").to_numpy().view(_U)
        self.own = tx.mix(own)[self.text] if n else np.empty(0, _U)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the n-grams inside one piece, and their names."""
        at = np.flatnonzero(self.left >= n)
        grams = self.hashes if n == 1 else tx.window_hashes(self.hashes, n)
        return at, tx.mix((grams[at] ^ self.own[at]) + _U(n))

    def phrase(self, at: int, n: int) -> str:
        spans = zip(self.starts[at: at + n].tolist(), self.ends[at: at + n].tolist())
        return b" ".join(self.data[s:e].tobytes() for s, e in spans).decode()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            yield _Slice(batch)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    own = F.coalesce(F.col(lang), F.lit(UNKNOWN))
    return docs.select(own.alias("lang"), F.xxhash64(own).alias("lang_key"), F.col(text).alias("text"))


class _Tally:
    """Counts of (language, phrase) in one task, handed on when there are many."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.size = 0

    def add(self, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(pa.table([lang, phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"]))
        self.size += len(n)
        if self.size > 4 * TALLIED:
            self._merge()
            if self.size > TALLIED:
                yield from self.all()

    def _merge(self) -> None:
        merged = pa.concat_tables(self.parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        self.parts = [merged.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])]
        self.size = merged.num_rows

    def all(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            yield from self.parts[0].cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])).to_batches(1 << 16)
        self.parts, self.size = [], 0


def _dealt(tallies: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Tallies as one row per language and hash partition of the phrases."""
    for batch in tallies:
        data, offsets = tx.text_bytes(batch.column("phrase"))
        part = tx.span_hashes(data, offsets[:-1], offsets[1:]) % _U(parts)
        table = pa.Table.from_batches([batch]).append_column("part", pa.array(part.astype(np.int32)))
        rows = table.group_by(["lang", "part"]).aggregate([("phrase", "list"), ("n", "list")])
        yield from rows.select(["lang", "part", "phrase_list", "n_list"]).rename_columns(["lang", "part", "phrases", "ns"]).to_batches()


def _summed(threshold: int):
    """Over rows sorted by language and part: the phrases with ``threshold`` occurrences in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0

        def merged_() -> pa.Table:
            return pa.concat_tables(held).group_by(["phrase"]).aggregate([("n", "sum")]).select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])

        def left(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.filter(pc.greater_equal(table["n"], threshold))
            for batch in table.to_batches():
                langs = pa.array([key[0]] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([langs, batch.column("phrase"), batch.column("n")], ["lang", "phrase", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                found = (batch.column("lang")[i].as_py(), batch.column("part")[i].as_py())
                if found != key and held:
                    yield from left(merged_())
                    held, size = [], 0
                key = found
                held.append(pa.table([batch.column("phrases")[i].values, batch.column("ns")[i].values], ["phrase", "n"]))
                size += held[-1].num_rows
                if size > 2 * TALLIED:
                    held = [merged_()]
                    size = 0
        if held:
            yield from left(merged_())

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for s in _slices(batches):
        if not len(s.starts):
            continue
        ids = tx.word_ids(s.data, s.starts, s.ends)
        langs = s.lang.dictionary_encode()
        codes = langs.indices.to_numpy()[s.text]
        key, at, n = np.unique(ids.astype(np.int64) * len(langs.dictionary) + codes, return_index=True, return_counts=True)
        words = pa.array([s.data[a:b].tobytes().decode() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist())], pa.string())
        yield from tally.add(langs.dictionary.take(pa.array(codes[at])).cast(pa.string()), words, n)
    yield from tally.all()


def word_counts(docs: DataFrame, text: str, lang: str, threshold: int) -> DataFrame:
    """``lang, phrase, n`` of the words with ``threshold`` occurrences; all others of a language as one row, its phrase NULL."""
    tallies = _rows(docs, text, lang).mapInArrow(_count_words, _TALLY)
    counted = tallies.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.groupBy("lang", F.when(F.col("n") >= threshold, F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n"))


def _word_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of words in their language, as ``_Slice.windows(1)`` has them."""
    for batch in batches:
        data, offsets = tx.text_bytes(batch.column("phrase"))
        hashes = tx.span_hashes(data, offsets[:-1], offsets[1:])
        names = tx.mix((hashes ^ tx.mix(batch.column("lang_key").to_numpy().view(_U))) + _U(1))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64))], ["name"])


def cut(keys: np.ndarray, counts: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` counters, the largest ones, each less by the greatest count that goes; no cut if that exceeds ``most``."""
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    if off > most:
        return keys, counts, 0
    stay = counts > off
    return keys[stay], counts[stay] - off, off


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters of several summaries, summed by key and sorted."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _named(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of a name that its partition and the packed bits keep."""
    return (keys >> _U(64 - bits) << _U(_NAME_BITS)) | (keys & _U((1 << _NAME_BITS) - 1))


@dataclass(frozen=True)
class _Survivors:
    """Which n-grams of some lengths may be frequent: a filter of names of so many partition bits."""

    filter: Broadcast
    bits: int

    def holds(self, grams: np.ndarray) -> np.ndarray:
        return held_in(self.filter.value, tx.mix(_named(grams, self.bits)))


def _gathered(s: _Slice, frequent: Broadcast, pairs: _Survivors | None, longest: int) -> Iterator[np.ndarray]:
    """Names of the pairs of frequent words, or of the longer n-grams whose pairs have all survived."""
    if pairs is None:
        rare = ~held_in(frequent.value, s.windows(1)[1])
        at, grams = s.windows(2)
        yield grams[~(rare[at] | rare[at + 1])]
        return
    at, grams = s.windows(2)
    lost = np.ones(len(s.starts) + 1, np.int64)
    lost[at] = ~pairs.holds(grams)
    lost = np.concatenate(([0], np.cumsum(lost)))
    for n in range(3, longest + 1):
        at, grams = s.windows(n)
        yield grams[lost[at + n - 1] == lost[at]]


def _summaries(rows: DataFrame, frequent: Broadcast, pairs: _Survivors | None, longest: int, bits: int, capacity: int, most: int) -> DataFrame:
    """``part, names, counts, off``: the tasks' summaries by partition."""

    def packed(keys, counts, off):
        # Ordered by partition, as that has the leading bits.
        edges = np.searchsorted(keys >> _U(_NAME_BITS), np.arange((1 << bits) + 1, dtype=_U))
        low = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : _NAME_BITS // 8])
        counts = counts.astype("<u4")
        parts = range(1 << bits)
        names = [low[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        numbers = [counts[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array(names, pa.binary()), pa.array(numbers, pa.binary()), pa.array([off] * len(parts), pa.int64())], ["part", "names", "counts", "off"]
        )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, off, gathered, size = np.empty(0, _U), np.empty(0, np.int64), 0, [], 0

        def take_in():
            nonlocal keys, counts, off, gathered, size
            fresh, n = np.unique(np.concatenate(gathered), return_counts=True)
            keys, counts = merged([keys, fresh], [counts, n.astype(np.int64)])
            keys, counts, less = cut(keys, counts, capacity, most - off)
            off, gathered, size = off + less, [], 0

        for s in _slices(batches):
            for grams in _gathered(s, frequent, pairs, longest):
                gathered.append(_named(grams, bits))
                size += len(grams)
            if size > GATHERED:
                take_in()
                if len(keys) > COUNTERS:
                    yield packed(keys, counts, off)
                    keys, counts, off = np.empty(0, _U), np.empty(0, np.int64), 0
        if size:
            take_in()
        if len(keys) or off:
            yield packed(keys, counts, off)

    return rows.mapInArrow(summarise, "part int, names binary, counts binary, off bigint")


def _survivors(summaries: DataFrame, threshold: int, capacity: int) -> DataFrame:
    """``name, most``: every n-gram that may reach the threshold, and some others; no one has more than ``most`` occurrences."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, size, off, own = None, [], [], 0, 0, 0

        def reduce():
            nonlocal keys, counts, size, off, own
            key, count = merged(keys, counts)
            # The tasks together take off less than the other half.
            key, count, less = cut(key, count, capacity, threshold // 2 - own)
            keys, counts, size, off, own = [key], [count], len(key), off + less, own + less

        def left() -> pa.RecordBatch:
            reduce()
            stay = counts[0] + off >= threshold
            names = tx.mix(keys[0][stay] | _U(part << _NAME_BITS))
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts[0][stay] + off)], ["name", "most"])

        limit = 0
        for batch in batches:
            for p, names, numbers, taken in zip(*(batch.column(c).to_pylist() for c in ("part", "names", "counts", "off"))):
                if p != part:
                    if part is not None:
                        yield left()
                    part, keys, counts, size, off, own, limit = p, [], [], 0, 0, 0, 4 * capacity
                wide = np.zeros((len(numbers) // 4, 8), np.uint8)
                wide[:, : _NAME_BITS // 8] = np.frombuffer(names, np.uint8).reshape(-1, _NAME_BITS // 8)
                keys.append(wide.view("<u8")[:, 0])
                counts.append(np.frombuffer(numbers, "<u4").astype(np.int64))
                size, off = size + len(wide), off + taken
                if size > limit:
                    reduce()
                    limit = max(4 * capacity, 2 * size)
        if part is not None:
            yield left()

    return summaries.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "name bigint, most bigint")


def _surviving(rows: DataFrame, frequent: Broadcast, pairs: _Survivors | None, longest: int, mass: int, threshold: int) -> tuple[_Survivors, int]:
    """The survivors of one scan over n-grams of ``mass`` occurrences at most, and how many occurrences they have at most."""
    bits = min(15, max(6, int(mass >> 22).bit_length()))
    # Half of the threshold may go within the tasks, and as much by the merges.
    summaries = _summaries(rows, frequent, pairs, longest, bits, 2 * mass // threshold + 1, (threshold - 1) // 2)
    names = work_table(_survivors(summaries, threshold, max(LEAST_CAPACITY, 4 * mass // (threshold << bits) + 1)), "survivors")
    most = names.agg(F.sum("most")).first()[0] or 0
    return _Survivors(rows.sparkSession.sparkContext.broadcast(bloom(names.select("name"))), bits), most


def _counted(rows: DataFrame, pairs: _Survivors, longer: _Survivors | None, longest: int, parts: int) -> DataFrame:
    """``lang, part, phrases, ns``: occurrences of the survivors, by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(_tallies(batches), parts)

    def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for s in _slices(batches):
            if not len(s.starts):
                continue
            ids = tx.word_ids(s.data, s.starts, s.ends)
            places, phrases, numbers = [], [], []
            for n in range(2, longest + 1):
                at, grams = s.windows(n)
                keep = (pairs if n == 2 else longer).holds(grams)
                at, grams = at[keep], grams[keep]
                _, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
                lead = at[first][inverse]
                same = s.text[lead] == s.text[at]
                same |= s.own[lead] == s.own[at]
                for k in range(n):
                    same &= ids[lead + k] == ids[at + k]
                found = np.bincount(inverse[same], minlength=len(first))
                odd = at[~same]  # another phrase of an equal hash
                for where, many in ((at[first], found), (odd, np.ones(len(odd), np.int64))):
                    places.append(where)
                    phrases += [s.phrase(i, n) for i in where.tolist()]
                    numbers.append(many)
            langs = s.lang.take(pa.array(s.text[np.concatenate(places)])).cast(pa.string())
            yield from tally.add(langs, pa.array(phrases, pa.string()), np.concatenate(numbers))
        yield from tally.all()

    return rows.mapInArrow(count, "lang string, part int, phrases array<string>, ns array<bigint>")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of every phrase of 1 to ``longest`` words with ``threshold`` occurrences, and ``lang, n`` of all words.

    Both are tables in the work folder; see ``collocations`` for words and phrases.
    """
    spark = ship(docs.sparkSession)
    rows = _rows(docs, text, lang)
    words = work_table(word_counts(docs, text, lang, threshold), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    single = words.where("phrase is not null")
    names = single.select("phrase", F.xxhash64("lang").alias("lang_key")).mapInArrow(_word_names, "name bigint")
    frequent = spark.sparkContext.broadcast(bloom(names))
    # No more pairs or longer n-grams than first words.
    mass = single.agg(F.sum("n")).first()[0] or 0
    pairs, mass = _surviving(rows, frequent, None, longest, mass, threshold)
    longer, more = (None, 0) if longest < 3 else _surviving(rows, frequent, pairs, longest, (longest - 2) * mass, threshold)
    parts = max(64, (mass + more) // (threshold * TALLIED))
    counted = _counted(rows, pairs, longer, longest, parts).repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(_summed(threshold), _TALLY)
    phrases = work_table(single.select("lang", "phrase", "n").unionByName(counted), "phrases")
    return phrases, totals


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD, best: int = BEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases by score.

    A-Z is lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs. ``n`` counts the language's words. A phrase of
    2 to ``longest`` words within a piece is a candidate with ``a >= threshold``
    occurrences, overlaps included. Of its cuts into a first part (``l`` occurrences) and a
    rest (``r``) the one with the least ``floor(1000 a n / (l r))`` counts, the first of equals.
    Candidates drop out whose words a longer candidate of as many occurrences holds.

    A NULL language is ``und``; a NULL or empty text has no words; repeated rows count each.
    Only the two named columns are read; an empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, text, lang, longest, threshold)
    counts = phrases.withColumn("w", F.split("phrase", " "))
    candidates = counts.where(F.size("w") > 1).withColumnRenamed("n", "a")
    # A longer candidate of as many occurrences has a neighbour in between, one word longer, of as many again.
    size = F.size("w")
    inner = candidates.where(size > 2).select("lang", "a", F.explode(F.array(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size - 1))).alias("w"))
    held = inner.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", name])
    # A handful of rows, one a language.
    scored = cuts.join(totals, "lang").withColumn("top", _exact(1000 * F.col("a")) * _exact(F.col("n"))).withColumn("bottom", _exact(F.col("l")) * _exact(F.col("r")))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = least.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    ranked = top_n(flat, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], best, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
