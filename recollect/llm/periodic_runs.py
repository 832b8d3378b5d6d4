"""Runs of periodic words inside each text, by seeds on diagonals (operator 13).

A run of period q is a stretch in which words q apart are equal: on the diagonal
of lag q its words match without a gap. A run of at least ``periods`` periods has
at least ``(periods - 1) q`` matches there, which guarantees seeds:

1. Lags are taken by classes [2**j, 2**(j + 1)). The k-gram of a class is the
   least number of matches that a run of its lags has. k is no less than any of
   these lags, so within a run the k-grams that are equal and next to each other
   stand exactly one smallest period apart: a text gives one pair for each
   occurrence, never all pairs of equal k-grams.
2. A pair in the class of its lag is a seed. Seeds of one lag in order of place
   are extended only beyond what the last one covered.
3. What the seeds cover is compared word by word and extended to both sides.

A k-gram of the next class can only repeat where both of its halves do, so each
class looks at what the last one left, and texts without repeats end at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.word_ids import concat_ranges
from recollect.session import ship

PERIODS, LEAST_WORDS = 4, 6
_U = np.uint64
_ADDED = ("n_words", "runs", "collapsed")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_length(period, periods: int, words: int):
    """The least length of a run of that period."""
    return np.maximum(words, periods * period)


def seed_length(first: int, periods: int, words: int) -> int:
    """Matches that every run with a lag in [first, 2 * first) has on its diagonal."""
    turn = min(max(-(-words // periods), first), 2 * first - 1)
    return min(int(least_length(q, periods, words)) - q for q in {first, turn, max(turn - 1, first), 2 * first - 1})


def _repeated(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries have an equal key in their text; and neighbours among them, as indices of both."""
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    left, right = order[:-1][same], order[1:][same]
    held = np.zeros(len(key), bool)
    held[left] = held[right] = True
    return held, left, right


def _verified(ids: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, lag: np.ndarray):
    """The stretches of matches within [start, end) on each diagonal, extended to both sides."""
    size = end - start
    place = concat_ranges(start, size)
    edge = np.zeros(len(place), bool)
    edge[(np.cumsum(size) - size)[size > 0]] = True
    match = ids[place] == ids[place + np.repeat(lag, size)]
    # A border between two diagonals ends a stretch.
    begin = np.flatnonzero(match & (edge | ~np.concatenate(([False], match[:-1]))))
    stop = np.flatnonzero(match & np.concatenate((edge[1:] | ~match[1:], [True]))) if len(match) else begin
    of = np.repeat(np.arange(len(size)), size)[begin]
    a, b, q, t = place[begin], place[stop] + 1, lag[of], text[of]
    while len(a):
        more = np.flatnonzero(a > first[t])
        more = more[ids[a[more] - 1] == ids[a[more] - 1 + q[more]]]
        if not len(more):
            break
        a[more] -= 1
    while len(b):
        more = np.flatnonzero(b + q < last[t])
        more = more[ids[b[more]] == ids[b[more] + q[more]]]
        if not len(more):
            break
        b[more] += 1
    return t, a, b - a + q, q


def find_runs(ids: np.ndarray, before: np.ndarray, periods: int = PERIODS, words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Text, start in the text, length and period of every run, by text, start and period.

    ``ids`` numbers the words of all texts in a row, ``before`` the words before each text (n + 1 values).
    """
    first, last = before[:-1], before[1:]
    text_of = np.repeat(np.arange(len(first)), np.diff(before))
    named = tx.mix(ids.astype(_U) + _U(1))
    found, lag, k, half = [], 1, 0, 0
    place, name = np.arange(len(ids)), named
    while True:
        wanted = seed_length(lag, periods, words)
        if k and wanted == 2 * k:
            # Both halves repeat, or the whole doesn't.
            at = np.searchsorted(place, place + k)
            at[at == len(place)] = 0
            both = np.flatnonzero(place[at] == place + k)
            name = tx.mix(name[both] * _U(0xD6E8FEB86659FD93) + name[at[both]])
            place = place[both]
        else:
            windows = tx.window_hashes(named, wanted)
            # What a longer k-gram left out may have a shorter one again.
            place = np.arange(len(windows)) if wanted < k else place[place < len(windows)]
            name = windows[place]
        k = wanted
        text = text_of[place]
        inside = place + k <= last[text]
        place, name, text = place[inside], name[inside], text[inside]
        held, left, right = _repeated(tx.mix(name + text.astype(_U) * _U(0x9E3779B97F4A7C15)), text)
        step = place[right] - place[left]
        seed = (step >= lag) & (step < 2 * lag)
        start, step, text = place[left[seed]], step[seed], text[left[seed]]
        if len(start):
            order = np.lexsort((start, step, text))
            start, step, text = start[order], step[order], text[order]
            # The furthest place that the lag's last seed covered: up to there nothing is extended again.
            fresh = np.ones(len(start), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (step[1:] != step[:-1]) | (start[1:] > start[:-1] + k)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(start)) - 1
            found.append(_verified(ids, first, last, text[head], start[head], start[tail] + k, step[head]))
        place, name = place[held], name[held]
        lag *= 2
        if lag >= len(ids) or not len(place) and seed_length(lag, periods, words) >= k:
            break
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, length, period = (np.concatenate(x) for x in zip(*found))
    keep = length >= least_length(period, periods, words)
    text, start, length, period = text[keep], start[keep] - first[text[keep]], length[keep], period[keep]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def with_runs(docs: DataFrame, text: str = "text", periods: int = PERIODS, words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (``start, length, period``, by start and period) and ``collapsed``.

    A word is a run of other than ASCII white space. A run is a stretch of words
    of smallest period q, at least ``periods * q`` and ``words`` long, which no
    word next to it continues. ``collapsed`` holds the words that no run has
    after its first q words, joined by one space. ``periods`` is at least 3.

    Each text stands alone: nothing is shuffled. A NULL or empty text has no words, no
    runs and an empty ``collapsed``; rows that repeat each get the same result; columns of
    ``docs`` named like an added one are replaced; an empty table gives no rows.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods have no seeds of their own length")
    ship(docs.sparkSession)
    clear = docs.drop(*[c for c in _ADDED if c != text])
    # The text's own column may have an added one's name.
    names = [c for c in clear.columns if c not in _ADDED]
    source = clear.select(*names, F.col(text).alias("_periodic_text")) if text in _ADDED else clear
    column = "_periodic_text" if text in _ADDED else text

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, column):
                data, offsets = tx.text_bytes(batch.column(column))
                starts, ends, before = tx.word_spans(data, offsets, tx.SPACED)
                owner, start, length, period = find_runs(tx.word_ids(data, starts, ends), before, periods, words)
                gone = tx.covered(start + before[owner] + period, start + before[owner] + length, int(before[-1]))
                collapsed = []
                for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                    found = data[offsets[i]: offsets[i + 1]].tobytes().split()
                    x, y = tx.runs(gone[a:b])
                    left = [w for s, e in zip([0, *y.tolist()], [*x.tolist(), len(found)]) for w in found[s:e]] if len(x) else found
                    collapsed.append(b" ".join(left).decode())
                rows = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_RUN))
                cuts = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
                added = [pa.array(np.diff(before)), pa.ListArray.from_arrays(cuts, rows), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, *_ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in names)
    return source.mapInArrow(find, (schema + ", " if schema else "") + "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the number of runs, the longest one (the first, then the shortest period), and digests of all runs and of ``collapsed``."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    chosen = found.withColumn("_best", best)
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return chosen.select(
        doc, F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
