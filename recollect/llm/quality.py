"""Quality classifier from weak labels (operator 8).

Overlapping heuristics vote on every text: unfit, fit, or no opinion. Expectation
maximisation over the votes of all documents estimates how often each heuristic is
right when it votes, without any true label; the table of vote patterns is all it
needs. A heuristic for a fault has no opinion on texts without that fault, as
another fault may be there; one for sound texts votes fit. The posteriors then label a bounded sample, on which a linear
scorer over hashed features is trained. The scorer judges every document.

Two faults are modelled apart, each with its own heuristics and scorer: ``junk``
(markup debris, shouting, tables of words, repetition) and ``abuse`` (insults).
The heuristics for abuse know English words only. Where some documents carry labels,
a second scorer of abuse, ``taught``, is fitted on a bounded sample of them, in
whatever language they are; a text's abuse is the larger score of the two. Where a
text has words of the heuristics that the scorer found too seldom to weigh, the
label model's posterior counts too, so abuse is found however rare it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.html_main_text import STOP_WORDS
from recollect.llm.word_ids import concat_ranges
from recollect.session import ship

_U = np.uint64
ASPECTS = ("junk", "abuse")
#: Documents, about, on which the scorers are trained; they are those with the smallest hashed ids.
SAMPLE = 8192
FEATURE_BITS = 18
#: Bytes of text that are described at once; the arrays over them take many times as much.
SLICE = 1 << 18
#: A word must be in so many sampled texts, and this share of them, to have a weight ...
LEAST_TEXTS, LEAST_SHARE = 4, 0.004
#: ... and so many standard deviations more or less often in unfit texts than by chance.
LEAST_SIGNAL = 4.0
#: The scorer keeps so many features, those with the strongest signal.
MOST_FEATURES = 512
RIDGE = 0.05
#: Labelled documents, about, on which ``taught`` is fitted; those with the smallest hashed ids.
TAUGHT = 8192
#: Its features are the shares of words that begin alike, in so many characters; a shorter word counts as a whole.
STEM_CHARS, STEM_SCALE = 5, 20.0
ROUNDS_EM, ROUNDS_FIT = 60, 25
THRESHOLD = 0.5

# Words of personal abuse. The two lists overlap.
INSULTS = tuple("idiot idiots moron morons stupid dumb loser losers scum clown clowns imbecile bastard jerk trash".split())
CONTEMPT = tuple("worthless pathetic disgusting trash scum stupid garbage filth vermin loser losers moron hate hateful".split())

_UPPER, _LETTER, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_SYMBOL[list(b"#$%&*!|@^~<>=+_\\/{}[]`")] = True


def _hashed(words) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(tx.span_hashes(data, np.append(0, ends[:-1]), ends))


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


_STOPS, _INSULTS, _CONTEMPT = _hashed(sorted(STOP_WORDS)), _hashed(sorted(INSULTS)), _hashed(sorted(CONTEMPT))
_ABUSIVE = np.union1d(_INSULTS, _CONTEMPT)


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    sums = np.zeros(len(flags) + 1, np.int64 if len(flags) >> 31 else np.int32)
    np.cumsum(flags, out=sums[1:])
    return sums


@dataclass
class Words:
    """What the heuristics and the features of a slice read."""

    count: np.ndarray  # words of each text
    hashes: np.ndarray  # lower-cased words
    text: np.ndarray  # text of each word
    stems: np.ndarray  # hashes of their first characters
    shares: dict[str, np.ndarray]
    shapes: np.ndarray  # shape of each space-separated chunk
    chunk_text: np.ndarray


def _read(batch: pa.RecordBatch, column: str) -> Words:
    data, offsets = tx.text_bytes(batch.column(column))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = _running(flags)
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n = len(offsets) - 1
    lower = tx.LOWER[data]
    starts, ends, before = tx.word_spans(lower, offsets, tx.ALNUM)
    hashes = tx.span_hashes(lower, starts, ends)
    firsts = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(STEM_CHARS, len(data)))
    stems = tx.span_hashes(lower, starts, np.minimum(ends, firsts[np.searchsorted(firsts, starts) + STEM_CHARS]))
    count = np.diff(before)
    text = np.repeat(np.arange(n), count)
    per_text = lambda flags, where, size: np.bincount(where, weights=flags, minlength=n) / np.maximum(1, size)
    repeated = np.zeros(len(hashes))
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    c_starts, c_ends, c_before = tx.word_spans(data, offsets, tx.SPACED)
    chunks = np.diff(c_before)
    chunk_text = np.repeat(np.arange(n), chunks)
    size = c_ends - c_starts
    s, u, le = (sums[c_ends] - sums[c_starts] for sums in (_running(kind[data]) for kind in (_SYMBOL, _UPPER, _LETTER)))
    # Shape: how many symbols (0-3), all letters capital, no letter at all, repeats the chunk before.
    shout = (u > 1) & (u == le)
    whole = tx.span_hashes(data, c_starts, c_ends)
    again = np.zeros(len(whole), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (chunk_text[1:] == chunk_text[:-1])
    shapes = np.minimum(s, 3) * 8 + shout * 4 + (le == 0) * 2 + again
    shares = {
        "symbols": total(_SYMBOL[data]) / np.maximum(1, total(tx.SPACED[data])), "capitals": (total(_UPPER[data]) - np.bincount(chunk_text, weights=_UPPER[data[c_starts]], minlength=n)) / np.maximum(1, total(_LETTER[data])),
        # A few words say nothing about stop words.
        "stops": np.where(count < 8, 0.2, per_text(_among(_STOPS, hashes), text, count)), "repeats": per_text(repeated, text, count),
        "bare": per_text(s == size, chunk_text, chunks), "decorated": per_text(s > 1, chunk_text, chunks), "shouted": per_text(shout, chunk_text, chunks),
        "insults": per_text(_among(_INSULTS, hashes), text, 1), "contempt": per_text(_among(_CONTEMPT, hashes), text, 1),
    }
    shares["abusive"] = per_text(_among(_INSULTS, hashes) | _among(_CONTEMPT, hashes), text, count)
    return Words(count, hashes, text, stems, shares, shapes, chunk_text)


def _opinion(unfit: np.ndarray, fit: np.ndarray | None = None) -> np.ndarray:
    """1 where ``unfit``, 0 where ``fit``, -1 (none) elsewhere."""
    return np.where(unfit, 1, -1 if fit is None else np.where(fit, 0, -1))


def _votes(w: Words) -> dict[str, np.ndarray]:
    """A matrix of votes per aspect, a column per heuristic."""
    s, some = w.shares, w.count >= 8
    prose = (s["symbols"] < 0.02) & (s["capitals"] < 0.2) & (s["repeats"] < 0.05)
    junk = [
        _opinion(s["symbols"] >= 0.08), _opinion(s["decorated"] >= 0.25), _opinion(s["bare"] >= 0.2), _opinion(s["capitals"] >= 0.4),
        _opinion(s["shouted"] >= 0.5), _opinion(some & (s["repeats"] >= 0.3)), _opinion(some & (s["stops"] < 0.03), some & (s["stops"] >= 0.12) & (s["repeats"] < 0.05)),
        _opinion(np.zeros(len(some), bool), prose),
    ]
    abusive = s["abusive"] > 0
    abuse = [_opinion(s["insults"] > 0, ~abusive), _opinion(s["contempt"] > 0, ~abusive), _opinion(s["abusive"] >= 0.002, ~abusive)]
    return {"junk": np.stack(junk, 1), "abuse": np.stack(abuse, 1)}


def _pattern(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


@dataclass
class LabelModel:
    """How often each heuristic is right when it votes, and the share of unfit texts that follows.

    Both classes are as likely beforehand: heuristics that seldom contradict each
    other leave room for a share of nearly nothing, with all of one side wrong.
    """

    accuracy: np.ndarray
    share: float = 0.5

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of being unfit; a text without any vote is undecided."""
        weight = np.log(self.accuracy / (1 - self.accuracy))
        odds = ((votes == 1) * weight - (votes == 0) * weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_labels(votes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and how many texts have each."""
    model = LabelModel(np.full(votes.shape[1], 0.8))
    for _ in range(ROUNDS_EM if len(votes) else 0):
        unfit = model.posterior(votes)
        agree = np.where(votes == 1, unfit[:, None], 1 - unfit[:, None]) * (votes >= 0)
        right, voted = (agree * counts[:, None]).sum(0), ((votes >= 0) * counts[:, None]).sum(0)
        # The prior of 8 right in 10 keeps rare heuristics from certainty.
        # Heuristics are taken to be better than chance.
        model = LabelModel(np.clip((right + 8) / (voted + 10), 0.55, 0.999), float((unfit * counts).sum() / counts.sum()))
    return model


def _features(w: Words) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, slot and value of each feature, per aspect: shares of shapes, presence of words, and shares of stems (a row per word)."""
    n, top = len(w.count), 1 << FEATURE_BITS
    shape = np.bincount(w.chunk_text * 32 + w.shapes, minlength=n * 32).reshape(n, 32).astype(np.float64)
    shape /= np.maximum(1, shape.sum(1, keepdims=True))
    extra = np.stack([w.shares[k] for k in ("symbols", "capitals", "stops", "repeats")], 1)
    dense = np.concatenate((shape, extra, np.ones((n, 1))), 1)
    text, slot = np.nonzero(dense)
    key = np.unique(w.text.astype(np.int64) << FEATURE_BITS | (w.hashes >> _U(64 - FEATURE_BITS)).astype(np.int64))
    words = (key >> FEATURE_BITS, key & (top - 1))
    bias = (np.arange(n), np.full(n, top))
    return {
        "junk": (text, slot, dense[text, slot] * 4),
        "abuse": (np.concatenate((words[0], bias[0])), np.concatenate((words[1], bias[1])), np.ones(len(key) + n)),
        "taught": (
            np.concatenate((w.text, bias[0])), np.concatenate(((w.stems >> _U(64 - FEATURE_BITS)).astype(np.int64), bias[1])),
            np.concatenate((STEM_SCALE / np.maximum(1, w.count)[w.text], np.ones(n))),
        ),
    }


def _summed(text: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each slot of a text once, with the sum of its values, by text."""
    key, at = np.unique(text << (FEATURE_BITS + 1) | slot, return_inverse=True)
    return key >> (FEATURE_BITS + 1), key & ((1 << FEATURE_BITS + 1) - 1), np.bincount(at, weights=value, minlength=len(key))


def fit_scorer(text: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, words: bool, least_share: float = LEAST_SHARE) -> np.ndarray:
    """Weights of a logistic scorer by Newton steps on soft labels, both classes weighing alike, with a ridge.

    ``words``: the features stand for words, of which only those with a signal are used.
    """
    top = (1 << FEATURE_BITS) + 1
    weights = np.zeros(top)
    if not len(target):
        return weights
    seen, share = np.bincount(slot, minlength=top), float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    signal = np.where(seen > 0, np.inf, 0.0)
    if words:
        excess = np.bincount(slot, weights=value * target[text], minlength=top) - np.bincount(slot, weights=value, minlength=top) * share
        signal = np.abs(excess) / np.sqrt(np.bincount(slot, weights=value * value, minlength=top) * share * (1 - share) + 1e-9)
        signal[seen < max(LEAST_TEXTS, least_share * len(target))] = 0
        signal[-1] = np.inf
    used = np.flatnonzero(signal >= LEAST_SIGNAL)
    if words and len(used) < 2:  # the bias alone tells no text from another
        return weights
    used = used[np.argsort(-signal[used], kind="stable")][:MOST_FEATURES]
    column = np.full(top, -1)
    column[used] = np.arange(len(used))
    keep = column[slot] >= 0
    x = np.zeros((len(target), len(used)))
    np.add.at(x, (text[keep], column[slot[keep]]), value[keep])
    cost = target / (2 * share) + (1 - target) / (2 * (1 - share))
    w = np.zeros(len(used))
    for _ in range(ROUNDS_FIT):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (p - target)) + RIDGE * w
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(used)), gradient)
        w -= step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    weights[used] = w
    return weights


@dataclass
class Scorer:
    labels: dict[str, LabelModel]
    weights: dict[str, np.ndarray]


def _described(name: str, features: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray) -> pa.RecordBatch:
    t, s, v = features
    order = np.argsort(t, kind="stable")
    ends = pa.array(np.searchsorted(t[order], np.arange(len(target) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (s[order].astype(np.int32), v[order].astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(target), pa.string()), pa.array(target), *lists], ["aspect", "target", "slots", "values"])


_DESCRIBED = "aspect string, target double, slots array<int>, values array<float>"


def _fitted(taken: pa.Table, name: str, words: bool, least_share: float = LEAST_SHARE) -> np.ndarray:
    own = taken.filter(pa.compute.equal(taken["aspect"], name))
    lists = own["slots"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    return fit_scorer(
        np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), own["values"].combine_chunks().flatten().to_numpy().astype(np.float64),
        own["target"].to_numpy(), words, least_share,
    )


def _taught(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> np.ndarray:
    """Weights of the scorer fitted on about ``sample`` documents whose ``label`` is known."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    share = min(1.0, sample / max(1, known.count()))
    mixed = F.pmod(F.xxhash64(F.col("_key"), F.lit("taught")), F.lit(1 << 30))
    some = known.where(mixed < int(share * (1 << 30))).limit(2 * sample).groupBy("_key").agg(F.max("_label").alias("_label"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text", SLICE):
                target = (batch.column("_label").to_numpy(zero_copy_only=False) > 0).astype(np.float64)
                yield _described("taught", _summed(*_features(_read(batch, "text"))["taught"]), target)

    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(some), "_key").select("text", "_label").limit(2 * sample)
    taken = chosen.mapInArrow(describe, _DESCRIBED).toArrow()
    target = taken["target"].to_numpy()
    if not (target > 0).any() or (target > 0).all():
        return np.zeros((1 << FEATURE_BITS) + 1)
    return _fitted(taken, "taught", True, 0.0)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, labels: DataFrame | None = None, label: str = "toxic", taught: int = TAUGHT) -> Scorer:
    """The label models over all of ``docs`` and the scorers over about ``sample`` of them.

    ``labels`` says of some documents, by ``key``, whether they are abusive (``label``
    above 0); one more scorer is fitted on about ``taught`` of those.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text", SLICE):
                for aspect, votes in enumerate(_votes(_read(batch, "text")).values()):
                    pattern, n = np.unique(_pattern(votes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([aspect] * len(n), pa.int32()), pa.array(pattern, pa.int32()), pa.array(n, pa.int64())], ["aspect", "pattern", "n"])

    # At most 3**8 + 3**3 rows.
    counted = rows.mapInArrow(count, "aspect int, pattern int, n bigint").groupBy("aspect", "pattern").agg(F.sum("n").alias("n")).collect()
    models, total = {}, 0
    for aspect, (name, width) in enumerate(zip(ASPECTS, (8, 3))):
        own = sorted((r.pattern, r.n) for r in counted if r.aspect == aspect)
        patterns = np.array([p for p, _ in own], np.int64)
        votes = patterns[:, None] // 3 ** np.arange(width) % 3 - 1
        counts = np.array([n for _, n in own], np.float64)
        models[name], total = fit_labels(votes, counts), int(counts.sum())
    sent = spark.sparkContext.broadcast(models)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text", SLICE):
                w = _read(batch, "text")
                votes, found = _votes(w), _features(w)
                for name in ASPECTS:
                    yield _described(name, found[name], sent.value[name].posterior(votes[name]))

    share = min(1.0, sample / max(1, total))
    mixed = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    chosen = docs.where(mixed < int(share * (1 << 30))).select(F.col(text).alias("text")).limit(2 * sample)
    taken = chosen.mapInArrow(describe, _DESCRIBED).toArrow()
    weights = {name: _fitted(taken, name, name == "abuse") for name in ASPECTS}
    weights["taught"] = np.zeros((1 << FEATURE_BITS) + 1) if labels is None else _taught(docs, labels, key, text, label, taught)
    return Scorer(models, weights)


def with_quality(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``junk_score``, ``abuse_score`` (0 to 1) and ``keep``.

    A text is kept if it has words and both scores are below ``threshold``. NULL,
    empty and wordless texts score 1 as junk and go. Repeated rows score alike.
    Other columns pass through, those called like an added one are replaced; an
    empty table gives no rows (and ``train`` on it gives a scorer that keeps all texts).
    """
    spark = ship(docs.sparkSession)
    added = ("junk_score", "abuse_score", "keep")
    kept = [f for f in docs.schema.fields if f.name not in added or f.name == text]
    names = [f.name for f in kept]
    sent = spark.sparkContext.broadcast((scorer.weights, scorer.labels["abuse"]))

    def unweighed(w: Words, weights: np.ndarray, model: LabelModel) -> np.ndarray:
        """The posterior of the texts with words of abuse that have no weight, 0 of others."""
        words = _ABUSIVE[weights[(_ABUSIVE >> _U(64 - FEATURE_BITS)).astype(np.int64)] == 0]
        posterior = np.zeros(len(w.count))
        some = np.flatnonzero(w.shares["abusive"] > 0)
        if len(words) and len(some):
            of = w.shares["abusive"][w.text] > 0
            some = np.unique(w.text[of][_among(words, w.hashes[of])])
            posterior[some] = np.round(model.posterior(_votes(w)["abuse"][some]), 6)
        return posterior

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = sent.value
        for whole in batches:
            for batch in tx.slices(whole, "_judged", SLICE):
                w = _read(batch, "_judged")
                scores = [np.zeros(batch.num_rows), unweighed(w, weights["abuse"], model)]
                for name, (t, s, v) in _features(w).items():
                    # A scorer that learnt nothing says nothing.
                    if weights[name].any():
                        z = np.bincount(t, weights=weights[name][s] * v, minlength=batch.num_rows)
                        own = scores[name != "junk"]
                        np.maximum(own, np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6), out=own)
                scores[0][w.count == 0] = 1.0
                fit = (scores[0] < threshold) & (scores[1] < threshold)
                # Without any training text all weights are 0 and say nothing.
                if not any(x.any() for x in weights.values()):
                    fit = w.count > 0
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *map(pa.array, scores), pa.array(fit)], [*names, *added])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "junk_score double, abuse_score double, keep boolean"])
    return docs.select(*[F.col(n) for n in names], F.col(text).alias("_judged")).mapInArrow(score, schema)
