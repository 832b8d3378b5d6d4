"""Exact n-gram Jaccard join by vertical partitioning (operator 2).

The global order of the n-grams is by rarity: those of one text, then the shared
ones, then the frequent ones, each by hash. Hash ranges cut it into fragments.

1. Texts with equal sets form one class; a class is one node from here on.
2. The fragments are counted apart, which tells shared and frequent n-grams.
3. Two linked sets share an n-gram within the rarest ``n - ceil(t n) + 1`` of each
   (prefix), and neither has more in common than its shared n-grams (bound). So
   only prefixes are dealt out, and a set with too many n-grams of its own never is.
4. Candidates are counted fragment by fragment: the partial overlaps of a pair are
   counted apart and summed per pair, and the sum decides.
5. First every set meets two hubs of its buckets, sets of its size with few rare n-grams. What that
   connects need not be compared again: then only pairs across components are
   candidates, all of them. Components need no more links than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.components import components
from recollect.llm.filters import bloom, held_in, work_table
from recollect.operators.common import top_n
from recollect.session import ship

SHINGLE_WORDS = 5
PERCENT = 75
#: N-grams of one fragment in the counting round, about; one task holds one fragment.
FRAGMENT_NGRAMS = 1 << 21
#: Copies of an n-gram over all slices of texts (two each at most) from which it counts as frequent.
FREQUENT = 16
#: Fragments in which the overlap of a pair is counted.
PARTS = 4
_U = np.uint64
_LOW = _U((1 << 48) - 1)
_NUMBERS = ("n", "own", "rare", "place", "held")


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each text in a row, the n + 1 offsets, and each set's 64-bit digest."""
    data, offsets = tx.text_bytes(batch.column("text"))
    data = tx.LOWER[data]
    starts, ends, before = tx.word_spans(data, offsets, tx.SPACED)
    hashes = tx.span_hashes(data, starts, ends)
    grams = tx.window_hashes(hashes, words)
    sets = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(grams[a: b - words + 1]))
        elif b > a:
            sets.append(tx.window_hashes(hashes[a:b], b - a)[:1] + _U(b - a))
        else:
            sets.append(np.empty(0, _U))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, _U)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(tx.mix(flat + _U(0x9E3779B97F4A7C15)))))
    return flat, bounds, tx.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(_U))


def _row_key(doc: np.ndarray, node: np.ndarray) -> np.ndarray:
    return tx.mix(doc.view(_U) * _U(0x9E3779B97F4A7C15) + node)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()


def _classes(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, tag, node`` (digest of the set), ``n`` for every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                _, bounds, node = _sets(batch, words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), _signed(node), pa.array(np.diff(bounds))], ["doc_id", "tag", "node", "n"])

    return rows.mapInArrow(digest, "doc_id bigint, tag int, node bigint, n bigint")


def _first_rows(batches: Iterator[pa.RecordBatch], words: int, firsts: np.ndarray):
    """The sets of the rows that may stand for their class, each class once a batch: grams, offsets, nodes."""
    for whole in batches:
        seen: set[int] = set()
        for batch in tx.slices(whole, "text"):
            flat, bounds, node = _sets(batch, words)
            keep = np.flatnonzero(held_in(firsts, _row_key(_doc_ids(batch), node)) & (np.diff(bounds) > 0))
            keep = [i for i in keep.tolist() if not (int(node[i]) in seen or seen.add(int(node[i])))]
            if keep:
                sets = [flat[bounds[i]: bounds[i + 1]] for i in keep]
                yield np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), node[keep]


def _fragment_key(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    fragment = grams >> _U(64 - bits)
    return fragment, (fragment << _U(48)) | (grams & _LOW)


def _counted(rows: DataFrame, words: int, firsts, bits: int) -> DataFrame:
    """``gram, frequent``: the n-grams of more than one class, counted fragment by fragment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, _, _ in _first_rows(batches, words, firsts.value):
            fragment, key = _fragment_key(flat, bits)
            key, count = np.unique(key, return_counts=True)
            key = np.repeat(key, np.minimum(count, 2))
            fragment = (key >> _U(48)).astype(np.int64)
            ids, begin = np.unique(fragment, return_index=True)
            low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6])
            packed = [low[i:j].tobytes() for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(key)])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["fragment", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(fragment: int, held: list[bytes]) -> pa.RecordBatch:
            low = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(low), 8), np.uint8)
            wide[:, :6] = low
            key, n = np.unique(wide.view("<u8")[:, 0], return_counts=True)
            more = n > 1
            return pa.RecordBatch.from_arrays([_signed(tx.mix(key[more] | _U(fragment << 48))), pa.array(n[more] >= FREQUENT)], ["gram", "frequent"])

        fragment, held = None, []
        for batch in batches:
            for f, packed in zip(batch.column("fragment").to_pylist(), batch.column("grams").to_pylist()):
                if f != fragment and held:
                    yield tell(fragment, held)
                    held = []
                fragment = f
                held.append(packed)
        if held:
            yield tell(fragment, held)

    dealt = rows.mapInArrow(cut, "fragment int, grams binary").repartition("fragment").sortWithinPartitions("fragment")
    return dealt.mapInArrow(count, "gram bigint, frequent boolean")


def _postings(rows: DataFrame, words: int, percent: int, firsts, shared, frequent, bits: int) -> DataFrame:
    """``gram, node, n, own, rare, place, held``: the shared n-grams in each class's prefix, numbered in the global order.

    ``own`` counts the set's n-grams of no other class, ``rare`` all that aren't
    frequent, ``held`` the shared ones in the prefix.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, bounds, node in _first_rows(batches, words, firsts.value):
            key = tx.mix(_fragment_key(flat, bits)[1])
            rank = held_in(shared.value, key).astype(np.int64)
            some = np.flatnonzero(rank)
            rank[some] += held_in(frequent.value, key[some])
            grams, nodes, numbers = [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = b - a
                prefix = n - (percent * n + 99) // 100 + 1
                own = int((rank[a:b] == 0).sum())
                if own >= prefix:
                    continue
                order = np.argsort(rank[a:b], kind="stable")[own:prefix]  # by hash within a rank
                grams.append(flat[a:b][order])
                nodes.append(np.full(len(order), node[i], _U))
                held = len(order)
                same = np.array([n, own, int((rank[a:b] < 2).sum()), held])
                numbers.append(np.column_stack((np.tile(same[:3], (held, 1)), np.arange(held), np.full(held, held))))
            if grams:
                g, m, rest = (np.concatenate(x) for x in (grams, nodes, numbers))
                yield pa.RecordBatch.from_arrays([_signed(g), _signed(m), *[pa.array(x, pa.int32()) for x in rest.T]], ["gram", "node", *_NUMBERS])

    # A class may come from several batches: once each, summed up before the shuffle.
    found = rows.mapInArrow(cut, "gram bigint, node bigint, " + ", ".join(f"{c} int" for c in _NUMBERS))
    return found.groupBy("gram", "node").agg(*[F.min(c).alias(c) for c in _NUMBERS])


def _possible(percent: int, n1, own1, n2, own2):
    most = F.least(n1 - own1, n2 - own2)
    return 100 * most >= percent * (n1 + n2 - most)


def _least_met(percent: int, n1, n2):
    """How many n-grams two linked sets have in common within both prefixes, at least.

    Common n-grams outside are at most what is left of the longer rest.
    """
    needed = F.ceil((n1 + n2) * percent / (100.0 + percent) - 1e-9)
    rest = F.greatest(*[F.ceil(n * percent / 100) - 1 for n in (n1, n2)])
    return F.greatest(needed - rest, F.lit(1))


def _verified(rows: DataFrame, words: int, percent: int, firsts, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are linked: partial overlaps counted by fragment and summed."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    part_bits = PARTS.bit_length() - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, bounds, node in _first_rows(batches, words, firsts.value):
            keep = np.flatnonzero(held_in(wanted.value, node))
            out = []
            for i in keep.tolist():
                grams = flat[bounds[i]: bounds[i + 1]]
                edges = np.searchsorted(grams >> _U(64 - part_bits), np.arange(PARTS + 1, dtype=_U))
                out += [(node[i], len(grams), f, grams[edges[f]: edges[f + 1]].tobytes()) for f in range(PARTS)]
            if out:
                nodes, n, part, grams = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.array(nodes, _U)), pa.array(n, pa.int32()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], ["node", "n", "part", "grams"]
                )

    schema = "node bigint, n int, part int, grams binary"
    pieces = rows.mapInArrow(cut, schema).dropDuplicates(["node", "part"])
    left = pieces.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "part", F.col("grams").alias("grams_a"))
    right = pieces.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "part", F.col("grams").alias("grams_b"))
    met = pairs.select("a", "b").join(right, "b").join(left, ["a", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), assume_unique=True)) for x, y in zip(batch.column("grams_a"), batch.column("grams_b"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "n_a", "n_b")], pa.array(both, pa.int64())], ["a", "b", "n_a", "n_b", "common"])

    partial = met.mapInArrow(count, "a bigint, b bigint, n_a int, n_b int, common bigint")
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return summed.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, tag, n_shingles, class_id, component_id, group_id`` for each row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds
    the distinct runs of ``words`` words, or the whole of a shorter text. Texts
    with ``100 * intersection >= percent * union`` are linked; ``component_id`` is
    the smallest id reachable by links, ``class_id`` the smallest with an equal set.
    ``tag`` hashes the text; ``group_id`` names the component, NULL for empty sets.

    A NULL text, or one without words, has an empty set and is linked with
    nothing: both ids are its own. A NULL id is reported as NULL and reached, but
    never the smallest. Rows that repeat an id are rows of their own, each linked
    by its text. Other columns are ignored; an empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    send = spark.sparkContext.broadcast
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.hash(F.col(text)).alias("tag"), F.col(text).alias("text"))
    classes = work_table(_classes(rows, words), "classes")
    filled = classes.where("n > 0")
    ids = filled.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))).alias("first"), F.min("doc_id").alias("class_id"), F.max("n").alias("n"))
    ids = work_table(ids, "class-ids")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(_row_key(batch.column("first").to_numpy(), batch.column("node").to_numpy().view(_U)))], ["key"])

    firsts = send(bloom(ids.select("first", "node").mapInArrow(keys, "key bigint")))
    total = ids.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(6, int(total // FRAGMENT_NGRAMS).bit_length()))
    counted = work_table(_counted(rows, words, firsts, bits), "shared-grams")
    shared, frequent = send(bloom(counted.select("gram"))), send(bloom(counted.where("frequent").select("gram")))
    postings = work_table(_postings(rows, words, percent, firsts, shared, frequent, bits), "postings")

    # A hub for each bucket and size, and for each set the two hubs that it shares most buckets with.
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(1.15))
    hubs = postings.groupBy("gram", band.alias("band")).agg(F.min(F.struct("rare", "own", "node", "n")).alias("hub"))
    star = postings.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).join(hubs, ["gram", "band"]).where(F.col("node") != F.col("hub.node"))
    star = star.where(_possible(percent, F.col("n"), F.col("own"), F.col("hub.n"), F.col("hub.own")))
    star = star.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b")).agg(F.count("*").alias("met"))
    best = top_n(star, ["b"], [F.col("met").desc(), F.col("a")], 2)
    tested = work_table(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    links = work_table(_verified(rows, words, percent, firsts, tested), "links")

    # Whatever is still apart is compared if the prefixes say so. Linked sets meet ``least`` times in
    # the prefixes, so the first time is early enough in both for the others to follow.
    placed = postings.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    apart = work_table(placed.join(mixed, "gram"), "apart")
    x, y = apart.alias("x"), apart.alias("y")
    least = _least_met(percent, F.col("x.n"), F.col("y.n"))
    across = x.join(
        y,
        (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label")) & (F.col("x.place") + least <= F.col("x.held")) & (F.col("y.place") + least <= F.col("y.held"))
        & _possible(percent, F.col("x.n"), F.col("x.own"), F.col("y.n"), F.col("y.own")),
    )
    across = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    prefixes = postings.groupBy("node").agg(F.collect_list("gram").alias("grams"), F.max("n").alias("n"))
    for end in ("a", "b"):
        across = across.join(prefixes.select(F.col("node").alias(end), F.col("grams").alias(f"grams_{end}"), F.col("n").alias(f"n_{end}")), end)
    met = F.size(F.array_intersect("grams_a", "grams_b"))
    pairs = work_table(across.where(met >= _least_met(percent, F.col("n_a"), F.col("n_b"))).select("a", "b"), "across")
    links = work_table(links.unionByName(_verified(rows, words, percent, firsts, pairs)), "links")

    joined = ids.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = joined.join(least, "label").select("node", "class_id", "component_id", F.col("label").alias("group_id"))
    full = classes.join(named, "node", "left")
    alone = F.col("n") == 0
    return full.select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), F.when(~alone, F.col("group_id")).alias("group_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
