"""Exact top-k by inner product in a forest of paged metric trees (operator 3).

With M the greatest norm, a vector x becomes x' = (x, sqrt(M^2 - |x|^2)) and a
query q becomes (q, 0); then d(q, x')^2 = |q|^2 + M^2 - 2 q.x, so the largest
products are the nearest neighbours in a metric space.

The root node has up to ``ROOTS`` routing objects, chosen among all vectors; every
vector goes to the subtree of the nearest one. A subtree is bounded (a crowded one
is dealt into several), is cut into pages around routing objects of its own, and
stores for each page the covering radius and the distance to the parent, for each
entry the distance to the page's routing object. A search starts with the scores
of the root's routing objects, takes the pages of a subtree best first, leaves it
when the next lower bound is too far, and uses the stored distances to skip
computing: |d(q, parent) - d(parent, page)| - radius and |d(q, page) - d(page, x)|
are lower bounds by the triangle inequality. Nothing else is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.common import top_n
from recollect.session import ship, work_dir

ROOTS = 64
#: Vectors of one subtree and of one page.
TREE, PAGE = 1 << 15, 64
#: Queries that travel together.
BLOCK = 256
#: Distances are in floating point: bounds this much too far are still visited.
_SLACK = 1e-3

_TREE_SCHEMA = "tree bigint, page int, parent_distance double, radius double, pivot binary, vectors binary, distances binary, ids array<array<bigint>>"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component; NULL for vectors that take no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class _Space:
    """Products and distances of integer vectors under the greatest squared norm."""

    def __init__(self, dim: int, greatest: int):
        self.dim, self.greatest = dim, greatest
        # Products are whole numbers of at most ``greatest``: doubles hold them exactly up to 2**53.
        self.kind = np.float64 if greatest < 1 << 52 else np.int64

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim), np.int64)
        for row, v in zip(out, vectors):
            row[: len(v)] = v
        return out.astype(self.kind)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.greatest - (x * x).sum(1)).astype(np.float64))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors."""
        product = (x @ y.T).astype(np.float64) + np.outer(self.lift(x), self.lift(y))
        return np.sqrt(np.maximum(0, 2.0 * self.greatest - 2 * product))

    def from_query(self, norm: float, product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, norm + self.greatest - 2.0 * product))


def _pages(space: _Space, x: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Routing object and members of each page: parts are split around their farthest members until they fit."""
    todo = [np.arange(len(x))]
    while todo:
        part = todo.pop()
        far = part[int(np.argmax(space.between(x[part], root)))]
        if len(part) <= PAGE:
            centre = part[int(np.argmin(space.between(x[part], x[part].mean(0, keepdims=True).astype(space.kind))))]
            yield int(centre), part
            continue
        # Pivots: the farthest member, then each the farthest from those before.
        pivots, nearest = [far], space.between(x[part], x[[far]])[:, 0]
        for _ in range(min(15, len(part) // PAGE)):
            pivots.append(part[int(np.argmax(nearest))])
            nearest = np.minimum(nearest, space.between(x[part], x[[pivots[-1]]])[:, 0])
        pivots = list(dict.fromkeys(pivots))
        to = np.argmin(space.between(x[part], x[pivots]), axis=1)
        parts = [part[to == i] for i in range(len(pivots))]
        if max(map(len, parts)) == len(part):  # nothing to tell them apart by
            parts = [part[i: i + PAGE] for i in range(0, len(part), PAGE)]
        todo += [p for p in parts if len(p)]


def _build(space: _Space, roots: np.ndarray, n_roots: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(number: int, vectors: list, ids: list) -> Iterator[pa.RecordBatch]:
            x, root = space.matrix(vectors), roots[[number % n_roots]]
            for page, (centre, part) in enumerate(_pages(space, x, root)):
                entry = space.between(x[part], x[[centre]])[:, 0]
                values = [
                    [number], [page], [float(space.between(x[[centre]], root)[0, 0])], [float(entry.max())], [x[centre].astype("<i8").tobytes()],
                    [x[part].astype("<i8").tobytes()], [entry.tobytes()], [[ids[i] for i in part.tolist()]],
                ]
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c.split()[0] for c in _TREE_SCHEMA.split(", ")])

        number, vectors, ids = None, [], []
        for batch in batches:
            for t, v, i in zip(*(batch.column(c).to_pylist() for c in ("tree", "vector", "ids"))):
                if t != number and vectors:
                    yield from tree(number, vectors, ids)
                    vectors, ids = [], []
                number = t
                vectors.append(v)
                ids.append(i)
        if vectors:
            yield from tree(number, vectors, ids)

    return build


class _Tree:
    def __init__(self, space: _Space, number: int, root: np.ndarray, rows: list[dict]):
        self.space, self.number, self.root = space, number, root
        read = lambda b: np.frombuffer(b, "<i8").reshape(-1, space.dim).astype(space.kind)
        self.pivots = np.concatenate([read(r["pivot"]) for r in rows])
        self.vectors = [read(r["vectors"]) for r in rows]
        self.distances = [np.frombuffer(r["distances"]) for r in rows]
        self.ids = [r["ids"] for r in rows]
        self.parent = np.array([r["parent_distance"] for r in rows])
        self.radius = np.array([r["radius"] for r in rows])

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """At most k pairs (score, id), best first; scores below ``floor`` don't matter."""
        space = self.space
        norm = float((query * query).sum())
        best: list[tuple[int, int]] = []
        limit = np.inf if floor is None else float(space.from_query(norm, np.float64(floor))) + _SLACK
        to_root = float(space.from_query(norm, np.float64(self.root @ query)))
        near = np.flatnonzero(np.abs(to_root - self.parent) - self.radius <= limit)
        if not len(near):
            return best
        to_page = space.from_query(norm, (self.pivots[near] @ query).astype(np.float64))
        bound = to_page - self.radius[near]
        for i in np.argsort(bound, kind="stable").tolist():
            if bound[i] > limit:
                break
            page = near[i]
            entries = np.flatnonzero(np.abs(to_page[i] - self.distances[page]) <= limit)
            scores = self.vectors[page][entries] @ query
            if len(best) == k:
                use = np.flatnonzero(scores >= best[-1][0])
                entries, scores = entries[use], scores[use]
            if not len(entries):
                continue
            ids = self.ids[page]
            best += [(int(s), n) for s, e in zip(scores.tolist(), entries.tolist()) for n in ids[e] if n != own]
            best.sort(key=lambda p: (-p[0], p[1]))
            del best[k:]
            if len(best) == k:
                limit = min(limit, float(space.from_query(norm, np.float64(best[-1][0]))) + _SLACK)
        return best


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest inner products of each query, ties to the smaller id.

    Both tables have ``key`` (bigint) and ``vector`` (array of integers, see
    ``quantised``). A row with the query's own id is no candidate for it.

    A NULL id or vector takes no part, a shorter vector counts as filled up with
    zeros. Rows that repeat id and vector count once; equal vectors under several
    ids are candidates each. With fewer than ``k`` candidates all are returned;
    empty tables give no rows. Other columns are ignored. Products must fit a
    bigint.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<bigint>").alias("vector")).where("id is not null and vector is not null")
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<bigint>").alias("vector")).where("id is not null and vector is not null").distinct()
    # Equal vectors are one entry: no query needs more than the k + 1 smallest ids.
    ranked = top_n(rows.distinct(), ["vector"], [F.col("id")], k + 1)
    distinct = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kept = work_dir(spark, "metric-vectors")
    distinct.withColumn("mixed", F.xxhash64("vector")).write.parquet(kept)
    distinct = spark.read.schema("vector array<bigint>, ids array<bigint>, mixed bigint").parquet(kept)
    square = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    both = distinct.select("vector").unionByName(asked.select("vector")).agg(F.max(F.size("vector")).alias("dim"), F.max(square).alias("square")).first()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    chosen = distinct.orderBy("mixed", "vector").limit(ROOTS).collect()
    if not chosen:
        return spark.createDataFrame([], result)
    space = _Space(max(1, both.dim), max(1, both.square))
    roots, root_ids = space.matrix([r.vector for r in chosen]), [r.ids for r in chosen]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = np.empty(batch.num_rows, np.int64)
            for at in range(0, batch.num_rows, 4096):
                to[at: at + 4096] = np.argmin(space.between(space.matrix(batch.column("vector").slice(at, 4096).to_pylist()), roots), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(to), *[batch.column(c) for c in ("vector", "ids", "mixed")]], ["root", "vector", "ids", "mixed"])

    routed = distinct.mapInArrow(route, "root bigint, vector array<bigint>, ids array<bigint>, mixed bigint")
    counts = dict(routed.groupBy("root").count().collect())  # a row per routing object
    dealt = {r: -(-n // TREE) for r, n in counts.items()}
    parts = F.element_at(F.create_map(*[F.lit(x) for r, n in dealt.items() for x in (r, n)]), F.col("root"))
    trees = routed.withColumn("tree", F.col("root") + ROOTS * F.pmod("mixed", parts)).select("tree", "vector", "ids")
    index = work_dir(spark, "metric-pages")
    trees.repartition("tree").sortWithinPartitions("tree").mapInArrow(_build(space, roots, ROOTS), _TREE_SCHEMA).write.parquet(index)
    pages = spark.read.schema(_TREE_SCHEMA).parquet(index)
    numbers = [r + ROOTS * i for r, n in dealt.items() for i in range(n)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = np.array(part.column("id").to_pylist(), np.int64)
                q = space.matrix(part.column("vector").to_pylist())
                scores = (q @ roots.T).astype(np.int64)
                floors = [_floor(s, root_ids, o, k) for s, o in zip(scores, own.tolist())]
                columns = [pa.array([x], pa.binary()) for x in (own.tobytes(), q.astype("<i8").tobytes(), np.array([f is not None for f in floors]).tobytes(), np.array([f or 0 for f in floors], np.int64).tobytes())]
                yield pa.RecordBatch.from_arrays(columns, ["own", "queries", "has_floor", "floors"])

    query_schema = "own binary, queries binary, has_floor binary, floors binary"
    packed = asked.mapInArrow(blocks, query_schema)
    sent = packed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(len(numbers) - 1)))).withColumn("tree", F.element_at(F.array(*map(F.lit, numbers)), F.col("tree") + 1).cast("bigint"))
    together = pages.unionByName(sent, allowMissingColumns=True).repartition("tree").sortWithinPartitions("tree", F.col("page").asc_nulls_last())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, tree = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if one["tree"] != number:
                    number, held, tree = one["tree"], [], None
                if one["page"] is not None:
                    held.append(one)
                    continue
                if tree is None:
                    tree, held = _Tree(space, number, roots[number % ROOTS], held), []
                own, q = np.frombuffer(one["own"], np.int64), np.frombuffer(one["queries"], "<i8").reshape(-1, space.dim).astype(space.kind)
                has, floors = np.frombuffer(one["has_floor"], bool), np.frombuffer(one["floors"], np.int64)
                found = [(o, i, s) for n, o in enumerate(own.tolist()) for s, i in tree.search(q[n], o, k, int(floors[n]) if has[n] else None)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = together.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint").distinct()
    return top_n(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, "rank").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(scores: np.ndarray, ids: list[list[int]], own: int, k: int) -> int | None:
    """The k-th best score among the root's routing objects, which are candidates themselves."""
    best = sorted((int(s) for s, held in zip(scores.tolist(), ids) for i in held if i != own), reverse=True)
    return best[k - 1] if len(best) >= k else None
