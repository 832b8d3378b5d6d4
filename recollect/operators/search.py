"""Ranking: semantic and hybrid search, related chunks, prompt blocks, query batches.

Score: cosine rounded to 4 digits, plus the keyword bonus, times the trust
damping, rounded after each step (see :mod:`recollect.functions.numbers`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions import text as tx
from recollect.functions.numbers import fixed3, round4, round4_array
from recollect.functions.vectors import dot, dot_const, embed, sparse
from recollect.operators.chunks import scope, stored_body
from recollect.operators.common import top_n
from recollect.operators.embed import with_vectors
from recollect.session import work_dir
from recollect.settings import DEFAULTS, Settings

# The block's wording.
PROMPT_HEADER = "### Контекст из памяти по запросу: «{query}»"
PROMPT_PROJECT = " (проект: {project})"
PROMPT_EMPTY = "\n(Релевантных заметок в памяти не найдено.)\n"


def damped(score: Column, trust: Column, weight: float) -> Column:
    t = F.coalesce(trust, F.lit(DEFAULTS.trust.default))
    return round4(score * (F.lit(1.0 - weight) + F.lit(weight) * t))


def _best_first(*scores: str) -> list[Column]:
    return [F.col(s).desc() for s in scores] + [F.col("seq")]


def selection_sizes(top_k: int, hybrid: bool) -> tuple[int, int]:
    """How many of the best by cosine may earn the bonus, and how many of the best without it can still win."""
    head = max(0, 4 * int(top_k)) if hybrid else 0
    return head, head + max(1, int(top_k))


def semantic_search(
    index: DataFrame,
    query: str,
    top_k: int = 5,
    tags: Sequence[str] | None = None,
    project_id: str | None = None,
    agent_id: str | None = None,
    hybrid: bool = True,
    settings: Settings = DEFAULTS,
    query_vector: Sequence[float] | None = None,
    bodies: DataFrame | None = None,
) -> DataFrame:
    """The ``top_k`` best chunks of ``index`` (see ``with_vectors``) for a query.

    One pass scores every chunk: the query vector is a constant in the plan, so
    no join is involved, and no text is read. The keyword bonus goes only to the
    ``4 * top_k`` best by cosine, which makes two top-n selections over the same
    scores. Each Arrow batch of narrow score rows is first cut to what either
    selection can still want; the rest passes one exchange that both selections
    reuse. The second takes enough rows that those of the first cannot crowd out a
    winner, so the result is exact.

    The selected rows, nine times ``top_k`` at most, come to the driver; the texts
    of the first selection are then read by their ``seq``, from ``bodies`` (the note
    columns) if the index itself is not a table. An index of another embedder needs
    its ``query_vector``.
    """
    conf = settings.semantic
    weights = sparse(embed(query, conf.dim) if query_vector is None else np.asarray(query_vector, float))
    best, weight = max(1, int(top_k)), settings.trust.weight
    head_size, tail_size = selection_sizes(top_k, hybrid)
    scored = score_chunks(scope(index, tags, project_id, agent_id), weights)
    scored = scored.withColumn("low", damped(F.col("cosine"), F.col("trust"), weight))
    if head_size <= 0:
        # No chunk can earn the bonus: a single selection.
        plain = scored.select("*", F.lit(False).alias("keyword_hit"), F.col("cosine").alias("hybrid")).withColumnRenamed("low", "score")
        return plain.orderBy(*_best_first("score", "hybrid", "cosine")).limit(best)

    rows = selected(scored, head_size, tail_size).drop("low").collect()
    hits = keyword_hits(index if bodies is None else bodies, [r.seq for r in rows if r.in_head], _strip(query).lower())
    schema = T.StructType([f for f in scored.schema.fields if f.name != "low"]).add("keyword_hit", T.BooleanType())
    found = index.sparkSession.createDataFrame([(*r[:-1], r.seq in hits) for r in rows], schema)
    return (
        found.withColumn("hybrid", with_bonus(conf.keyword_bonus))
        .withColumn("score", damped(F.col("hybrid"), F.col("trust"), weight))
        .orderBy(*_best_first("score", "hybrid", "cosine"))
        .limit(best)
    )


def keyword_hits(notes: DataFrame, places: Sequence[int], needle: str) -> set[int]:
    """Those of a few places whose text holds the needle."""
    if not needle or not places:
        return set()
    named = notes.where(F.col("seq").isin(list(places)))
    return {r.seq for r in named.where(F.contains(F.lower(stored_body(named)), F.lit(needle))).select("seq").collect()}


def selected(scored: DataFrame, head_size: int, tail_size: int) -> DataFrame:
    """The best rows by ``cosine`` (``in_head``) and the best by ``low``, over one exchange of what each batch has."""
    scored = _contenders(scored, head_size, tail_size).repartition("seq")
    head = scored.orderBy(*_best_first("cosine")).limit(head_size)
    tail = scored.orderBy(*_best_first("low", "cosine")).limit(tail_size)
    both = head.withColumn("in_head", F.lit(True)).unionByName(tail.withColumn("in_head", F.lit(False)))
    return both.groupBy(*scored.columns).agg(F.max("in_head").alias("in_head"))


def _contenders(scored: DataFrame, n_cosine: int, n_low: int) -> DataFrame:
    """Cuts every Arrow batch to its first rows in either order."""

    def cut(batches):
        for batch in batches:
            seq, cosine, low = (batch[c].to_numpy(zero_copy_only=False) for c in ("seq", "cosine", "low"))
            everyone = np.arange(batch.num_rows)
            kept = np.union1d(_leading(everyone, n_cosine, cosine, seq), _leading(everyone, n_low, low, seq, cosine))
            yield batch.take(pa.array(kept))

    return scored.mapInArrow(cut, scored.schema)


def with_bonus(bonus: float) -> Column:
    return F.when(F.col("keyword_hit"), round4(F.col("cosine") + bonus)).otherwise(F.col("cosine"))


def _strip(text: str) -> str:
    return text.strip(tx.BLANKS)


def score_chunks(index: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Narrow score rows of the chunks with a positive cosine."""
    return (
        index.withColumn("_cos", dot_const(F.col("vec"), weights))
        .where(F.col("_cos") > 0)
        .select("seq", "chunk_id", "project_id", "tags", "trust", round4(F.col("_cos")).alias("cosine"))
    )


def related(index: DataFrame, chunk_id: str, top_k: int = 5, key: str = "chunk_id",
            vector: str = "vec", order: str = "seq") -> DataFrame:
    """Chunks most similar to a stored one, itself excluded.

    The base vector, one row, is looked up first and becomes a constant.
    """
    row = index.where(F.col(key) == chunk_id).select(vector).first()
    base = F.lit(None).cast("array<double>") if row is None else F.lit([float(x) for x in row[0]])
    return (
        index.where(F.col(key) != chunk_id)
        .withColumn("_cos", dot(F.col(vector), base))
        .where(F.col("_cos") > 0)
        .withColumn("score", round4(F.col("_cos")))
        .drop("_cos", vector)
        .orderBy(F.col("score").desc(), F.col(order))
        .limit(max(1, int(top_k)))
    )


def context_prompt(
    index: DataFrame,
    query: str,
    project_id: str | None = None,
    agent_id: str | None = None,
    tags: Sequence[str] | None = None,
    max_chunks: int | None = None,
    max_chars: int | None = None,
    settings: Settings = DEFAULTS,
    hits: DataFrame | None = None,
) -> DataFrame:
    """One row ``text, chunks, chars``: a ready block of the best chunks in a character budget.

    ``hits`` are the chunks if a search has found them already.
    """
    n_chunks = settings.semantic.prompt_chunks if max_chunks is None else max_chunks
    limit = settings.semantic.prompt_chars if max_chars is None else int(max_chars)
    hits = semantic_search(index, query, n_chunks, tags, project_id, agent_id, True, settings) if hits is None else hits
    header = PROMPT_HEADER.format(query=_strip(query))
    header += (PROMPT_PROJECT.format(project=project_id) if project_id else "") + "\n"
    empty = header + PROMPT_EMPTY
    # At most n_chunks rows: their bodies are then read by a filter the scan can prune with.
    found_rows = hits.collect()
    wanted = index.where(F.col("seq").isin([r.seq for r in found_rows]))
    bodies = wanted.select("seq", stored_body(wanted).alias("_body"))
    rows = index.sparkSession.createDataFrame(found_rows, hits.schema).join(bodies, "seq")
    order = F.struct((-F.col("score")).alias("a"), (-F.col("hybrid")).alias("b"),
                     (-F.col("cosine")).alias("c"), "seq")
    picked = F.array_sort(F.collect_list(F.struct(
        order.alias("order"), "chunk_id", "score", "project_id", "tags", "_body")))
    room_each = F.floor(F.lit(max(200, limit - len(header))) / F.size("hits")).cast("int")

    def entry(hit: Column, i: Column) -> Column:
        title = F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] score="), fixed3(hit["score"]),
            F.lit(" | project: "), F.coalesce(F.nullif(hit["project_id"], F.lit("")), F.lit("general")),
            F.lit(" | tags: "), F.coalesce(F.nullif(F.array_join(hit["tags"], ", "), F.lit("")), F.lit("-")),
            F.lit("\n"),
        )
        room = F.col("room_each") - F.length(title) - 1
        return F.struct(
            hit["chunk_id"].alias("chunk_id"), room.alias("room"),
            F.concat(title, F.substring(hit["_body"], F.lit(1), room), F.lit("\n")).alias("text"),
        )

    used = F.filter(F.transform("hits", entry), lambda e: e["room"] > 0)
    block = tx.strip(F.concat_ws("\n", F.lit(header), F.array_join(F.transform("used", lambda e: e["text"]), "\n")))
    cut = F.when(F.length(block) > limit, F.concat(tx.rstrip(F.substring(block, 1, limit)), F.lit("…"))).otherwise(block)
    found = F.size("hits") > 0
    return (
        rows.agg(picked.alias("hits"))
        .withColumn("room_each", F.when(found, room_each))
        .withColumn("used", F.when(found, used))
        .select(
            F.when(found, cut).otherwise(F.lit(empty[:limit])).alias("text"),
            F.when(found, F.transform("used", lambda e: e["chunk_id"])).otherwise(F.array().cast("array<string>")).alias("chunks"),
            F.when(found, F.length(cut)).otherwise(F.lit(len(empty))).alias("chars"),
        )
    )


# --- many queries at once -------------------------------------------------

#: Rows of one block of a matrix product, on either side.
BLOCK_VECTORS = 1024
#: Bytes of packed queries up to which every task gets all of them.
_BROADCAST_BYTES = 64 << 20


def _packed_queries(queries: DataFrame, query_id: str, query_text: str, dim: int) -> DataFrame:
    """``block, ids, matrix``: the queries' vectors in numbered blocks, embedded where they are."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = queries.schema[query_id].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                matrix = np.stack([embed(text or "", dim) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], arrow), pa.array([matrix.tobytes()], pa.binary())], ["ids", "matrix"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("matrix", T.BinaryType())])
    packed = queries.select(query_id, query_text).mapInArrow(pack, schema)
    return packed.select(F.monotonically_increasing_id().alias("query_block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))


def _packed_index(index: DataFrame) -> DataFrame:
    """``block`` and its rows' places, ids, trust and matrix."""
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                matrix = part.column("vec").flatten().to_numpy(zero_copy_only=False).tobytes()
                columns = [pa.array([part.column(c).to_pylist()]) for c in ("seq", "chunk_id", "trust")]
                yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(columns, kinds)], pa.array([matrix], pa.binary())], ["seqs", "chunk_ids", "trusts", "matrix"])

    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64())]
    packed = index.select("seq", "chunk_id", "trust", "vec").mapInArrow(pack, "seqs array<bigint>, chunk_ids array<string>, trusts array<double>, matrix binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def semantic_search_batch(
    index: DataFrame, queries: DataFrame, query_id: str, query_text: str,
    top_k: int = 5, settings: Settings = DEFAULTS, bodies: DataFrame | None = None,
) -> DataFrame:
    """``semantic_search`` for every row of ``queries``: (query_id, rank, chunk_id, score, ...).

    Both sides are packed into numbered blocks of vectors where they lie; each
    pair of blocks is one matrix product, and of each query only the rows that can
    still be among its head or winners leave the task. These partial results are
    merged by query in two steps, as a selection of n rows is cut on the map side first.
    The query blocks go to every task if they are small, else block meets block in
    a Cartesian product of the two packed tables. Texts are read for the heads only. Nothing
    passes through the driver. ``query_id`` tells the queries apart; a NULL or empty text finds nothing.
    """
    conf, best, weight = settings.semantic, max(1, int(top_k)), settings.trust.weight
    head_size, tail_size = selection_sizes(top_k, True)
    packed = _kept(_packed_queries(queries, query_id, query_text, conf.dim), "query-blocks")
    n_queries = packed.agg(F.coalesce(F.sum(F.size("query_ids")), F.lit(0))).first()[0]
    if n_queries * conf.dim * 8 <= _BROADCAST_BYTES:
        packed = F.broadcast(packed)
    kind = queries.schema[query_id].dataType
    schema = T.StructType([
        T.StructField("query_id", kind), T.StructField("seq", T.LongType()), T.StructField("chunk_id", T.StringType()),
        T.StructField("trust", T.DoubleType()), T.StructField("cosine", T.DoubleType()),
    ])
    default_trust, dim = settings.trust.default, conf.dim

    def products(batches):
        held: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]
                left, right = (np.frombuffer(get(c).as_buffer(), np.float64).reshape(-1, dim) for c in ("matrix", "query_matrix"))
                seq = get("seqs").values.to_numpy()
                trust = np.nan_to_num(get("trusts").values.to_numpy(zero_copy_only=False).astype(float), nan=default_trust)
                scores = left @ right.T
                cosine = round4_array(scores)
                low = round4_array(cosine * ((1.0 - weight) + weight * trust)[:, None])
                number = get("query_block").as_py()
                if number not in held:
                    if len(held) == _HELD:
                        yield held.pop(next(iter(held))).rows(schema.names)
                    held[number] = _Best(get("query_ids").values, head_size, tail_size)
                held[number].add(scores > 0, cosine, low, seq, trust, get("chunk_ids").values)
        for best in held.values():
            yield best.rows(schema.names)

    scored = _kept(_packed_index(index).crossJoin(packed).mapInArrow(products, schema), "partial-results")
    low = damped(F.col("cosine"), F.col("trust"), weight)
    # Both selections group by query; each is cut to its size on the map side.
    tail = top_n(scored, ["query_id"], [low.desc(), *_best_first("cosine")], tail_size, "_r").withColumn("keyword_hit", F.lit(False))
    both = tail
    if head_size > 0:
        head = top_n(scored, ["query_id"], _best_first("cosine"), head_size, "_r")
        wanted = head.select("query_id", "seq")
        texts = index if bodies is None else bodies
        texts = texts.select("seq", F.lower(stored_body(texts)).alias("_body"))
        needles = queries.select(F.col(query_id).alias("query_id"), F.lower(tx.strip(F.col(query_text))).alias("_needle")).where("_needle <> ''")
        if n_queries * head_size <= _BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        met = texts.join(wanted, "seq").join(needles, "query_id").where(F.contains("_body", F.col("_needle")))
        met = met.select("query_id", "seq", F.lit(True).alias("_met")).distinct()
        both = both.unionByName(head.join(met, ["query_id", "seq"], "left").withColumn("keyword_hit", F.coalesce("_met", F.lit(False))).drop("_met"))
    final = (
        both.groupBy(*scored.columns).agg(F.max("keyword_hit").alias("keyword_hit"))
        .withColumn("hybrid", with_bonus(conf.keyword_bonus))
        .withColumn("score", damped(F.col("hybrid"), F.col("trust"), weight))
    )
    return top_n(final, ["query_id"], _best_first("score", "hybrid", "cosine"), best, "rank")


_BROADCAST_ROWS = 1 << 20
#: Query blocks of which a task keeps the best rows so far; the small ones that every task gets are fewer.
_HELD = 32


class _Best:
    """Of a block of queries, the rows that are so far among the first by cosine or by damped cosine."""

    def __init__(self, ids: pa.Array, head: int, tail: int):
        self.ids, self.sizes = ids, (head, tail)
        self.least = [np.full(len(ids), -np.inf if n else np.inf) for n in self.sizes]
        self.columns = [np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0) for _ in range(3)]]
        self.chunk_ids = pa.array([], pa.string())

    def add(self, positive: np.ndarray, cosine: np.ndarray, low: np.ndarray, seq: np.ndarray, trust: np.ndarray, chunk_ids: pa.Array) -> None:
        """Scores of a block of rows (down) by query (across)."""
        wanted = np.zeros(positive.shape, bool)
        for n, least, value in zip(self.sizes, self.least, (cosine, low)):
            if 0 < n < len(seq):
                value = np.where(positive, value, -np.inf)
                least = np.maximum(least, np.partition(value, len(seq) - n, axis=0)[len(seq) - n])
            wanted |= value >= least
        row, owner = np.nonzero(wanted & positive)
        if not len(row):
            return
        new = (owner, seq[row], trust[row], cosine[row, owner], low[row, owner])
        owner, seq, trust, cosine, low = (np.concatenate(c) for c in zip(self.columns, new))
        keep = np.zeros(len(owner), bool)
        for k, (n, value, order) in enumerate(zip(self.sizes, (cosine, low), ((seq, -cosine), (seq, -cosine, -low)))):
            place = _place_in_group(owner, order)
            keep |= place < n
            self.least[k][owner[place == n - 1]] = value[place == n - 1]
        self.columns = [c[keep] for c in (owner, seq, trust, cosine, low)]
        self.chunk_ids = pa.concat_arrays([self.chunk_ids, chunk_ids.take(pa.array(row))]).take(pa.array(np.flatnonzero(keep)))

    def rows(self, names: list[str]) -> pa.RecordBatch:
        owner, seq, trust, cosine, _ = self.columns
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(owner)), pa.array(seq), self.chunk_ids, pa.array(trust), pa.array(cosine)], names)


def _place_in_group(group: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """0-based place of each row within its group; the last of ``order`` counts first."""
    ordered = np.lexsort((*order, group))
    starts = np.flatnonzero(np.diff(group[ordered], prepend=-1))
    place = np.empty(len(group), np.int64)
    place[ordered] = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return place


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as written to the shared work folder."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _leading(among: np.ndarray, n: int, value: np.ndarray, seq: np.ndarray,
             second: np.ndarray | None = None) -> np.ndarray:
    """The first ``n`` positions by value descending, second descending, seq ascending."""
    if n <= 0:
        return among[:0]
    if among.size > n:
        bound = np.partition(value[among], among.size - n)[among.size - n]
        among = among[value[among] >= bound]
        keys = [seq[among]] + ([] if second is None else [-second[among]]) + [-value[among]]
        among = among[np.lexsort(keys)[:n]]
    return among


def search_inline(chunks: DataFrame, query: str, tags=None, project_id=None, agent_id=None, **options) -> DataFrame:
    """Search without a stored index: filters first, then embedding, then ranking."""
    scoped = scope(chunks, tags, project_id, agent_id)
    return semantic_search(with_vectors(scoped), query, bodies=scoped, **options)
