"""The vector index of the notes: their vectors, and bounds of each block's weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.vectors import EMBEDDER, embed, sparse
from recollect.operators import embed as em
from recollect.operators import search as se
from recollect.operators.chunks import scope
from recollect.operators.note_index import NOTE, NoteIndex
from recollect.settings import DEFAULTS, Settings

#: Blocks of the first wave of a search, and blocks that a scan is told by name.
FIRST_BLOCKS, NAMED_BLOCKS = 8, 2048
BOUNDS = "slot int, block bigint, hi double, lo double"
TRUST_SLOT = -1


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest and least weight by slot of each run of rows of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        vecs = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        hi, lo = np.maximum.reduceat(vecs, first), np.minimum.reduceat(vecs, first)
        run, slot = np.nonzero((hi != 0) | (lo != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(block[first][run]), pa.array(hi[run, slot]), pa.array(lo[run, slot])], ["slot", "block", "hi", "lo"]
        )


def block_bounds(rows: DataFrame) -> DataFrame:
    """``slot, block, hi, lo``: no weight of the block is above ``hi`` or below ``lo``; absent slots are 0 throughout."""
    weights = rows.select("block", "vec").mapInArrow(_weights, BOUNDS).groupBy("slot", "block")
    trust = F.max(F.coalesce("trust", F.lit(DEFAULTS.trust.default)))
    own = rows.groupBy("block").agg(trust.alias("hi")).select(F.lit(TRUST_SLOT).alias("slot"), "block", "hi", F.lit(0.0).alias("lo"))
    # Most rows have a 0 in a slot.
    return weights.agg(F.greatest(F.max("hi"), F.lit(0.0)).alias("hi"), F.least(F.min("lo"), F.lit(0.0)).alias("lo")).unionByName(own)


class VectorIndex(NoteIndex):
    """An index of the notes below ``path``; another embedder brings its ``name``, ``dim`` and ``vectorize``.

    Notes without a feature have no row. Beside the rows, ``bounds-N`` holds for each slot and block
    the largest and the least weight, sorted by slot; slot -1 has the block's largest trust.
    """

    schema = NOTE + ", embedder string, dim int, vec array<double>, block bigint"

    def __init__(
        self, spark: SparkSession, path: str, settings: Settings = DEFAULTS, name: str = EMBEDDER, vectorize: Callable[[Column], Column] | None = None,
    ):
        self.name, self.vectorize, self.dim = name, vectorize, settings.semantic.dim
        self.label = f"{name}/{self.dim}"
        super().__init__(spark, path, settings)

    def derived(self, notes: DataFrame) -> DataFrame:
        return em.with_vectors(notes, self.dim, self.vectorize, self.name)

    def beside(self, version: int, rows: DataFrame) -> list[tuple[str, str, int]]:
        bounds = self._write("bounds", version, block_bounds(rows).repartitionByRange("slot", "block").sortWithinPartitions("slot", "block"))
        return [("bounds", f"bounds-{version}", bounds.count())]

    def bounds(self) -> DataFrame:
        return self._read("bounds", BOUNDS)

    def search(
        self, query: str, top_k: int = 5, tags: Sequence[str] | None = None, project_id: str | None = None, agent_id: str | None = None,
        hybrid: bool = True, query_vector: Sequence[float] | None = None,
    ) -> DataFrame:
        """``search.semantic_search`` over the blocks that can matter; the rows are the same.

        A block's bound is the sum over the query's slots of the larger of weight times ``hi``
        and weight times ``lo``; damping enters with the block's largest trust, and the bonus as it goes to the first by
        cosine only. The blocks of the highest bounds are scored first. What they reach is what
        others must be able to reach.
        """
        vector = embed(query, self.dim) if query_vector is None else np.asarray(query_vector, float)
        blocks = self.needed_blocks(vector, top_k, hybrid, lambda rows: scope(rows, tags, project_id, agent_id))
        rows = self._of_blocks(blocks)
        return se.semantic_search(rows, query, top_k, tags, project_id, agent_id, hybrid, self.settings, vector)

    def context_prompt(self, query: str, project_id: str | None = None, agent_id: str | None = None, tags: Sequence[str] | None = None, max_chunks: int | None = None, max_chars: int | None = None) -> DataFrame:
        """``search.context_prompt`` of what ``search`` finds."""
        n = self.settings.semantic.prompt_chunks if max_chunks is None else max_chunks
        hits = self.search(query, n, tags, project_id, agent_id)
        return se.context_prompt(self.rows(), query, project_id, agent_id, tags, max_chunks, max_chars, self.settings, hits)

    def _bounded(self, vector: np.ndarray) -> DataFrame:
        """``block, cosine, low``: no row of the block has more, before and after damping."""
        weights = sparse(vector)
        slots = [TRUST_SLOT, *weights]
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in {TRUST_SLOT: 0.0, **weights}.items() for x in pair]), F.col("slot"))
        most = F.greatest(weight * F.col("hi"), weight * F.col("lo"))
        share = self.settings.trust.weight
        named = self.bounds().where(F.col("slot").isin(slots)).groupBy("block")
        bounded = named.agg(F.sum(most).alias("cosine"), F.max(F.when(F.col("slot") == TRUST_SLOT, F.col("hi"))).alias("trust"))
        # Sums in another order and rounding to four digits may add a little.
        bounded = bounded.where("cosine > 0").withColumn("cosine", F.col("cosine") + 2e-4)
        damp = F.lit(1.0 - share) + F.lit(share) * F.col("trust")
        return bounded.select("block", "cosine", (F.col("cosine") * damp + 2e-4).alias("low"))

    def needed_blocks(self, vector: np.ndarray, top_k: int, hybrid: bool, within: Callable[[DataFrame], DataFrame]) -> list[int] | None:
        """The blocks that the result can come from, or None if they are more than ``NAMED_BLOCKS``."""
        if not self.count("bounds") or not sparse(vector):
            return []
        bounded = self._bounded(vector).persist()
        try:
            first = {r.block for c in ("cosine", "low") for r in bounded.orderBy(F.col(c).desc(), "block").limit(FIRST_BLOCKS).select("block").collect()}
            wave = se.score_chunks(within(self._of_blocks(sorted(first))), sparse(vector))
            wave = wave.withColumn("low", se.damped(F.col("cosine"), F.col("trust"), self.settings.trust.weight))
            head, tail = se.selection_sizes(top_k, hybrid)
            reach = F.lit(False)
            # At most 9 * top_k rows come back.
            for column, size in (("cosine", head), ("low", tail)):
                if size:
                    best = wave.select(column).orderBy(F.col(column).desc()).limit(size).agg(F.count("*").alias("n"), F.min(column).alias("least")).first()
                    reach = reach | (F.lit(True) if best.n < size else F.col(column) >= best.least)
            found = bounded.where(reach).select("block").limit(NAMED_BLOCKS + 1).collect()
        finally:
            bounded.unpersist()
        return None if len(found) > NAMED_BLOCKS else sorted({r.block for r in found})

    def _of_blocks(self, blocks: list[int] | None) -> DataFrame:
        """Rows of the named blocks; their ranges prune the files' row groups."""
        rows = self.all_rows()
        if blocks is not None:
            rows = rows.where(F.col("block").isin(blocks)) if blocks else rows.where("false")
        return self.standing(rows)
