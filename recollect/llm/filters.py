"""Bloom filters of one fixed size, and tables in the shared work folder.

A filter that many keys fill lets more through. Whoever asks it must stay right
then: it saves moving rows that cannot matter, and decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.session import work_dir

_U = np.uint64
#: 256 blocks of 2**19 bits: 16 MB at every size of the data.
BLOCKS, BLOCK_BITS = 256, 19


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    mask = _U((1 << BLOCK_BITS) - 1)
    mixed = tx.mix(keys)
    base = (keys >> _U(56)) << _U(BLOCK_BITS)
    return [base | (x & mask) for x in (keys, keys >> _U(24), mixed, mixed >> _U(24))]


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter over the only column of ``keys``, hashes as bigint; each block is built by one task."""
    name = keys.columns[0]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 1 << BLOCK_BITS
        for batch in batches:
            values = batch.column(0).to_numpy().view(_U)
            values = values[np.argsort(values >> _U(56), kind="stable")]
            blocks, begin = np.unique(values >> _U(56), return_index=True)
            bits = [x & _U(size - 1) for x in _probes(values)]
            for b, i, j in zip(blocks.tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)]):
                flags = held.setdefault(b, np.zeros(size, bool))
                for x in bits:
                    flags[x[i:j]] = True
        for b, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros((BLOCKS, (1 << BLOCK_BITS) // 8), np.uint8)
    dealt = keys.repartition(F.shiftrightunsigned(name, 56))
    for row in dealt.mapInArrow(build, "block int, bits binary").collect():  # at most 256 rows of 64 KB
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    tx.give_back()
    return out.reshape(-1)


def held_in(filter: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    out = np.ones(len(keys), bool)
    for at in _probes(keys):
        out &= (filter[(at >> _U(3)).astype(np.int64)] >> (_U(7) - (at & _U(7))).astype(np.uint8) & 1).astype(bool)
    return out


def work_table(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as written to the shared work folder."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
