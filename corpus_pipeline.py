"""From raw documents to training sequences, each stage one operator of ``recollect.llm``.

A stage takes all that its predecessor kept and returns the columns of documents;
the last one returns piece ids. ``run`` writes each stage's result to the shared
work folder and reads it for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontamination, jaccard_join, piece_sampling, quality, substring_dedup
from recollect.llm.filters import work_table
from recollect.session import ship

#: A segmentation and a classifier have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
_LAST_ID = (1 << 63) - 1


class _Carried:
    """Documents as ``doc_id``, ``text`` and one column of all others, so that no name of an operator's can clash with one of theirs."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.others = [c for c in docs.columns if c not in ("doc_id", "text")]
        self.docs = docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in self.others]) if self.others else F.lit(True)).alias("_carried"))

    def back(self, df: DataFrame, **changed) -> DataFrame:
        """The documents' columns, some of them by a new expression."""
        kept = {c: F.col(c) for c in ("doc_id", "text")} | {c: F.col("_carried")[c] for c in self.others}
        return df.select(*[(changed[c](kept[c]) if c in changed else kept[c]).alias(c) for c in self.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; those without words too. All columns pass."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    carried = _Carried(docs)
    return carried.back(quality.with_quality(carried.docs, quality.train(carried.docs, labels=labels)).where("keep"))


def _keyed(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    return df.withColumn("_key", F.coalesce(F.col(doc), F.lit(_LAST_ID)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (a NULL id is the largest).

    Documents without words are linked with nothing and stay; of rows that repeat
    both id and text one stays. All columns pass.
    """
    ship(spark)
    carried = _Carried(docs)
    found = _keyed(jaccard_join.near_duplicates(carried.docs))
    groups = found.where("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct("_key", "tag")).alias("first")).select("first.*")
    stay = groups.unionByName(found.where("n_shingles = 0").select("_key", "tag")).distinct()
    kept = _keyed(carried.docs).withColumn("tag", F.hash("text")).join(stay, ["_key", "tag"], "left_semi")
    return carried.back(kept.dropDuplicates(["_key", "tag"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that earlier documents have are cut out; untouched texts stay as they are.

    All columns pass; ``n_chars``, if there, is that of the new text.
    """
    ship(spark)
    carried = _Carried(docs)
    cut = substring_dedup.without_repeats(carried.docs)
    touched = F.col("n_removed") > 0
    return carried.back(
        cut, text=lambda old: F.when(touched, F.col("kept")).otherwise(old),
        n_chars=lambda old: F.when(touched, F.char_length("kept")).otherwise(old),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go. All columns pass."""
    ship(spark)
    carried = _Carried(docs)
    found = decontamination.contamination(carried.docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = _keyed(found.where("n_hit > 0 and 20 * n_hit >= n_words")).select("_key", "tag").distinct()
    marked = _keyed(carried.docs).withColumn("tag", F.xxhash64("text"))
    return carried.back(marked.join(bad, ["_key", "tag"], "left_anti"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, piece_ids``: one sampled segmentation of each text; ``lossless`` says that it decodes to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_sampling.with_sampled_pieces(docs, model, checked="lossless").select("doc_id", "lang", "source", "piece_ids", "lossless")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
