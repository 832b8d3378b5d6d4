"""Results of searches kept as a table, by query, options and version of the index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import search as se
from recollect.operators.index import VectorIndex
from recollect.session import work_dir

HIT = "struct<rank:int,seq:bigint,chunk_id:string,trust:double,cosine:double,keyword_hit:boolean,hybrid:double,score:double>"
ENTRY = f"digest string, batch bigint, hits array<{HIT}>"
#: Entries of a version that are looked up: the newest ones.
ENTRIES = 128


class ResultCache:
    """Answers below ``path``, one folder per version of the index; a new version starts empty.

    An entry is one query's hits, none for a query that finds nothing. The ``entries``
    newest ones are looked up, so older ones are forgotten as in a queue.
    """

    def __init__(self, spark: SparkSession, path: str, entries: int = ENTRIES):
        self.spark, self.path, self.entries = spark, path.rstrip("/"), entries
        #: Queries that the last call had to compute.
        self.computed = 0

    def _held(self, version: int) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).parquet(f"{self.path}/version-{version}")
        except AnalysisException:
            return self.spark.createDataFrame([], ENTRY)

    def search_batch(self, index: VectorIndex, queries: DataFrame, query_id: str, query_text: str, top_k: int = 5) -> DataFrame:
        """``search.semantic_search_batch`` over ``index`` with a column ``cached``; each distinct text that is not held is computed once.

        The embedder, the weights of the scores and ``top_k`` are part of an entry's name, as
        are the text's own letters. A NULL text is an empty one.
        """
        settings = index.settings
        options = F.lit(f"{index.label}|{settings.semantic}|{settings.trust.weight}|{settings.trust.default}|{int(top_k)}|")
        text = F.coalesce(F.col(query_text), F.lit(""))
        keyed = queries.select(F.col(query_id).alias("query_id"), text.alias("text"), F.sha2(F.concat(options, text).cast("binary"), 256).alias("digest"))
        held = self._held(index.version)
        newest = held.select("digest", "batch").orderBy(F.col("batch").desc(), "digest").limit(self.entries)
        known = held.join(F.broadcast(newest), ["digest", "batch"], "left_semi") if self.entries < 1 << 20 else held
        known = _kept(known.join(keyed.select("digest").distinct(), "digest", "left_semi"), "cached")
        missing = _kept(keyed.select("digest", "text").dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti"), "missing")
        self.computed = missing.count()
        answers = known.select("digest", "hits", F.lit(True).alias("cached"))
        if self.computed:
            found = se.semantic_search_batch(index.rows(), missing, "digest", "text", top_k, settings)
            # At most top_k rows a query.
            hit = F.struct(*[F.col(f.split(":")[0]).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in HIT[len("struct<"): -1].split(",")])
            grouped = found.groupBy(F.col("query_id").alias("digest")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
            batch = held.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
            fresh = missing.select("digest").join(grouped, "digest", "left")
            fresh = _kept(fresh.select("digest", F.lit(batch).cast("bigint").alias("batch"), F.coalesce("hits", F.array().cast(f"array<{HIT}>")).alias("hits")), "computed")
            fresh.write.mode("append").parquet(f"{self.path}/version-{index.version}")
            answers = answers.unionByName(fresh.select("digest", "hits", F.lit(False).alias("cached")))
        return keyed.join(answers, "digest").select("query_id", "cached", F.explode("hits").alias("h")).select("query_id", "cached", "h.*")


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as written to the shared work folder."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
