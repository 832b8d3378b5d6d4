"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.filters import work_table


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges`` (``a, b`` bigint): the least node of its component.

    Each round gives a node the least label around it, then that label's own
    label, so a chain shrinks by more than half; rounds end when none changes.
    An edge table without rows gives none; loops and repeated edges do no harm.
    """
    both = work_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        jumped = lower.join(jump, F.col("label") == F.col("_at"), "left").select("node", "old", F.coalesce(F.least("label", "_to"), "label").alias("label"))
        now = work_table(jumped, "labels")
        labels = now.select("node", "label")
        if now.where("old <> label").isEmpty():
            return labels
