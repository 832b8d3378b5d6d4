"""Evaluating one column over literal rows."""

from pyspark.sql import functions as F


def evaluate(spark, values, build, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema).select("i", build(F.col("v")).alias("out"))
    return [r.out for r in df.orderBy("i").collect()]
