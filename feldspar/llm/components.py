"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.llm.common import new_dir, remove, written


def _is_forest(edges: DataFrame) -> bool:
    """Every left end occurs once and is nobody's right end: each tree is a star around its smallest node."""
    many = edges.groupBy("u").count().where("count > 1").limit(1).count()
    return not many and not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def connected(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, root (the smallest node of its component) for each node of ``edges`` (two long columns) but the roots.

    Every step is a written table. A hub's edges are aggregated before the shuffle, and the joins back to the edges are
    equi-joins whose skewed side Spark may split. Loops and repeated edges are allowed; an empty table gives no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    path = new_dir(spark, "edges")
    now = written(pairs, path)
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        middle_path = new_dir(spark, "edges")
        middle = written(large, middle_path)
        least = middle.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        next_path = new_dir(spark, "edges")
        now, old, path = written(small, next_path), path, next_path
        remove(spark, old, middle_path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
