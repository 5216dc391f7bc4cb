"""Connected components of an edge table by alternating large-star and small-star steps, each a join on the smallest neighbour.

Every step is a written table, so lineage stays short and lost executors cost one step. No list of neighbours is ever built: a node of
any degree is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v: any order, repeats allowed); component is the smallest node reachable."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = table(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while (seen := mark(now)) != before:
        before = seen
        now = table(_small(_large(now)))
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
