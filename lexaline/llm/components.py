"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaline.llm.storage import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, root) for every node of ``edges(a, b)``, both of one integer type; root is the least node reachable.

    Each round is one table in the shared folder; the rounds stop when the edge set is a set of stars, after a number of
    rounds that grows with the logarithm of the longest path. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = materialize(flat, label)
    before = _state(current)
    while True:
        turned = materialize(_small_star(_large_star(current)), label)
        after = _state(turned)
        forget(spark, current)
        current = turned
        if after == before:
            break
        before = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
