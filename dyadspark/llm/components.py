"""Connected components by alternating large and small stars over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import written


def _star(neighbours: DataFrame, larger: bool) -> DataFrame:
    """neighbours (u, v): hangs v's on the least of u's neighbourhood; on the large star only those above u."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select(F.when(F.col("m").isNotNull(), F.col("u")).alias("u"), F.least("m", "u").alias("m"))
    joined = neighbours.join(least, "u")  # u being an expression there, both sides are dealt out anew, and Spark can split a large star
    hung = joined.where(F.col("v") > F.col("u")).withColumn("x", F.array("v")) if larger else joined.withColumn("x", F.array("u", "v"))
    return hung.select(F.explode("x").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of edges (a, b); null and looping edges are no edges.

    Every round halves paths at least, and the stars of candidate search are settled in a few. A node with very many
    neighbours is one row after partial aggregation, and its join is one that Spark splits. Each round is written, so a lost
    executor costs no more than a round.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now, before = written(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = _star(both, True)
        small = _star(large.where(F.col("u") != F.col("v")).distinct(), False)
        now = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
    return now.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("root")).distinct()
