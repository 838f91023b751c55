"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least of u and all its v as ``m``. Wrapped keys let a node with very
    many neighbours be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", F.struct("u")).join(least, "k").drop("k")


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns u, v: numbers); a component is named by
    its least node. Alternates the large-star and small-star steps of "Connected Components in
    MapReduce and Beyond" (Kiveris et al., 2014) until nothing changes: the number of rounds grows
    with the logarithm of the size, and each round writes its edges to the shared folder."""
    now = stored(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _with_least(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        old, now = now, stored(spark, small.where("u <> v").distinct(), "edges")
        discard(old)
        after = mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
