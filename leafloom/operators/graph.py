"""Reachability over a table of edges."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.lineage import cut

#: Hops between two writes, and rounds after which what was found so far is written as one table.
HOPS, MERGE_ROUNDS = 4, 50


def reachable(spark: SparkSession, edges: DataFrame, entry: list[int], hops: int = HOPS) -> DataFrame:
    """(node, depth): all nodes that the entries reach, with their distance. A round takes ``hops`` steps from
    the nodes found last, keeps of each node the first step that meets it, and takes out what was seen; cycles
    end by that, and the rounds are as many as the longest shortest path has steps, over ``hops``. Edges stay
    dealt by their source, so a step moves its nodes only. Each round writes what it finds: what was seen is the
    union of that, so all that is written is as large as the result. Edges without a source or target lead nowhere."""
    edges = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().repartition("src"))
    seen = frontier = cut(spark.createDataFrame([(e, 0) for e in sorted(set(entry))], "node bigint, depth int"))
    depth = rounds = 0
    while frontier.take(1):
        layer, layers = frontier, []
        for h in range(1, hops + 1):
            layer = edges.join(layer.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            layers.append(layer.withColumn("depth", F.lit(depth + h)))
        near = functools.reduce(DataFrame.unionByName, layers).groupBy("node").agg(F.min("depth").alias("depth"))
        found = cut(near.join(seen.select("node"), "node", "left_anti"))
        seen, depth, rounds = seen.unionByName(found), depth + hops, rounds + 1
        frontier = found.where(F.col("depth") == depth)  # what lies further is behind these
        if rounds % MERGE_ROUNDS == 0:
            seen = cut(seen)  # a union of very many parts is slow to plan
    return seen


def payload(spark: SparkSession, edges: DataFrame, nodes: DataFrame, entry: list[int], heavy: str, limit: int) -> DataFrame:
    """What an entry loads (nodes: node, name, bytes): files, bytes, heavy names, and whether it is over
    the limit."""
    own = nodes.join(reachable(spark, edges, entry), "node")
    totals = own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("name").rlike(heavy)).alias("heavy"))
    return totals.withColumn("over", F.col("bytes") > limit)


def closure_union(parts: list[DataFrame]) -> DataFrame:
    """The distinct rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
