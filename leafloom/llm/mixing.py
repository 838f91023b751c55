"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent in [0, 1] and normalised: 1 keeps the natural
mix, 0 makes all sources equal. The exponent is bisected until the mix meets a target entropy and
repeats no source more often than allowed. A token budget is then spent source by source in blocks:
each block is a permutation of the source's documents by a seeded hash, whole as long as the
source's quota lasts, and the last one cut where it ends.

Everything is DataFrame expressions. Only numbers come to the driver: totals, and entropy and
repetition for a fixed number of exponents. A running sum is needed only where a quota ends inside a
block: tokens are pre-aggregated by hash range, the ranges are summed up, and only documents of the
one range in which the quota ends are summed one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.llm.common import stored

#: Exponents tried in one pass: as many as six halvings of the interval look at.
HALVINGS = 6


def count_words(text: Column) -> Column:
    """Words parted by white space; 0 for null or blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def solve_exponent(
    spark: SparkSession, sources: DataFrame, budget: int, min_entropy: float, max_repeats: float, passes: int = 5
) -> float:
    """The largest exponent at which the entropy of the weights is at least ``min_entropy`` of the
    largest possible one, raised as far as no source repeats more than ``max_repeats`` times.

    ``sources`` has ``tokens`` (> 0) by source. Entropy falls and the largest repetition falls as the
    exponent rises, so both limits are found by bisection; where they exclude each other the
    repetition limit wins. If even the natural mix repeats more (the budget is larger than
    ``max_repeats`` times all tokens), the exponent is 1.
    """
    total = sources.agg(F.sum("tokens").cast("double").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.t or total.n < 2:
        return 1.0
    wanted = min_entropy * math.log(total.n)

    def curve(low: float, high: float) -> list:
        steps = 2**HALVINGS
        share = F.col("tokens") / F.lit(total.t)
        logs = sources.select(F.log(share).alias("l"), "tokens")
        powers = logs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select(
            "i", "l", "tokens", (F.lit(low) + (high - low) * F.col("i") / steps).alias("x")
        )
        sums = powers.groupBy("i", "x").agg(
            F.sum(F.exp(F.col("x") * F.col("l"))).alias("z"),
            F.sum(F.exp(F.col("x") * F.col("l")) * F.col("x") * F.col("l")).alias("s"),
            F.max(F.exp(F.col("x") * F.col("l")) * budget / F.col("tokens")).alias("r"),
        )
        return sums.select(
            "x", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z")).alias("repeats")
        ).orderBy("x").collect()

    def bisect(ok_low) -> float:
        """Where ``ok_low`` turns from true to false on the way from 0 to 1."""
        low, high = 0.0, 1.0
        for _ in range(passes):
            rows = curve(low, high)
            below = [r.x for r in rows if ok_low(r)]
            above = [r.x for r in rows if not ok_low(r)]
            low, high = max([low, *below]), min([high, *above])
        return (low + high) / 2

    by_entropy = bisect(lambda r: r.entropy >= wanted)
    by_repeats = bisect(lambda r: r.repeats > max_repeats)
    return max(by_entropy, by_repeats)


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    min_entropy: float = 0.95,
    max_repeats: float = 4.0,
    seed: int = 17,
    range_rows: int = 5000,
) -> DataFrame:
    """The mixture as a manifest: one row per document and block in which it is drawn, with the id,
    ``source``, ``tokens``, ``weight`` (of the source), ``block`` (from 0) and ``place`` (order of the
    block's permutation, in [0, 1)). ``budget`` tokens are spent; by default as many as there are.

    A source's quota is ``weight * budget``, in whole tokens. Each whole block holds every document of the source; in
    the last block the permutation is followed as long as the quota isn't exceeded.

    Defined cases: a null text has no tokens; documents without tokens cost nothing and come along in
    every block they precede the cut of; sources without tokens have no weight and aren't drawn; a
    null source is a source of its own; rows with a null or repeated id are documents of their own;
    an empty table gives an empty manifest. Other columns aren't read, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(source_col).alias("source")).alias("k"),  # compares null sources as equal
        count_words(F.col(text_col)).alias("tokens"),
    )
    rows = stored(spark, rows, "mixing-rows")
    sources = stored(
        spark,
        rows.groupBy("k").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).where("tokens > 0"),
        "mixing-sources",
    )
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    spend = total if budget is None else budget
    exponent = solve_exponent(spark, sources, spend, min_entropy, max_repeats)

    power = F.exp(exponent * F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    quota = F.floor(F.col("weight") * F.lit(float(spend)) + F.lit(1e-6))
    whole = F.floor(quota / F.col("tokens"))
    plan = stored(
        spark,
        sources.withColumn("weight", power / F.lit(norm)).select(
            "k",
            "weight",
            whole.alias("whole"),
            (quota - whole * F.col("tokens")).alias("rest"),
            F.ceil(F.col("docs") / range_rows).alias("ranges"),
        ),
        "mixing-plan",
    )

    def place(block: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block, "k", "id"), 11) * F.lit(2.0**-53)

    placed = rows.join(plan, "k")
    full = placed.where("whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    last = placed.withColumn("block", F.col("whole")).withColumn("place", place(F.col("block")))
    last = last.withColumn("range", F.floor(F.col("place") * F.col("ranges")))

    spent = F.sum("tokens").over(W.partitionBy("k").orderBy("range"))
    ranges = (
        last.groupBy("k", "range")
        .agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
        .withColumn("upto", spent)
        .where(F.col("upto") - F.col("tokens") <= F.col("rest"))
        .select(
            F.struct("k", "range").alias("kr"),
            (F.col("upto") - F.col("tokens")).alias("before"),
            (F.col("upto") <= F.col("rest")).alias("all"),
        )
    )
    near = last.withColumn("kr", F.struct("k", "range")).join(ranges, "kr")
    inside = W.partitionBy("k", "range").orderBy("place", "id", "tokens").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        near.where(~F.col("all"))
        .withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
        .where(F.col("upto") <= F.col("rest"))
    )
    out = [F.col("id").alias(id_col), F.col("k.source").alias("source"), "tokens", "weight", "block", "place"]
    return (
        full.withColumn("place", place(F.col("block"))).select(*out)
        .unionByName(near.where("all").select(*out))
        .unionByName(cut.select(*out))
    )
