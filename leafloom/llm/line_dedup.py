"""Line deduplication: drop lines that stand in many documents.

Lines are exploded, normalised and hashed; each hash counts its documents; lines over the threshold
go, and the others are put together again by position.

Data flow. Text is shuffled once, when a document meets the positions of its dropped lines; the count
and the search for hits shuffle 128-bit hashes only. A very common line is pre-aggregated before the
count's shuffle, and in the search it meets one row, in a join whose large partitions adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import SPACES, free_name, lower_ascii


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line with white space stripped at both ends and A-Z lower-cased."""
    return F.btrim(lower_ascii(line), F.lit(SPACES))


def _hash(key: Column) -> Column:
    """128 bits from two differently seeded 64-bit hashes: lines of one hash are taken as equal."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def drop_common_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Remove every line whose key has ``min_chars`` code points or more and stands in ``min_docs``
    documents or more. Adds ``ld_kept`` (the text that stays), ``ld_lines`` and ``ld_dropped`` (line
    counts) to the columns of ``docs``; columns of these names are replaced.

    Defined cases: a null or empty text is one empty line and stays; each row is a document of its
    own, also rows that share an id or have a null id; a line repeated inside a document counts once
    for it and goes or stays as a whole; an empty table gives an empty table.
    """
    # The row's identity. A struct compares null ids as equal, and equal rows have equal results.
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keys = F.transform(_lines(F.col(text_col)), line_key)
    least = max(min_chars, 1)

    common = (
        docs.select(
            F.explode(F.transform(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= least)), _hash)).alias("h")
        )
        .groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        # A key of another form: both sides of the join below are then dealt anew, and can be split.
        .select(F.struct("a", "b").alias("h"))
    )
    # The row's hash is taken below the explosion, once for a text and not for each of its lines.
    places = (
        docs.select(row.alias("row"), keys.alias("keys"))
        .select("row", F.posexplode("keys").alias("pos", "key"))
        .where(F.length("key") >= least)
        .select("row", "pos", _hash(F.col("key")).alias("h"))
    )
    hits = places.join(common, "h", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("gone"))
    own = docs.drop("ld_kept", "ld_lines", "ld_dropped")
    told, lost = free_name(own, "row"), free_name(own, "gone")
    met = own.withColumn(told, row).join(hits.withColumnsRenamed({"row": told, "gone": lost}), told, "left")
    # A column of its own that is read more than once: a text is split once, not for every line of it.
    parts = free_name(met, "parts")
    met = met.withColumn(parts, _lines(F.col(text_col)))
    # Equal rows share one row of hits, which holds each position once, however many they are.
    gone = F.coalesce(F.col(lost), F.array().cast("array<int>"))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    return met.withColumns(
        {
            "ld_kept": F.when(F.col(lost).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept),
            "ld_lines": F.size(parts).cast("long"),
            "ld_dropped": F.size(gone).cast("long"),
        }
    ).drop(told, lost, parts)
