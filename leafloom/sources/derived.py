"""Tables derived from the given ones by fixed rules: pages, revised pages, words, regions and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): each line of a document as a page, from 1; a null text is one empty page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def revised_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of the pages of each document: page_no % 7 = 3 is removed; of the others,
    page_no % 5 = 0 has its first word replaced, and page_no % 11 = 5 is followed by a page of its own.
    Made inside each document's row, so nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def versions(i: Column) -> Column:
        line = F.get("lines", i - 1)
        edited = F.when(i % 5 == 0, F.regexp_replace(line, r"^\S+", "alterada")).otherwise(line)
        own = F.format_string("pagina inserida %d %d", "doc_id", i)
        return F.when(i % 11 == 5, F.array(edited, own)).otherwise(F.array(edited))

    kept = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: i % 7 != 3)
    return docs.select("doc_id", F.posexplode(F.flatten(F.transform(kept, versions))).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def together(pages: DataFrame) -> DataFrame:
    """Pages, those of one number and document side by side in a task: texts are moved once, and what is made
    from them needs no more."""
    return pages.groupBy("doc_id", "page_no").agg(F.collect_list("text").alias("texts")).select("doc_id", "page_no", F.explode("texts").alias("text"))


def grid_place(idx: Column) -> list[Column]:
    """x, y, w, h of a page's token, on a grid of 12 a line in the unit square."""
    return [(idx % 12 / 12.0).alias("x"), (F.floor(idx / 12) / 60.0).alias("y"), F.lit(0.06).alias("w"), F.lit(0.012).alias("h")]


def words(pages: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page_no, idx, text, x, y, w, h): tokens on the grid, and ``more`` columns of their pages."""
    idx = pages.select("doc_id", "page_no", *more, F.posexplode(tokens(F.col("text"))).alias("idx", "text"))
    return idx.select("doc_id", "page_no", *more, "idx", "text", *grid_place(F.col("idx")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, x, y, w, h): one rectangle on page 1 of every tenth document, and one without
    width, to be ignored, in every fiftieth."""
    ids = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select("doc_id")
    good = ids.select("doc_id", F.lit(1).alias("page_no"), F.lit(0.05).alias("x"), F.lit(0.0).alias("y"), F.lit(0.4).alias("w"), F.lit(0.05).alias("h"))
    return good.unionByName(good.where("doc_id % 50 = 0").withColumn("w", F.lit(0.0)))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment notices from purchases: month below 20, else year; not approved where event_id % 9 = 0;
    every fourth is delivered twice, the second an hour later."""
    own = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("pay-"), "event_id").alias("payment_id"),
        "user_id",
        F.when(F.col("value") < 20, "month").otherwise("year").alias("period"),
        F.when(F.col("event_id") % 9 == 0, "rejected").otherwise("approved").alias("status"),
        F.when(F.col("value") < 20, F.lit("19.90")).otherwise(F.lit("199.00")).cast("decimal(10,2)").alias("amount"),
        F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(0), F.lit(3600))).otherwise(F.array(F.lit(0)))).alias("late"),
        "ts",
    )
    return own.withColumn("ts", F.col("ts") + F.make_interval(secs=F.col("late"))).drop("late")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) over the keys of ``part``, with cycles."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    last = part.agg(F.max("k").alias("last"))
    k = F.col("k")
    ways = F.array(F.when(k % 7 != 3, 2 * k + 1), F.when(k % 5 != 2, 2 * k + 2), F.when(k % 9 == 0, F.floor(k / 2)))
    return part.select(k.alias("src"), F.explode(ways).alias("dst")).join(F.broadcast(last)).where("dst <= last").select("src", "dst")
