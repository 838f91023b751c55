"""Exact deduplication with a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct text with the id that is
kept and the number of copies. New data is reduced to one row per digest (copies are combined before
the shuffle, so a hot group never meets in one task), anti-joined by sort-merge with the index
bucket by bucket, and what is new is appended. Texts never leave the scan; only digests move.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, drop_rows, free_name, lower_ascii, remove, row_key, shared_dir, stored

#: Digests of a bucket: what one task sorts when it writes the index.
BUCKET_ROWS = 4_000_000


def buckets_for(texts: int, least: int = 64) -> int:
    """A power of two of buckets with ``BUCKET_ROWS`` digests each at most, for an index of so many texts."""
    buckets = least
    while buckets * BUCKET_ROWS < texts:
        buckets *= 2
    return buckets


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; a null text counts as an empty one."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """The index as a catalogue table, in ``buckets`` buckets (``buckets_for`` the texts it shall hold).
    ``path`` puts its files at a place of the caller's choice, where a later session can open them again
    by the same arguments; it has to be one that all executors share. Without it they lie under the shared
    folder and go with ``drop``, which takes the index out of the catalogue."""

    COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, table: str | None = None, *, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.own = None if path else f"{shared_dir(spark).rstrip('/')}/{self.table}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path or self.own}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(digest, id) of each row."""
        return docs.select(text_digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("id"))

    def candidates(self, digests: DataFrame) -> DataFrame:
        """One row per distinct digest; of equal texts the largest id is kept."""
        return digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Append the texts of ``docs`` that the index doesn't hold. Texts it holds keep their row:
        what an earlier batch kept stays kept.

        An empty table adds nothing. Null ids are allowed: such a row is kept only where no copy has
        an id, and ``keep_id`` is then null.
        """
        self.add_digests(self.digests(docs, id_col, text_col))

    def add_digests(self, digests: DataFrame) -> None:
        """``add`` for rows of which (digest, id) are known."""
        new = self.candidates(digests).join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # A bucket goes to one task as a whole, so it is one file: dealt by digest into more parts than
        # buckets, each part would write a file for nearly every bucket.
        (
            new.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
            .sortWithinPartitions("digest")
            .write.insertInto(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.own:
            remove(self.spark, self.own)


def mark_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``xd_digest`` (binary), ``xd_keep_id``, ``xd_size`` and ``xd_kept``,
    from an index that holds these texts; other columns stay, columns of these names are replaced.

    The join's key is wrapped so that both sides are shuffled for it and adaptive execution can split
    a hot digest. ``xd_size`` counts the copies in the batch that brought the text into the index.

    Rows that repeat an id with the same text share one answer, so each of them is marked kept:
    a row can't be told from its repetition. A row without an id is kept only if its whole group has none.
    """
    own = docs.drop("xd_digest", "xd_keep_id", "xd_size", "xd_kept").withColumn("xd_digest", text_digest(F.col(text_col)))
    k, keep, size = (free_name(own, x) for x in ("k", "keep", "size"))
    groups = index.rows().select(F.struct("digest").alias(k), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    met = own.withColumn(k, F.struct(F.col("xd_digest").alias("digest"))).join(groups, k, "left")
    return met.withColumns(
        {"xd_keep_id": F.col(keep), "xd_size": F.col(size), "xd_kept": F.col(keep).eqNullSafe(F.col(id_col).cast("long"))}
    ).drop(k, keep, size)


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of equal texts the one with the largest id.

    Builds an index for the batch, marks the copies by ids and digests only, and takes them out; texts
    are shuffled for rows that may be copies, and the others stay where they are.

    Defined cases: as for ``mark_copies``; repetitions of a kept row (same id, same text) are reduced to
    one; columns of any name stay as they are; an empty table gives an empty table.
    """
    rows = docs.select(row_key(id_col, text_col).alias("row"), text_digest(F.col(text_col)).alias("digest"))
    rows = stored(spark, rows, "exact-rows")
    index = DigestIndex(spark, buckets=buckets_for(rows.count()))
    try:
        index.add_digests(rows.select("digest", F.col("row.id").alias("id")))
        groups = index.rows().where("group_size > 1").select(F.struct("digest").alias("k"), "keep_id")
        met = rows.withColumn("k", F.struct("digest")).join(groups, "k").withColumn("kept", F.col("row.id").eqNullSafe(F.col("keep_id")))
        # Texts that differ in case only are copies of each other: of those with the kept id, one hash stays.
        best = met.where("kept").groupBy("k").agg(F.max("row.text").alias("text"), F.count(F.lit(1)).alias("n"))
        told = met.join(best, "k").select("row", (F.col("kept") & (F.col("row.text") == F.col("text"))).alias("stays"), "n")
        told = stored(spark, told.groupBy("row", "stays").agg(F.max("n").alias("n")), "exact-told")
    finally:
        index.drop()
        discard(rows)
    gone, once = told.where("NOT stays").select("row"), told.where("stays AND n > 1").select("row")
    return drop_rows(docs, row_key(id_col, text_col), gone, once=once)
