"""Tables of keyed rows that change in place: Parquet in a folder for each bucket of keys.

A change reads and replaces the buckets that its keys fall in, with Spark's dynamic overwrite of partitions;
the files of all other buckets stay as they are. A change that is applied twice leaves what one leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafloom.functions.lineage import cut
from leafloom.operators.ledger import insert_ignore, registry_upsert


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class KeyedTable:
    """The table at ``path``, which has to be a folder that all executors share: rows of ``schema``, at most one
    for each value of ``key`` (null isn't one), dealt to ``buckets`` by the key's hash. The number of buckets
    belongs to the table; choose it so that a bucket is a task's work."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        full = StructType([*self.schema, *StructType.fromDDL("bucket int")])
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return rows.select(*self.schema.names).withColumn("bucket", bucket)

    def _touched(self, dealt: DataFrame) -> list[int]:
        """The buckets of the rows: as many numbers as the table has buckets at most."""
        return sorted(r.bucket for r in dealt.select("bucket").distinct().collect())

    def _write(self, dealt: DataFrame, mode: str) -> None:
        dealt.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def insert_ignore(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Add the rows whose key isn't there, of several the first by ``order``. Buckets without a new key aren't
        written; held rows are never rewritten."""
        dealt = cut(self._dealt(rows.where(F.col(self.key).isNotNull())))
        held = self._stored().where(F.col("bucket").isin(self._touched(dealt))).select(self.key)
        none = self.spark.createDataFrame([], self.schema)
        new = insert_ignore(none, dealt.drop("bucket").join(held, self.key, "left_anti"), self.key, order)
        self._write(self._dealt(new), "append")

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the rows by ``merge`` (held rows, rows), which may not change a row's key."""
        dealt = cut(self._dealt(rows.where(F.col(self.key).isNotNull())))
        touched = self._touched(dealt)
        if touched:
            held = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
            self._write(self._dealt(merge(held, dealt.drop("bucket"))), "overwrite")

    def upsert(self, rows: DataFrame) -> None:
        """``registry_upsert`` in place: entries (key, ord, built_in, ..) replace those of their key and go to the
        end of the whole table, in their order; built-in ones aren't stored."""
        last = cut(self._stored().agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last")))
        self.change(rows.where("NOT built_in"), lambda held, new: registry_upsert(held, new, self.key, last=last))


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends each batch to the table at ``path`` in a folder of its number. A batch
    that is fed again, as after a failure, changes no file once its folder is there; the folder comes whole,
    by the writer's commit."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not path_exists(batch.sparkSession, f"{path}/batch_id={batch_id}"):
            named = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return run
