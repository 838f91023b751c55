"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts count it, and the same for Java regular expressions.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: bytes.translate table that lower-cases A-Z and leaves every other byte of UTF-8 alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are (``lower`` would fold Unicode too)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Values of a batch that are Python objects at a time.
PIECE_ROWS = 256


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column as Python objects, made ``PIECE_ROWS`` at a time: a worker never holds
    the texts of a whole batch beside the batch itself."""
    for at in range(0, len(column), PIECE_ROWS):
        yield from column.slice(at, PIECE_ROWS).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the session's
    ``setCheckpointDir`` was given. A local session that names none gets a temporary one for its life;
    on a cluster that is an error, since executors would not see each other's files."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Where ``stored`` has put the tables that are still in use.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: it cuts the lineage, so that
    a lost executor costs no more than the tasks that read from it. The files stay as long as a result
    may read them; ``discard`` removes those of steps that nothing reads any more."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stored`` has returned."""
    for t in tables:
        path = _PLACES.pop(t, None)
        if path:
            remove(t.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores in front, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the prefilter for each key, its bounds, and bits in a row of it (4 KiB, the size that
#: ``bitmap_construct_agg`` gives): at most 32 MiB are broadcast, whatever the input.
BITS_A_KEY, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 2**18, 2**28, 32_768


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's identity: its id and a hash of its text. As a struct it compares null ids as equal."""
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"))


def filter_bits(keys: int) -> int | None:
    """How many bits the prefilter of so many keys has; None where they need more than is broadcast."""
    bits = LEAST_BITS
    while bits < BITS_A_KEY * keys:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def split_rows(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``docs`` whose key may be in ``keys``, those whose key surely isn't), without a shuffle:
    a key's hash names a bit, and the bits of ``keys`` (column ``row``; stored, read twice) are broadcast
    as a bitmap of a size that follows their number. Of the other keys one in sixteen shares a bit at
    most. Where there are too many keys for that, all rows may match, and the second is None."""
    bits = filter_bits(keys.count())
    if bits is None:
        return docs, None
    row, bit, held = (free_name(docs, x) for x in ("bit_row", "bit", "bit_map"))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    maps = keys.select(place(F.col("row")).alias(bit)).groupBy(F.floor(F.col(bit) / ROW_BITS).alias(row)).agg(F.bitmap_construct_agg(F.col(bit) % ROW_BITS).alias(held))
    met = docs.withColumn(bit, place(key)).withColumn(row, F.floor(F.col(bit) / ROW_BITS)).join(F.broadcast(maps), row, "left")
    at = F.col(bit) % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return met.where(there).select(*docs.columns), met.where(~there).select(*docs.columns)


def take_rows(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``docs`` joined with ``keys`` (column ``row`` and others). Rows that can't match are dropped
    before the shuffle."""
    return split_rows(docs, key, keys)[0].withColumn("row", key).join(keys, "row")


def drop_rows(docs: DataFrame, key: Column, gone: DataFrame, *, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (column ``row``), and with one of the rows that
    share a key of ``once``. Only rows that may have such a key are shuffled; both are stored tables."""
    row, kind = free_name(docs, "row"), free_name(docs, "kind")
    told = gone.select(F.col("row").alias(row), F.lit(False).alias(kind))
    if once is not None:
        told = told.unionByName(once.select(F.col("row").alias(row), F.lit(True).alias(kind)))
    near, rest = split_rows(docs, key, told.select(F.col(row).alias("row")))
    met = near.withColumn(row, key).join(told, row, "left")
    left = met.where(F.col(kind).isNull()).select(*docs.columns)
    if once is not None:
        left = left.unionByName(met.where(kind).dropDuplicates([row]).select(*docs.columns))
    return left if rest is None else rest.unionByName(left)
