"""Audit of how the sources of a language differ in their words: exact counts, exact integers.

1. Count vectors: each document becomes a sparse vector of its terms' counts. A vector is keyed by the
   terms themselves, so no vocabulary has to reach a driver or be broadcast before documents can be
   counted; every term counts, as with the largest vocabulary size that an integer can name.
2. Group sums: the vectors of a (lang, source) are summed and their documents counted, combined in each
   task before the shuffle. A language keeps the terms in at least ``min_df`` of its documents.
3. Pairs: terms that neither source has all give one value, and those of one source depend on its counts
   alone. So a pair's sum is made of a histogram of the counts of either source, of the terms that both
   have, and of a closed form for the rest; no table of all terms by all sources is made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import discard, stored

#: bytes.translate table: A-Z in lower case, a-z and bytes from 0x80 as they are, all others a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int64())
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            some = batch.slice(low, 256)
            counts = [Counter(terms_of(text)) for text in some.column("text").cast(pa.binary()).to_pylist()]
            offsets = [0]
            for c in counts:
                offsets.append(offsets[-1] + len(c))
            terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
            times = pa.array([n for c in counts for n in c.values()], pa.int64())
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [some.column("lang"), some.column("source"), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, times)],
                schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", strings), ("counts", numbers)]),
            )


def document_vectors(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counts) of each row of ``docs``: its distinct terms and how often each occurs.
    A null text, lang or source is an empty one."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(_vectors, "lang string, source string, terms array<string>, counts array<bigint>")


def group_sums(vectors: DataFrame, min_df: int = 3) -> DataFrame:
    """(lang, source, term, n, in_lang) of the terms in at least ``min_df`` documents of their language: the
    occurrences in the source and in all of the language."""
    cells = vectors.select("lang", "source", F.explode(F.arrays_zip("terms", "counts")).alias("cell")).select("lang", "source", "cell.terms", "cell.counts")
    sums = cells.groupBy("lang", "source", F.col("terms").alias("term")).agg(F.sum("counts").alias("n"), F.count(F.lit(1)).alias("df"))
    over = Window.partitionBy("lang", "term")  # a row for each source
    seen = sums.select("lang", "source", "term", "n", F.sum("df").over(over).alias("df"), F.sum("n").over(over).alias("in_lang"))
    return seen.where(F.col("df") >= min_df).drop("df")


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + size)), exact for any counts."""
    wide = lambda c: c.cast("decimal(28,0)")
    top = wide(n + 1) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), wide(total + size)) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): shares are 10^9 + 1 at most, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per occurring (lang, source), with or without terms: ``n`` occurrences and ``terms`` distinct
    kept terms of it, ``lang_n`` and ``size`` of its language, and ``none``, the share of a term that it lacks."""
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("size"))
    met = names.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "terms", "lang_n", "size"])
    return met.withColumn("none", F.when(F.col("size") > 0, share(F.lit(0), F.col("n"), F.col("size"))))


def pair_values(groups: DataFrame, valued: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum of ``excess`` over all kept terms."""
    own = groups.where("size > 0").select("lang", "source", "none", "terms", "size")
    other = own.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("terms").alias("item_terms"))
    pairs = own.join(other, "lang").where("source <> item")
    # Terms that neither has, as if no term were in both: what this counts too often is taken back below.
    rest = pairs.select("lang", "source", "item", ((F.col("size") - F.col("terms") - F.col("item_terms")) * excess(F.col("none"), F.col("item_none"))).alias("value"))
    counts = valued.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("times"))
    against = counts.join(other.drop("item_terms"), "lang").where("source <> item")
    one = against.select("lang", "source", "item", (F.col("times") * excess(F.col("p"), F.col("item_none"))).alias("value"))
    two = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * excess(F.col("item_none"), F.col("p"))).alias("value"))
    held = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("held")).where(F.size("held") > 1)  # as many as sources
    each = held.select("lang", F.explode("held").alias("a"), "held").select("lang", "a", F.explode("held").alias("b")).where("a.source <> b.source")
    p, p0, q, q0 = (F.col(c) for c in ("a.p", "a.none", "b.p", "b.none"))
    both = each.select("lang", "a.source", F.col("b.source").alias("item"), (excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)).alias("value"))
    summed = [part.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")) for part in (one, two, both)]
    every = rest.withColumn("value", F.col("value").cast("decimal(38,0)"))
    for part in summed:
        every = every.unionByName(part)
    total = every.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
    bare = groups.where("size = 0").select("lang", "source")
    nothing = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    return total.unionByName(nothing)


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")  # strings compare by their UTF-8 bytes
    return values.withColumn("rank", F.row_number().over(order))


def audit_sources(spark: SparkSession, docs: DataFrame, *, min_df: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term``
    the ``top`` terms that the source has more of than its language.

    A term's share in a group is 1 + floor(10^9 (count + 1) / (N + V)), N the occurrences of kept terms there and
    V the kept terms of the language. A pair's value is the sum of floor((p - q)^2 / q) over all kept terms, a
    term's that value against its language's share. Ranks count from 1 by falling value, then rising item.

    Defined cases: null text, lang or source are empty strings and groups of their own; a group without terms has
    pairs and no terms; in a language without kept terms each pair is 0; a language of one source has no pairs;
    repeated rows count each time; an empty table gives an empty table. Other columns aren't read.
    """
    kept = stored(spark, group_sums(document_vectors(docs), min_df), "divergence-kept")
    groups = stored(spark, groups_of(docs, kept), "divergence-groups")
    valued = kept.join(groups.select("lang", "source", F.col("n").alias("total"), "lang_n", "size", "none"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), "none", share(F.col("in_lang"), F.col("lang_n"), F.col("size")).alias("q")
    )
    terms = _ranked(valued.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)
    pairs = _ranked(pair_values(groups, valued))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    done = stored(spark, columns(pairs, "pair").unionByName(columns(terms, "term")), "divergence-done")
    discard(kept, groups)
    return done
