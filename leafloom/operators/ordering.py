"""Order: concatenating, page offsets, tables of contents, outlines, packing under budgets.

Numbers and sums over all files of a source are taken by ranges: one source may hold most of the files, and
no window holds more than a range of them. Packing is sequential by nature: it is a fold over each key's
items in order, keys in parallel, in Python on sorted batches with constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.functions.lineage import cut

#: Entries on a page of contents.
TOC_ROWS = 27


def append_ordered(sources: list[DataFrame]) -> DataFrame:
    """Sources (doc_id, page_no, text) one after the other, with ``src_ord`` and the page's number in
    its source's order (``src_page``, by doc_id and page_no). Pages are counted by document, counts
    are summed up over ranges of documents, and a page adds its own number in its document: no source
    is sorted as a whole, and a text moves once, to the pages of its document."""
    out = None
    for k, s in enumerate(sources):
        own = s.withColumn("src_ord", F.lit(k))
        out = own if out is None else out.unionByName(own)
    before = running_sum(out.groupBy("src_ord", "doc_id").agg(F.count(F.lit(1)).alias("n")), ["src_ord"], "doc_id", "n")
    inside = F.row_number().over(W.partitionBy("src_ord", "doc_id").orderBy("page_no"))
    place = F.struct("src_ord", "doc_id")  # a document without an id is one like others
    rows = out.withColumns({"inside": inside, "place": place}).join(before.select(place.alias("place"), "before"), "place")
    return rows.select(*sources[0].columns, "src_ord", (F.col("before") + F.col("inside")).cast("int").alias("src_page"))


def _ranges(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` dealt by ranges of (keys, order), with the number of each row's ``range``."""
    return cut(rows.repartitionByRange(*keys, order).withColumn("range", F.spark_partition_id()))


def _with_ends(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to what is known of their range and keys; null keys are keys like others."""
    span = F.struct("range", *keys)
    return rows.withColumn("span", span).join(ends.withColumn("span", span).drop("range", *keys), "span").drop("span")


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same keys that come earlier in
    ``order`` (unique by key). Rows are dealt by ranges of (keys, order); a sum a range and key is all that
    meets in one window, as many rows as there are ranges and keys. Rows of a null key belong together."""
    rows = _ranges(rows, keys, order)
    part = W.partitionBy("range", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("range", *keys).agg(F.sum(value).alias("sum"))
    upto = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("sum").over(upto), F.lit(0))).drop("sum")
    own = _with_ends(rows, earlier, keys).withColumn("before", F.coalesce(F.sum(value).over(part), F.lit(0)) + F.col("earlier"))
    return own.drop("range", "earlier")


def page_offsets(files: DataFrame) -> DataFrame:
    """Files (source, doc_id, pages, title, category) with ``first_page``: pages before it in its source,
    by doc_id."""
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"(?i)\.(txt|pdf)$", "")), F.lit("")), F.format_string("Document %d", F.col("doc_id")))
    own = files.select("source", "doc_id", title.alias("title"), F.nullif(F.trim("category"), F.lit("")).alias("category"), "pages")
    return running_sum(own, ["source"], "doc_id", "pages").select("source", "doc_id", "title", "category", F.col("before").alias("first_page"), "pages")


def table_of_contents(specs: DataFrame, rows: int = TOC_ROWS) -> DataFrame:
    """Entries of each source's contents: on which contents page, in which row, and the page shown
    (contents pages come first). Entries whose first page isn't one of the source's pages (the sum of
    ``pages``) are left out and take no row."""
    totals = specs.groupBy(F.struct("source").alias("key")).agg(F.sum("pages").alias("total"))
    inside = (F.col("first_page") >= 0) & (F.col("first_page") < F.col("total"))
    specs = specs.withColumn("key", F.struct("source")).join(totals, "key").where(inside).drop("key", "total")
    own = specs.select(F.struct("source").alias("key"), "source", "doc_id", "title", "first_page", F.struct("first_page", "doc_id").alias("place"), F.lit(1).alias("one"))
    pages = specs.groupBy(F.struct("source").alias("key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("toc_pages"))
    n = F.col("before").cast("int")
    return running_sum(own, ["source"], "place", "one").join(pages, "key").select(
        "source", "doc_id", "title", (F.floor(n / rows) + 1).alias("toc_page"), (n % rows + 1).alias("row"), (F.col("toc_pages") + F.col("first_page") + 1).alias("shown_page")
    )


def outline_tree(specs: DataFrame) -> DataFrame:
    """Two-level outline of each source: a category stands where its first member does, members under
    it in order; specs without a category, and root ones, stay on top. ``prev`` and ``next`` are the
    neighbours on the same level, ``children`` the members of a category. Levels are walked by ranges, and
    a range's first and last node are neighbours of those beside it."""
    top = F.coalesce("root", F.lit(False)) | F.col("category").isNull()
    own = specs.withColumn("top", top)
    cats = own.where(~F.col("top")).groupBy("source", "category").agg(F.min("first_page").alias("at"), F.min("doc_id").alias("tie"), F.count(F.lit(1)).alias("children"))
    cat_nodes = cats.select("source", F.concat(F.lit("c:"), "category").alias("node"), F.lit(None).cast("string").alias("parent"), "at", "tie", F.lit(0).alias("kind"), "children")
    doc_nodes = own.select(
        "source", F.concat(F.lit("d:"), "doc_id").alias("node"), F.when(~F.col("top"), F.concat(F.lit("c:"), "category")).alias("parent"), F.col("first_page").alias("at"), F.col("doc_id").alias("tie"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("children")
    )
    level = ["source", "parent"]
    nodes = cat_nodes.unionByName(doc_nodes).select(*level, "node", F.struct("at", "tie", "kind").alias("place"), "children")
    nodes = _ranges(nodes, level, "place")
    ends = nodes.groupBy("range", *level).agg(F.count(F.lit(1)).alias("n"), F.min_by("node", "place").alias("first"), F.max_by("node", "place").alias("last"))
    beside = W.partitionBy(*level).orderBy("range")
    earlier = F.coalesce(F.sum("n").over(beside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("range", *level, earlier.alias("earlier"), F.lag("last").over(beside).alias("left"), F.lead("first").over(beside).alias("right"))
    inside = W.partitionBy("range", *level).orderBy("place")
    number = (F.col("earlier") + F.row_number().over(inside)).cast("int")
    return _with_ends(nodes, ends, level).select(
        "source", "node", "parent", number.alias("ord"), F.coalesce(F.lag("node").over(inside), "left").alias("prev"), F.coalesce(F.lead("node").over(inside), "right").alias("next"), "children"
    )


def _pack_rows(key: str, max_items: int, max_size: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, group, items, size = False, None, 0, 0, 0  # a key may go on in the next batch
        for part in parts:
            groups = []
            for k, s in zip(part[key].astype(object).where(part[key].notna(), None), part["size"]):
                if not begun or k != now:
                    begun, now, group, items, size = True, k, 1, 0, 0
                elif items >= max_items or size + s > max_size:
                    group, items, size = group + 1, 0, 0
                items, size = items + 1, size + s
                groups.append(group)
            yield part.assign(grp=groups)

    return run


def pack_sequential(items: DataFrame, key: str, order: list[str], max_items: int, max_size: int) -> DataFrame:
    """Next-fit: each key's items (``size``) in order into groups (``grp`` from 1); a new group starts
    when the open one is full or would go over ``max_size``, and an item over it stands alone. Items without a
    key belong together; an item without a size has none."""
    items = items.withColumn("size", F.coalesce("size", F.lit(0).cast(items.schema["size"].dataType)))
    own = items.repartition(F.col(key)).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + ", grp int"
    return own.mapInPandas(_pack_rows(key, max_items, max_size), schema)


def split_by_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Parts of each document: the longest runs of pages (``size``) within the budget; a page over it is
    a part of its own, and no page is lost. Pages are walked in order, with the open part in memory."""
    packed = pack_sequential(pages.select("doc_id", "page_no", F.col("size").cast("long").alias("size")), "doc_id", ["page_no"], 2**62, budget)
    return packed.groupBy("doc_id", F.col("grp").alias("part")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.sum("size").alias("bytes"))


def run_totals(files: DataFrame, massive_files: int = 100, massive_bytes: int = 128 * 2**20, direct_files: int = 48, direct_bytes: int = 96 * 2**20) -> DataFrame:
    """By source: files, bytes, and how a run over them is done."""
    own = files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    mode = F.when((F.col("files") >= massive_files) | (F.col("bytes") >= massive_bytes), "massive").when((F.col("files") <= direct_files) & (F.col("bytes") <= direct_bytes), "direct").otherwise("batched")
    return own.withColumn("mode", mode)
