"""Operators over pages of text: cleaning, checks, numbering, wrapping, redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.functions.batches import extent, in_lines, numbers, starts, values
from leafloom.functions.lineage import cut
from leafloom.functions.markup import Cleaner
from leafloom.functions.text import SPACE, is_letter_spaced, latin1_fold, normalize, plain_marks, tokens

#: Separator of pages in a whole text; characters that make OCR needless; ink ratios of blank pages.
PAGE_SEPARATOR, OCR_CHARS = "\n\n--- PAGE ---\n\n", 24
BLANK_INK = {"low": 0.00045, "medium": 0.00135, "high": 0.0032}


def normalize_pages(pages: DataFrame, nfkc: bool = False) -> DataFrame:
    return pages.withColumn("text", normalize(F.col("text"), nfkc))


def tokenize_pages(pages: DataFrame) -> DataFrame:
    """``word_count`` and the tokens, parted by one space."""
    own = tokens(normalize(F.col("text")))
    return pages.select("doc_id", "page_no", F.size(own).cast("long").alias("word_count"), F.array_join(own, " ").alias("tokens"))


def sanitize_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, tags, attributes, links, clean): pages without elements and attributes that aren't on the lists of
    ``functions.markup`` (active ones never are), without links of other schemes, comments and declarations, and
    how many start tags, attributes and links went. What forms and unknown elements hold stays as content; of
    scripts, frames, vector graphics and templates nothing stays. A null page stays null, with zeros."""
    own = pages.select(id_col, html_col)
    schema = own.schema[id_col].dataType.simpleString()
    return own.mapInArrow(_sanitize, f"`{id_col}` {schema}, tags bigint, attributes bigint, links bigint, clean string")


def _sanitize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cleaner = Cleaner()
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            some, rows = batch.slice(low, 256), []
            for html in some.column(1).to_pylist():
                clean = None if html is None else cleaner.clean(html)
                rows.append((0, 0, 0, None) if html is None else (cleaner.tags, cleaner.attributes, cleaner.links, clean))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([some.column(0), *cols], [batch.schema.names[0], "tags", "attributes", "links", "clean"])


def pages_needing_ocr(pages: DataFrame, min_chars: int = OCR_CHARS) -> DataFrame:
    """By document, how many pages hold too little text (``to_recognise``), and how many don't; a page
    without a text (null) holds too little."""
    little = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) < min_chars
    return pages.groupBy("doc_id").agg(F.count_if(little).alias("to_recognise"), F.count_if(~little).alias("skipped"))


def remove_blank_pages(pages: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Pages without text and with an ``ink`` ratio under the threshold go, and the rest is numbered
    anew (``new_no``). A document with nothing but blank pages keeps them all, marked as an error. A null
    text is an empty one, and a page whose ink wasn't measured (null or NaN) has none."""
    ink = F.nanvl(F.coalesce(F.col("ink").cast("double"), F.lit(0.0)), F.lit(0.0))
    blank = (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0) & (ink < BLANK_INK[sensitivity])
    doc = W.partitionBy("doc_id")
    marked = pages.withColumn("blank", blank).withColumn("error", F.min(F.col("blank").cast("int")).over(doc) == 1)
    kept = marked.where("error OR NOT blank")
    return kept.withColumn("new_no", F.row_number().over(doc.orderBy("page_no"))).drop("blank")


def scrub_metadata(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``meta`` without all keys but those to keep; everything else as it was."""
    return docs.withColumn("meta", F.map_filter("meta", lambda k, _: k.isin(list(keep)) if keep else F.lit(False)))


def apply_page_plan(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each plan item (doc_id, ord, source_index from 0, rotation) in its order: repeats are
    allowed, items without a page are dropped; rotation adds to the page's, modulo 360."""
    rows = plan.join(pages.withColumnRenamed("rotation", "own"), (plan.doc_id == pages.doc_id) & (plan.source_index + 1 == pages.page_no)).drop(pages.doc_id)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))
    return rows.select("doc_id", number.alias("page_no"), F.col("source_index"), F.pmod(F.col("own") + F.col("rotation"), F.lit(360)).alias("rotation"), "text")


def sentence_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, par_no, text): texts parted after a full stop, exclamation or question mark and white
    space; an empty text is one empty paragraph."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.posexplode(F.split(text, r"(?<=[.!?])\s+", -1)).alias("ord", "text")).select("doc_id", (F.col("ord") + 1).alias("par_no"), "text")


def _fill(words: list[str], width: int) -> Iterator[str]:
    line = ""
    for w in words:
        if line and len(line) + 1 + len(w) > width:
            yield line
            line = w
        else:
            line = f"{line} {w}" if line else w
    yield line


def wrap_chunks(docs: DataFrame, width: int = 94) -> DataFrame:
    """(doc_id, line_no, line): words filled greedily into lines of ``width`` characters; a longer word
    stands alone, and an empty text is one empty line. Each text is walked once, line by line, so the
    cost is in proportion to it; only the open line is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, lines = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, line in enumerate(_fill(re.split(r"[ \t\n\x0b\f\r]+", (text or "").strip(" \t\n\x0b\f\r")) if text else [], width), 1):
                    ids.append(i)
                    numbers.append(n)
                    lines.append(line)
                if len(lines) >= 100_000:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], ["doc_id", "line_no", "line"])
                    ids, numbers, lines = [], [], []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], ["doc_id", "line_no", "line"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, line_no int, line string")


def latin1_report(docs: DataFrame) -> DataFrame:
    """Texts in the three reduced character sets, and by row whether any of them changed it."""
    modes = ("mark", "drop", "ascii")
    own = docs.select("doc_id", "text", plain_marks(F.col("text")).alias("plain"))
    own = own.select("doc_id", "text", *(latin1_fold(F.col("text"), m, F.col("plain")).alias(m) for m in modes))
    return own.select("doc_id", *(F.md5(m).alias(f"{m}_md5") for m in modes), *((F.col(m) != F.col("text")).alias(f"{m}_changed") for m in modes))


def document_text(pages: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """One text by document: its pages in order, joined by the separator."""
    own = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), separator).alias("text"))


def write_document_text(pages: DataFrame, path: str, separator: str = PAGE_SEPARATOR, *, per_file: int = 1) -> None:
    """A text file for each document under ``path`` (``doc_id=...`` folders), or, with ``per_file`` over 1,
    that many documents in a compressed Parquet file: very many small files are no way to keep a corpus.
    What the folder holds is replaced."""
    texts = document_text(pages, separator)
    if per_file == 1:
        texts.write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)
    else:
        texts.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", "zstd").parquet(path)


def page_labels(pages: DataFrame, start: int = 1, prefix: str = "p. ") -> DataFrame:
    """``label`` (prefix and number, from ``start``) and ``long_label`` ("n of last")."""
    first = max(1, start)
    doc = W.partitionBy("doc_id")
    number = F.row_number().over(doc.orderBy("page_no")) + (first - 1)
    last = F.count(F.lit(1)).over(doc) + (first - 1)
    return pages.select("doc_id", "page_no", F.concat(F.lit(prefix), number).alias("label"), F.concat(number, F.lit(" of "), last).alias("long_label"))


def valid_regions(regions: DataFrame) -> DataFrame:
    """Regions clamped to the unit square; those without width, height or numbers are left out."""
    edge = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    own = regions.where("w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x + y + w + h)")
    size = lambda c, d: F.least(F.col(d), F.lit(1.0) - edge(c))
    return own.select("doc_id", "page_no", edge("x").alias("x"), edge("y").alias("y"), size("x", "w").alias("w"), size("y", "h").alias("h")).where("w > 0 AND h > 0")


#: Cells of a page along each side, for finding what lies near a word; regions of a page that are tried one by one.
GRID, CROWD = 32, 64


def _cells(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The cells (column * GRID + row) that a box touches, as far as it lies on the page; none without numbers."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(v * GRID))).cast("int")
    across = F.sequence(at(F.least(x, x + w)), at(F.greatest(x, x + w)), F.lit(1))
    down = F.sequence(at(F.least(y, y + h)), at(F.greatest(y, y + h)), F.lit(1))
    cells = F.flatten(F.transform(across, lambda i: F.transform(down, lambda j: i * GRID + j)))
    total = (x + y + w + h).cast("double")
    return F.when(~F.isnan(total), cells)


def with_regions(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """``pages`` with the array ``regions`` of each page's valid regions (none: null); of a crowded page, the first
    CROWD and one. Words that are then made from a page bring them along: only pages are moved, not words."""
    kind = F.struct("x", "y", "w", "h")
    page = W.partitionBy("doc_id", "page_no").orderBy("x", "y", "w", "h")
    some = valid_regions(regions).distinct().withColumn("n", F.row_number().over(page)).where(F.col("n") <= CROWD + 1)
    lists = some.groupBy(F.struct("doc_id", "page_no").alias("place")).agg(F.collect_list(kind).alias("regions"))
    own = pages.withColumn("place", F.struct("doc_id", "page_no"))
    return own.join(lists, "place", "left").drop("place")


def region_redaction(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words (doc_id, page_no, idx, x, y, w, h, ..) with ``hit``: whether their box meets a valid region of
    their page. Words may bring the column ``regions`` of ``with_regions``, and are then not moved at all; others
    are joined with it once. On crowded pages, words and regions are dealt to the cells of a grid over the page, so a
    word is held against the regions in its own cells only. A word without numbers isn't hit, nor one without a document."""
    own = words if "regions" in words.columns else with_regions(words, regions)
    known = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & ~F.isnan((F.col("x") + F.col("y") + F.col("w") + F.col("h")).cast("double"))
    met = F.exists("regions", lambda r: _meet(F.col, r.getField))
    quick = lambda w: w.withColumn("hit", F.coalesce(known & met, F.lit(False))).drop("regions")
    crowded = cut(valid_regions(regions).distinct().groupBy("doc_id", "page_no").count().where(F.col("count") > CROWD).select("doc_id", "page_no"))
    if crowded.isEmpty():
        return quick(own)
    many = F.coalesce(F.size("regions") > CROWD, F.lit(False))
    return quick(own.where(~many)).unionByName(_grid_redaction(own.where(many).drop("regions"), regions.join(crowded, ["doc_id", "page_no"], "left_semi")))


def _meet(k, r) -> Column:
    """Whether two boxes, given by their fields, overlap."""
    across = (k("x") < r("x") + r("w")) & (k("x") + k("w") > r("x"))
    return across & (k("y") < r("y") + r("h")) & (k("y") + k("h") > r("y"))


def _grid_redaction(words: DataFrame, regions: DataFrame) -> DataFrame:
    """``region_redaction`` by the cells of a grid, for crowded pages."""
    boxed = valid_regions(regions).select("doc_id", "page_no", F.struct("x", "y", "w", "h").alias("r"))
    near = boxed.select(F.explode(_cells(F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h"))).alias("cell"), "doc_id", "page_no", "r").distinct()
    key = F.struct("doc_id", "page_no", "idx", "x", "y", "w", "h")
    dealt = words.select(key.alias("k"), F.explode(_cells(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("cell"))
    place = F.struct(F.col("k.doc_id").alias("doc_id"), F.col("k.page_no").alias("page_no"), "cell")
    met = dealt.withColumn("place", place).join(near.select(F.struct("doc_id", "page_no", "cell").alias("place"), "r"), "place")
    hits = met.where(_meet(F.col("k").getField, F.col("r").getField)).select("k").distinct().withColumn("hit", F.lit(True))
    return words.withColumn("k", key).join(hits, "k", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("k")


def redact_pages(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages with a valid region lose all their text; the others stay byte for byte. ``redactions`` is
    the number of regions of the page. ``error`` marks the pages of documents without any valid region on one
    of their pages: nothing was redacted there, which the caller surely didn't mean."""
    marked = valid_regions(regions).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("redactions"))
    own = pages.join(marked, ["doc_id", "page_no"], "left").withColumn("redactions", F.coalesce("redactions", F.lit(0)))
    none = F.max("redactions").over(W.partitionBy("doc_id")) == 0
    return own.withColumn("error", F.when(none, "no region")).withColumn("text", F.when(F.col("redactions") > 0, "").otherwise(F.col("text")))


def leak_check(before: DataFrame, after: DataFrame, regions: DataFrame, secret: str | None = None) -> DataFrame:
    """By document with regions: pages before and after, characters left on redacted pages, places of
    the secret on them, and ``ok``: nothing is left and no page was lost."""
    marked = valid_regions(regions).select("doc_id", "page_no").distinct()
    total = lambda p, name: p.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    left = after.join(marked, ["doc_id", "page_no"], "left_semi").groupBy("doc_id").agg(
        F.sum(F.length(F.trim("text"))).alias("left_chars"), F.count_if(F.contains("text", F.lit(secret or "\0"))).alias("secrets")
    )
    both = marked.select("doc_id").distinct().join(total(before, "pages_before"), "doc_id", "left").join(total(after, "pages_after"), "doc_id", "left").join(left, "doc_id", "left")
    both = both.na.fill(0, ["left_chars", "secrets", "pages_before", "pages_after"])
    return both.withColumn("ok", (F.col("left_chars") == 0) & (F.col("secrets") == 0) & (F.col("pages_before") == F.col("pages_after")))


def assemble_lines(words: DataFrame, line_height: float = 0.0083, low: float = -0.2, high: float = 1.6, by_page: bool = False) -> DataFrame:
    """Words joined into runs: words of one line (baselines that round to the same step) in order of x,
    a new run where the gap to the furthest right edge so far is outside ``low`` to ``high`` heights.
    ``by_page``: the words of a page already stand together in a task; else they are dealt by line."""
    number = lambda c: F.col(c).cast("double").alias(c)
    own = words.select("doc_id", "page_no", F.round(F.col("y") / line_height).alias("line"), number("x"), "idx", number("w"), number("h"), "text")
    if not by_page:
        own = own.repartition("doc_id", "page_no", "line").sortWithinPartitions("doc_id", "page_no")
    types = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lines in in_lines(batches):
            x, w, h = (numbers(rows.column(k)) for k in "xwh")
            with np.errstate(invalid="ignore"):
                right, none = x[0] + w[0], x[1] | w[1]
            line = np.zeros(len(right), dtype=np.int64)
            line[lines] = 1
            line = np.cumsum(line)
            # The furthest edge before a word, by ranks: that of a line starts above all of the line before.
            order = np.argsort(np.where(none, -np.inf, right), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            far = order[np.maximum.accumulate(rank + line * len(order)) % len(order)][:-1]
            with np.errstate(invalid="ignore"):
                gap = x[0][1:] - right[far]
                near = (gap > h[0][1:] * low) & (gap < h[0][1:] * high) & ~none[far] & ~x[1][1:] & ~h[1][1:]
            new = np.concatenate([[True], ~near])
            new[lines] = True
            first = np.flatnonzero(new)
            head = rows.take(pa.array(first))
            number = np.arange(len(first)) - np.searchsorted(first, lines)[line[first] - 1] + 1
            texts, some = values(rows.column("text")), rows.column("text").null_count
            texts = [" ".join([t for t in texts[i:j] if t is not None] if some else texts[i:j]) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(texts)])]
            edges = [extent(*x, first, True), extent(right, none, first, False), extent(*h, first, False)]
            yield pa.RecordBatch.from_arrays([*head.columns[:3], pa.array(number), pa.array(texts, pa.string()), *edges], ["doc_id", "page_no", "line", "run", "text", "x0", "x1", "h"])

    return own.mapInArrow(run, f"doc_id {types['doc_id']}, page_no {types['page_no']}, line double, run bigint, text string, x0 double, x1 double, h double")


def merge_runs(items: DataFrame, line_height: float, by_page: bool = False) -> DataFrame:
    """Items (doc_id, page_no, idx, text, x, baseline, width, font, size) of one line joined to runs: those
    whose baselines round to the same step are taken in order of x, and an item goes to the open run if it has
    the run's font, a size within 0.5 of that of the run's first item, its baseline, and a gap from the right
    edge of the item before it between -0.3 and 0.9 sizes. A gap over 0.12 sizes becomes a space unless one is
    there. Letter-spaced items lose their spaces. Items without a text, place or size are left out.

    ``by_page``: the items of a page already stand together in a task; else they are dealt by line. The items of the
    open page are held. Gives (doc_id, page_no, line, run, items, text, x, width, baseline, font, size)."""
    text = F.when(is_letter_spaced(F.col("text")), F.replace("text", F.lit(" "))).otherwise(F.col("text"))
    number = lambda c: F.col(c).cast("double").alias(c)
    own = items.where("text IS NOT NULL").select("doc_id", "page_no", F.round(F.col("baseline") / line_height).alias("line"), number("x"), "idx", text.alias("text"), number("baseline"), number("width"), "font", number("size"))
    total = F.col("x") + F.col("baseline") + F.col("width") + F.col("size")
    own = own.where(total.isNotNull() & ~F.isnan(total))
    if not by_page:
        own = own.repartition("doc_id", "page_no", "line").sortWithinPartitions("doc_id", "page_no")
    types = dict(own.dtypes)
    ddl = f"doc_id {types['doc_id']}, page_no {types['page_no']}, line double, run int, items int, text string, x double, width double, baseline double, font {types['font']}, size double"
    return own.mapInArrow(_merge_runs, ddl)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, lines in in_lines(batches):
        x, base, width, size = (rows.column(k).to_numpy() for k in ("x", "baseline", "width", "size"))
        right, new_line = x + width, np.zeros(len(x), dtype=bool)
        new_line[lines] = True
        gap = x - np.concatenate([[np.nan], right[:-1]])
        font = np.zeros(len(x), dtype=bool)
        font[starts([rows.column("font")])] = True  # a run has one font, so that of the item before is the run's
        near = ~new_line & ~font & (-0.3 * size < gap) & (gap < 0.9 * size)
        firsts, runs, texts, parts, run = [], [], [], [], 0
        for i, (starts_line, may, wide, s, at, text) in enumerate(zip(new_line.tolist(), near.tolist(), (gap > 0.12 * size).tolist(), size.tolist(), base.tolist(), values(rows.column("text")))):
            if may and abs(own_size - s) < 0.5 and abs(own_base - at) < 0.35 * s:
                if wide and not parts[-1].endswith(" ") and not text.startswith(" "):
                    parts += (" ", text)
                elif text:
                    parts.append(text)
                continue
            if parts:
                texts.append("".join(parts))
            run = 1 if starts_line else run + 1
            own_size, own_base, parts = s, at, [text]
            firsts.append(i)
            runs.append(run)
        texts.append("".join(parts))
        first, ends = np.array(firsts), np.array([*firsts[1:], len(x)])
        head = rows.take(pa.array(first))
        columns = [pa.array(runs, pa.int32()), pa.array(ends - first, pa.int32()), pa.array(texts, pa.string()), head.column("x"), pa.array(right[ends - 1] - x[first])]
        yield pa.RecordBatch.from_arrays([*head.columns[:3], *columns, *(head.column(k) for k in ("baseline", "font", "size"))], [*rows.schema.names[:3], "run", "items", "text", "x", "width", "baseline", "font", "size"])


def read_ocr_tsv(lines: DataFrame) -> DataFrame:
    """Word rows (``value`` lines of tab-separated values): those of level 5 with 12 columns or more, a
    text that isn't blank and a finite confidence of 20 or more; bad numbers, NaN among them, become 0, tabs
    inside texts stay and white space at their ends goes."""
    c = F.split("value", "\t", 12)
    number = lambda i: F.nanvl(F.coalesce(F.get(c, F.lit(i)).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    conf = F.get(c, F.lit(10)).try_cast("double")
    text = F.regexp_replace(F.get(c, F.lit(11)), f"^{SPACE}+|{SPACE}+$", "")
    rows = lines.where((F.get(c, F.lit(0)) == "5") & (F.size(c) >= 12)).where((text != "") & (conf >= 20) & (conf < float("inf")))
    return rows.select(
        *[x for x in lines.columns if x != "value"], number(6).alias("x"), number(7).alias("y"), number(8).alias("w"), number(9).alias("h"), conf.alias("conf"), text.alias("text")
    )


def read_ocr_files(spark: SparkSession, path: str) -> DataFrame:
    """``read_ocr_tsv`` over text files (a folder or a pattern), each word row with the ``file`` it is from."""
    return read_ocr_tsv(spark.read.text(path).withColumn("file", F.input_file_name()))


def capped_lists(pages: DataFrame, cap: int = 12) -> DataFrame:
    """By document the first ``cap`` page numbers, with an ellipsis where there are more: pages are numbered
    in order, and only the first of them are put in a list."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))
    own = pages.select("doc_id", "page_no", number.alias("number")).groupBy("doc_id").agg(F.collect_list(F.when(F.col("number") <= cap, F.col("page_no"))).alias("first"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.array_sort("first").cast("array<string>"), ", ")
    return own.select("doc_id", F.concat(text, F.when(F.col("n") > cap, "...").otherwise("")).alias("pages"), "n")


def inspect_corpus(pages: DataFrame, scale: int = 1000) -> DataFrame:
    """By document: pages, bytes (times ``scale``), average bytes of a page, characters of the first
    three pages, and the recommended tier."""
    mib = 1024 * 1024
    own = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        (F.sum(F.octet_length("text")) * scale).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("page_no") <= 3, F.length("text"))), F.lit(0)).alias("head_chars"),
    )
    own = own.withColumn("avg_bytes", F.col("bytes") / F.col("pages"))
    tier = (
        F.when((F.col("bytes") < 8 * mib) & (F.col("avg_bytes") < 75_000) & (F.col("head_chars") > 900), "basic")
        .when((F.col("avg_bytes") > 700_000) & (F.col("head_chars") < 250), "maximum")
        .when((F.col("avg_bytes") > 320_000) | (F.col("bytes") > 120 * mib), "high")
        .otherwise("medium")
    )
    return own.withColumn("tier", tier)


def target_feasibility(pages: DataFrame, targets: list[float], scale: int = 1000) -> DataFrame:
    """By document: the least target in bytes, the budget of a page for the smallest listed target that
    can be met, and the listed targets (in MiB) that are below the size and not below the least."""
    own = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), (F.sum(F.octet_length("text")) * scale).alias("bytes"))
    own = own.withColumn("least", F.greatest(F.lit(524_288), F.col("pages") * 7_000 + 120_000))
    fits = F.filter(F.array(*map(F.lit, targets)), lambda t: (t * 1_048_576 < F.col("bytes")) & (t * 1_048_576 >= F.col("least")))
    budget = F.greatest(F.lit(6_000), F.floor(F.array_min(fits) * 1_048_576 * 0.82 / F.col("pages")))
    return own.withColumn("targets", F.array_join(fits.cast("array<string>"), ",")).withColumn("page_budget", F.when(F.size(fits) > 0, budget))
