"""Queries over words move pages, not words: rows shuffled, counted by Spark itself."""

import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafloom.functions.text import _nfkc, tokens
from leafloom.operators import align
from leafloom.operators import pages as ops
from leafloom.sources.derived import doc_pages, words


def shuffled_rows(spark, df) -> int:
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)

    def total() -> int:
        stages, n = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None).iterator(), 0
        while stages.hasNext():
            n += stages.next().shuffleWriteRecords()
        return n

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name, pages", [("region_redaction", 1.5), ("word_delta", 5), ("change_groups", 2.5), ("merge_runs", 1.5), ("assemble_lines", 1.5), ("multiset_except", 2.5)])
def test_rows_moved_by_page(spark, sf, name, pages):
    own = doc_pages(spark, sf)
    n, n_words = own.count(), own.agg(F.sum(F.size(tokens(F.col("text"))))).first()[0]
    assert pages * n < n_words / 4
    assert shuffled_rows(spark, entry.queries()[name](spark, sf)) <= pages * n


def test_regions_come_with_their_pages(spark, monkeypatch):
    monkeypatch.setattr(ops, "CROWD", 2)  # page 2 is crowded
    pages = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "a b c d"), (1, 3, "a b"), (None, 1, "a")], "doc_id int, page_no int, text string")
    marks = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.05, 0.1), (1, 1, 0.0, 0.0, 0.05, 0.1), *((1, 2, k / 12 + 0.01, 0.0, 0.01, 0.1) for k in range(3)), (None, 1, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page_no int, x double, y double, w double, h double")
    got = ops.region_redaction(words(ops.with_regions(pages, marks), "regions"), marks)
    assert got.columns == [*words(pages).columns, "hit"]
    hit = sorted((r.page_no, r.idx) for r in got.where("hit").collect())
    assert hit == [(1, 0), (2, 0), (2, 1), (2, 2)] and got.count() == 11
    assert hit == sorted((r.page_no, r.idx) for r in ops.region_redaction(words(pages), marks).where("hit").collect())


def test_word_delta_of_odd_units(spark):
    a = spark.createDataFrame([(1, 1, "b A a c"), (1, 2, ""), (1, 3, "x"), (None, 1, "q"), (2, 1, " ".join(f"w{i}" for i in range(40)))], "pair_id int, unit int, norm string")
    b = spark.createDataFrame([(1, 1, "c C c d a"), (1, 2, " "), (1, 4, "y Y"), (None, 1, None), (2, 1, "z " * 30 + "y")], "pair_id int, unit int, norm string")
    got = {(r.pair_id, r.unit): tuple(r)[2:] for r in align.word_delta(a, b).collect()}
    assert got == {
        (1, 1): (3, 2, "c c d", "b A"), (1, 3): (0, 1, "", "x"), (1, 4): (2, 0, "y y", ""), (None, 1): (0, 1, "", "q"),
        (2, 1): (31, 40, " ".join(["z"] * 28), " ".join(f"w{i}" for i in range(28))),
    }


def test_lines_with_nulls_and_nan(spark):
    nan = float("nan")
    rows = [
        (1, 1, 0, "a", 0.0, 0.0, 0.1, 0.01), (1, 1, 1, "b", 0.11, 0.0, 0.02, 0.01), (1, 1, 2, None, 0.105, 0.0, 0.001, 0.01), (1, 1, 3, "d", 0.5, 0.0, 0.1, 0.01), (1, 1, 4, "e", 0.61, 0.0, None, 0.01),
        (1, 1, 5, "f", None, 0.0, 0.1, 0.01), (1, 1, 6, "g", 0.2, nan, 0.1, 0.01), (1, 1, 7, "h", 0.3, nan, 0.1, nan), (1, 2, 0, "i", 0.0, 0.0, 0.1, 0.01), (None, 1, 0, "j", 0.0, None, 0.1, None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, idx int, text string, x double, y double, w double, h double")
    got = sorted((r.doc_id or 0, r.page_no, str(r.line), r.run, r.text) for r in ops.assemble_lines(df).collect())
    assert got == [(0, 1, "None", 1, "j"), (1, 1, "0.0", 1, "f"), (1, 1, "0.0", 2, "a b"), (1, 1, "0.0", 3, "d e"), (1, 1, "nan", 1, "g"), (1, 1, "nan", 2, "h"), (1, 2, "0.0", 1, "i")]


def test_tokens_beyond_those_of_the_other_version(spark):
    a = spark.createDataFrame([(1, "a A b"), (1, "c a"), (2, None), (None, "x x"), (3, "q")], "pair_id int, text string")
    b = spark.createDataFrame([(1, "a d"), (None, "X"), (4, "z")], "pair_id int, text string")
    got = sorted((r.pair_id or 0, r.token) for r in align.tokens_except(a, b).collect())
    assert got == [(0, "x"), (1, "a"), (1, "a"), (1, "b"), (1, "c"), (3, "q")]


def test_folding_forms_holds_few_texts(spark):
    text = "ﬁn… é" * 2_000
    texts = pa.array([*[text] * 2_000, None, "Å"], pa.string())
    tracemalloc.start()
    got = next(_nfkc.func(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [*[unicodedata.normalize("NFKC", text)] * 2_000, None, "Å"]
    assert peak < 20_000_000  # all texts as Python strings: over 40 MB
