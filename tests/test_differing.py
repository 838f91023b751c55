"""Comparing versions: what differs is told from as few texts as it takes; odd pages; texts read once."""

import hashlib
import random
import re

import __spark_entry__ as entry
from leafloom.functions.text import normalize
from leafloom.operators import align
from tests.test_operators import subsequence_table


def optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_token_diff_parts_modified_pages_only(spark, sf):
    plan = optimized(entry.queries()["token_diff"](spark, sf))
    joins, parted = ([i for i, line in enumerate(plan) if x in line] for x in ("Join", "regexp_extract_all"))
    assert parted and max(parted) < min(joins)  # above the joins: texts are moved, and no tokens of other pages made


def test_token_diff_of_odd_pages(spark):
    """Pairs without an id, null texts, common beginnings and ends, against the whole table."""
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice("aAbBcD") for _ in range(rnd.randrange(0, 9)))
    pages_a = {(p, n): text() for p in (None, 1, 2) for n in range(1, 40)} | {(3, 1): None, (4, 1): "x", (5, 1): "x y x"}
    pages_b = {(p, n): text() for p in (None, 1, 2) for n in range(1, 40)} | {(3, 1): "q Q", (4, 1): "x x", (5, 1): None}
    frame = lambda pages: spark.createDataFrame([(*k, t) for k, t in pages.items()], "pair_id int, page_no int, text string")
    status = spark.createDataFrame([(*k, k[1], "modified" if k[1] % 3 else "unchanged") for k in pages_a], "pair_id int, page_a int, page_b int, status string")
    want = []
    for k in pages_a:
        if k[1] % 3:
            x, y = (("" if pages[k] is None else pages[k]).lower().split() for pages in (pages_a, pages_b))
            common = subsequence_table(x, y)
            want += [(*k, k[1], "removed", i, t) for i, t in enumerate(x) if i not in {p for p, _ in common}]
            want += [(*k, k[1], "added", j, t) for j, t in enumerate(y) if j not in {q for _, q in common}]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, align.token_diff(status, frame(pages_a), frame(pages_b)).collect()), key=key) == sorted(want, key=key)


def test_white_space_of_every_kind(spark):
    white = "\t\n\x0b\f\r \xa0         　﻿"
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(white + "  ab\x1c\x85​‐‧⁠\xe9漢\U0001f600") for _ in range(12)) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", normalize("t").alias("n")).collect()
    assert [r.n for r in got] == [re.sub(f"[{white}]+", " ", r.t).strip(" ") for r in got]


def test_common_pages_normalise_each_text_once(spark, sf):
    plan = "\n".join(optimized(entry.queries()["common_pages"](spark, sf)))
    assert len(re.findall(r"regexp_replace\([^\n]*\\x\{1680\}", plan)) == 2  # one a side


def test_common_pages_of_odd_pairs(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), "pair_id int, page_no int, text string")
    a = page((1, 1, "a long page"), (1, 2, "a  long\tpage"), (1, 3, "short"), (1, 4, None), (None, 1, "without an id"), (2, 1, "of one side only"), (3, 1, "of another pair"))
    b = page((1, 7, " a long page "), (1, 8, "short"), (1, 9, None), (None, 5, "without an id"), (2, 1, "of the other only"), (4, 1, "of another pair"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((r.pair_id or 0, r.sig) for r in align.common_pages(a, b).collect())
    assert got == [(0, digest("without an id")), (1, digest("a long page"))]


def test_texts_that_differ_are_fetched_once_a_side(spark, sf):
    assert "\n".join(optimized(entry.queries()["compare_documents"](spark, sf))).count("Generate posexplode") == 2


def test_compared_pages_of_every_status(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), "pair_id int, page_no int, text string")
    anchor = "the same page on both sides"
    for pair in (1, None):
        a = page((pair, 1, "old Old words x"), (pair, 2, anchor), (pair, 3, "gone gone Page"), (pair, 4, anchor + " 2"), (pair, 5, "emptied text"))
        b = page((pair, 1, "x new NEW words"), (pair, 2, anchor), (pair, 3, anchor + " 2"), (pair, 4, " "), (pair, 5, "Late late page " * 12))
        got = {(r.page_a, r.page_b): tuple(r)[3:4] + tuple(r)[6:] for r in align.compare_documents(a, b).collect()}
        assert got == {
            (1, 1): ("modified", 4, 4, 2, 2, "new new", "old old"), (2, 2): ("unchanged", 6, 6, 0, 0, "", ""), (3, None): ("removed", 3, 0, 0, 3, "", "gone gone Page"),
            (4, 3): ("unchanged", 7, 7, 0, 0, "", ""), (5, 4): ("modified", 2, 0, 0, 2, "", "emptied text"), (None, 5): ("added", 0, 36, 36, 0, " ".join(["Late late page"] * 10)[:-10], ""),
        }


def test_report_needs_no_words_of_unchanged_pages(spark, sf):
    from leafloom.plans.compare import versions

    lean, whole = (align.compare_documents(*versions(spark, sf), unchanged_words=x) for x in (False, True))
    assert lean.where("status = 'unchanged' AND (words_a IS NOT NULL OR words_b IS NOT NULL)").isEmpty()
    assert lean.where("status <> 'unchanged'").exceptAll(whole).isEmpty() and lean.count() == whole.count()
    assert align.difference_report(lean).exceptAll(align.difference_report(whole)).isEmpty()
