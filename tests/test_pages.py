"""Cleaning, runs, regions and readers on inputs that the given tables don't hold."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.functions.markup import ACTIVE_TAGS, Cleaner
from leafloom.operators import pages as ops
from leafloom.plans.documents import PLANTED

# Trees of markup: (tag, attributes, children) or a text; what is to be left of each is told by its tree.
TEXTS = st.text("ab =>&;\"'-\né", max_size=8)
GOOD, BAD = ["p", "div", "b", "table"], ["form", "object", "button", "x-own", "select"]
ATTRIBUTES = st.lists(st.sampled_from([("class", "a b", True), ("title", "x > 'y'", True), ("onclick", "f()", False), ("data-k", "1", False), ("href", " JavaScript:f()", False), ("href", "/p?q=1:2", True), ("srcdoc", "<p>", False)]), max_size=3, unique_by=lambda a: a[0])
TREES = st.recursive(TEXTS, lambda inner: st.tuples(st.sampled_from([*GOOD, *BAD, "script", "svg"]), ATTRIBUTES, st.lists(inner, max_size=4)), max_leaves=20)


def written(tree):
    if isinstance(tree, str):
        return tree
    tag, attributes, children = tree
    return f"<{tag.upper()}{''.join(f' {n}="{v}"' for n, v, _ in attributes)}>{''.join('x' if tag == 'script' else written(c) for c in children)}</{tag}>"


def cleaned(tree):
    if isinstance(tree, str):
        return tree
    tag, attributes, children = tree
    inside = "".join(map(cleaned, children))
    if tag in GOOD:
        return f"<{tag}{''.join(f' {n}="{v}"' for n, v, ok in attributes if ok)}>{inside}</{tag}>"
    return inside if tag in BAD else ""


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_clean_trees(tree):
    cleaner = Cleaner()
    done = cleaner.clean(written(tree))
    assert done == cleaned(tree)
    assert cleaner.clean(done) == done and cleaner.tags == cleaner.attributes == cleaner.links == 0


PIECES = st.sampled_from("< > / = \" ' a p script style svg title <a <p> </p> <script> </script </style> <!-- --> --!> <! on onclick= href= javascript: &#106; &lt; \n <textarea> <template> <plaintext> data-x= <br/>".split(" "))


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_nothing_active_comes_out_of_pieces(page):
    done = Cleaner().clean(page)
    again = Cleaner()
    assert again.clean(done) == done and again.tags == again.attributes == again.links == 0
    assert not any(f"<{tag}" in done.lower() for tag in ACTIVE_TAGS if tag != "base")


def test_planted_markup(spark):
    rows = [(i, p[0]) for i, p in enumerate(PLANTED)] + [(99, None), (100, "")]
    got = {r.k: r for r in ops.sanitize_html(spark.createDataFrame(rows, "k bigint, html string"), "k").collect()}
    for i, (_, clean, *counts) in enumerate(PLANTED):
        assert (got[i].clean, [got[i].tags, got[i].attributes, got[i].links]) == (clean, counts)
    assert got[99].clean is None and got[100].clean == ""


def test_cleaning_takes_time_in_proportion():
    for piece in ("<a ", '<p x="', "<a x='y ", "<!--", "<svg>", "</", "<style>", "<b<c ", "<script>", "&lt;<"):
        begun = time.time()
        Cleaner().clean(piece * 100_000 + ">")
        assert time.time() - begun < 3, piece


def test_crowded_page_of_words_and_regions(spark):
    rnd = random.Random(1)
    words = [(1, 1, i, rnd.uniform(-0.1, 1.1), rnd.uniform(-0.1, 1.1), rnd.uniform(0, 0.02), rnd.uniform(0, 0.02)) for i in range(10_000)] + [(1, 1, 10_000, None, 0.5, 0.1, 0.1), (1, 1, 10_001, 0.2, 0.2, float("nan"), 0.1), (None, 1, 1, 0.5, 0.5, 0.1, 0.1)]
    regions = [(1, 1, rnd.uniform(-0.2, 1), rnd.uniform(-0.2, 1), rnd.uniform(0, 0.004), rnd.uniform(0, 0.004)) for _ in range(10_000)] + [(1, 2, 0.0, 0.0, 1.0, 1.0)]
    w = spark.createDataFrame(words, "doc_id int, page_no int, idx int, x double, y double, w double, h double")
    r = spark.createDataFrame(regions, "doc_id int, page_no int, x double, y double, w double, h double")
    begun = time.time()
    got = {x.idx for x in ops.region_redaction(w, r).where("hit").collect()}
    assert time.time() - begun < 30
    boxes = [(x.x, x.y, x.x + x.w, x.y + x.h) for x in ops.valid_regions(r).where("page_no = 1").collect()]
    want = {i for _, _, i, x, y, ww, h in words[:10_000] if any(x < c and x + ww > a and y < d and y + h > b for a, b, c, d in boxes)}
    assert got == want and 0 < len(want) < 10_000


def test_runs_end_where_the_first_item_says(spark):
    rows = [
        (1, 1, 0, "a", 0.0, 5.0, 10.0, "F", 10.0), (1, 1, 1, "b", 10.5, 5.0, 10.0, "F", 10.3), (1, 1, 2, "c", 23.0, 5.0, 10.0, "F", 10.4), (1, 1, 3, "d", 34.0, 5.0, 10.0, "F", 10.6),
        (1, 1, 4, "e ", 46.0, 5.0, 10.0, None, 10.6), (1, 1, 5, "f", 58.0, 5.0, 10.0, None, 10.6), (1, 1, 6, None, 60.0, 5.0, 1.0, "F", 10.0), (1, 1, 7, "g", None, 5.0, 1.0, "F", 10.0),
        (1, 2, 0, "T I T L E", 0.0, 5.0, 40.0, "F", 10.0), (1, 2, 1, "x", 38.0, 5.0, 5.0, "F", 10.0), (1, 2, 2, "y", 53.0, 5.0, 5.0, "F", 10.0), (None, 1, 0, "z", 0.0, 0.0, 1.0, "F", 1.0),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, idx int, text string, x double, baseline double, width double, font string, size double")
    got = sorted(((r.doc_id or 0, r.page_no, r.run, r["items"], r.text) for r in ops.merge_runs(df, 5.0).collect()))
    # c is within 0.5 of a, the run's first item; d is not, though it is of c.
    assert got == [(0, 1, 1, 1, "z"), (1, 1, 1, 3, "ab c"), (1, 1, 2, 1, "d"), (1, 1, 3, 2, "e f"), (1, 2, 1, 2, "TITLEx"), (1, 2, 2, 1, "y")]
    assert ops.merge_runs(df.limit(0), 5.0).count() == 0


def test_pages_without_text_or_ink(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, "x", 0.5), (2, 1, None, None), (2, 2, " ", 0.0), (3, 1, "", float("nan")), (3, 2, None, 0.9)], "doc_id int, page_no int, text string, ink double")
    assert sorted(tuple(r) for r in ops.pages_needing_ocr(df).collect()) == [(1, 2, 0), (2, 2, 0), (3, 2, 0)]
    assert sorted((r.doc_id, r.page_no, r.error, r.new_no) for r in ops.remove_blank_pages(df).collect()) == [(1, 2, False, 1), (2, 1, True, 1), (2, 2, True, 2), (3, 2, False, 1)]


def test_bad_numbers_and_blank_words_of_ocr(spark):
    line = lambda *c: "\t".join(["5", "1", "1", "1", "1", "1", *c])
    rows = [line("NaN", "1", "x", "", "90", "word"), line("1", "2", "3", "4", "90", "\t"), line("1", "2", "3", "4", "90", " a\tb "), line("1", "2", "3", "4", "NaN", "c"), "5\t1", None]
    got = [tuple(r) for r in ops.read_ocr_tsv(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    assert got == [(0.0, 1.0, 0.0, 0.0, 90.0, "word"), (1.0, 2.0, 3.0, 4.0, 90.0, "a\tb")]


def test_redacting_nothing_is_an_error(spark):
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id int, page_no int, text string")
    r = spark.createDataFrame([(1, 2, 0.1, 0.1, 0.5, 0.5), (2, 1, 0.1, 0.1, 0.0, 0.5)], "doc_id int, page_no int, x double, y double, w double, h double")
    assert sorted((x.doc_id, x.page_no, x.text, x.error) for x in ops.redact_pages(p, r).collect()) == [(1, 1, "a", None), (1, 2, "", None), (2, 1, "c", "no region")]


def test_lists_are_capped_before_they_are_made(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 5), (2, None)], "doc_id int, page_no int")
    assert sorted(tuple(r) for r in ops.capped_lists(df, 3).collect()) == [(1, "0, 1, 2...", 30), (2, "5", 2)]
