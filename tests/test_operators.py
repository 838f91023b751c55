"""Operators on small hand-made tables: boundary values, odd rows, invariants."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions.sequences import common_subsequence
from leafloom.functions.text import font_class, hmac_sha256, human_size, is_letter_spaced, normalize, output_name, strip_accents
from leafloom.operators import align, graph, integrity, ledger, ordering, pages, rules

NOW = dt.datetime(2026, 7, 1, 12)


def versions(spark, a, b):
    page = lambda s: [(1, i + 1, f"page text {x}") for i, x in enumerate(s)]
    return (spark.createDataFrame(page(s), "pair_id long, page_no int, text string") for s in (a, b))


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("ABCD", "ABXCD", {"unchanged": 4, "modified": 0, "added": 1, "removed": 0}),
        ("ABCD", "ACD", {"unchanged": 3, "modified": 0, "added": 0, "removed": 1}),
        ("ABCD", "ABCD", {"unchanged": 4, "modified": 0, "added": 0, "removed": 0}),
        ("ABAB", "BABA", {"unchanged": 3, "modified": 0, "added": 1, "removed": 1}),
        ("ABC", "AXC", {"unchanged": 2, "modified": 1, "added": 0, "removed": 0}),
    ],
)
def test_alignment_cases(spark, a, b, want):
    row = align.diff_summary(align.page_status(*versions(spark, a, b))).first().asDict()
    assert {k: row[k] for k in want} == want


def subsequence_table(a, b):
    """The whole table of lengths, and the walk back from its end."""
    n, m = len(a), len(b)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i, j in itertools.product(range(n), range(m)):
        length[i + 1][j + 1] = length[i][j] + 1 if a[i] is not None and a[i] == b[j] else max(length[i][j + 1], length[i + 1][j])
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] is not None and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif length[i][j - 1] == length[i][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_subsequence_is_that_of_the_whole_table():
    rnd = random.Random(1)
    for kinds in ("ab", "abcdef", ["x", None, "y"]):
        for _ in range(300):
            a, b = ([rnd.choice(kinds) for _ in range(rnd.randrange(0, 25))] for _ in range(2))
            pairs = common_subsequence(a, b)
            assert pairs == subsequence_table(a, b)
            assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs]


def test_long_sequences_are_exact_too():
    rnd = random.Random(2)
    a = [rnd.randrange(40) for _ in range(3000)]
    b = [x for x in a if rnd.random() < 0.9] + [41] * 500
    assert common_subsequence(a, b)[-1][0] == max(i for i, x in enumerate(a) if x == b[-501])
    assert len(common_subsequence(a, b)) == len(b) - 500
    assert len(common_subsequence(["x"] * 30_000, ["x"] * 20_000)) == 20_000


def test_a_page_that_repeats_very_often(spark):
    """30,000 equal pages on one side and 20,000 on the other: no row for each pair of them."""
    pages = lambda n: spark.range(1, n + 1).selectExpr("1L AS pair_id", "CAST(id AS INT) AS page_no", "'one and the same page' AS text")
    got = align.page_anchors(pages(30_000), pages(20_000))
    assert {(r.method, r.n) for r in got.groupBy("method").agg(F.count("page_a").alias("n")).collect()} == {("subsequence", 20_000)}
    row = align.diff_summary(align.page_status(pages(30_000), pages(20_000))).first()
    assert (row.unchanged, row.removed, row.differences) == (20_000, 10_000, 10_000)


def test_token_diff_is_that_of_the_whole_table(spark, sf):
    """The registered query against the table of each pair of pages, spelled out here."""
    from leafloom.functions.text import tokens
    from leafloom.plans import compare

    a, b = compare.versions(spark, sf)
    own = lambda p: {(r.pair_id, r.page_no): r.t for r in p.select("pair_id", "page_no", F.transform(tokens(normalize(F.col("text"))), F.lower).alias("t")).collect()}
    one, two = own(a), own(b)
    want = []
    for r in align.page_status(a, b).where("status = 'modified'").collect():
        x, y = one[r.pair_id, r.page_a], two[r.pair_id, r.page_b]
        common = subsequence_table(x, y)
        want += [(r.pair_id, r.page_a, r.page_b, "removed", i, t) for i, t in enumerate(x) if i not in {p for p, _ in common}]
        want += [(r.pair_id, r.page_a, r.page_b, "added", j, t) for j, t in enumerate(y) if j not in {q for _, q in common}]
    assert sorted(map(tuple, compare.token_diff(spark, sf).collect())) == sorted(want) and want


def test_report_of_pairs_without_differences(spark):
    compared = align.compare_documents(*versions(spark, "AB", "AB"))
    assert [tuple(r) for r in align.difference_report(compared).collect()] == [(1, 1, "No differences", "")]
    changed = align.compare_documents(*versions(spark, "ABC", "AXC"))
    assert [(r.line, r.label) for r in align.difference_report(changed).collect()] == [(1, "MODIFIED - original p. 2 -> revised p. 2")]


def test_word_delta_snippets(spark):
    a = spark.createDataFrame([(1, 1, "the Prazo of 30 days")], "pair_id int, unit int, norm string")
    b = spark.createDataFrame([(1, 1, "the prazo of 45 Days days New new")], "pair_id int, unit int, norm string")
    r = align.word_delta(a, b).first()
    assert (r.added_words, r.removed_words, r.added_snippet, r.removed_snippet) == (4, 1, "45 Days New New", "30")


def test_normalize_folds_forms_and_spaces(spark):
    df = spark.createDataFrame([(" a  ﬁn　x ", 1), (None, 2)], "t string, i int")
    got = {r.i: r.n for r in df.select("i", normalize(F.col("t"), nfkc=True).alias("n")).collect()}
    assert got == {1: "a fin x", 2: None}


def test_hmac_is_the_standard_one(spark):
    import hashlib
    import hmac

    for secret in ("k", "long" * 40):
        got = spark.range(1).select(hmac_sha256(secret, F.lit("id:a;ts:1;")).alias("h")).first().h
        assert got == hmac.new(secret.encode(), b"id:a;ts:1;", hashlib.sha256).hexdigest()


def test_human_size(spark):
    df = spark.createDataFrame([(512,), (1536,), (5 * 2**20,), (3 * 2**40,)], "s long")
    assert [r.h for r in df.select(human_size(F.col("s")).alias("h")).collect()] == ["512 B", "1.5 KB", "5.0 MB", "3,072.0 GB"]


def test_sanitize_removes_active_content(spark):
    html = '<p onclick="x()">Safe</p><script>alert(1)</script><iframe srcdoc="<b>"></iframe><a href="javascript:x()">link</a><div data-x="1">t</div><input><FORM>f</FORM>'
    r = pages.sanitize_html(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert r.clean == "<p>Safe</p><a>link</a><div>t</div>f" and (r.tags, r.attributes, r.links) == (4, 2, 1)


@pytest.mark.parametrize(
    "html, clean",
    [
        ("<a href=javascript:x()>t</a>", "<a>t</a>"),
        ("<a HREF = JavaScript:x() class=k>t</a>", '<a class="k">t</a>'),
        ("<img/onerror=alert(1)/src=x>", "<img>"),
        ("<img src=x onerror='a()'>", '<img src="x">'),
        ("<svg/onload=x()>t</svg>", ""),
        ('<a href="ok.html">javascript: a word</a>', '<a href="ok.html">javascript: a word</a>'),
    ],
)
def test_sanitize_without_quotes_and_after_slashes(spark, html, clean):
    r = pages.sanitize_html(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert r.clean == clean and (r.tags + r.attributes + r.links > 0) == (html != clean)


def test_accents_are_taken_off_by_decomposition(spark):
    import unicodedata

    text = "čČąőűŐřŁøßÅéñǘ ẽ ﬁ e\u0301 中 ΐ"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.s for r in df.select(strip_accents(F.col("t")).alias("s")).collect()] == [want, None]
    got = rules.facet_search(spark.createDataFrame([(1, "Dvořák", "c"), (2, "other", "c")], "id int, name string, category string"), spark.createDataFrame([], "id int, rank int"), None, "DVORAK", ["name"])
    assert [r.id for r in got.collect()] == [1]


def test_names_and_labels(spark):
    df = spark.createDataFrame([(7, "a"), (1234, "b")], "n int, s string")
    assert [r.o for r in df.select(output_name(F.col("n"), F.col("s"), "_x.txt").alias("o")).collect()] == ["007-a_x.txt", "1234-b_x.txt"]
    df = spark.createDataFrame([("T I T",), ("E M",), ("e m",), ("a bc d",), ("AB",), (None,)], "t string")
    assert [r.s for r in df.select(is_letter_spaced(F.col("t")).alias("s")).collect()] == [True, True, False, False, False, False]
    df = spark.createDataFrame([("ABC+Georgia-BoldItalic", None), ("x", "sans-serif"), ("Courier", "serif"), ("Calibri", "monospace"), (None, None)], "n string, f string")
    got = [tuple(r.f) for r in df.select(font_class(F.col("n"), F.col("f")).alias("f")).collect()]
    assert got == [("Times New Roman", True, True), ("Arial", False, False), ("Courier New", False, False), ("Calibri", False, False), ("Arial", False, False)]


def test_files_are_read_and_bad_ones_go_to_a_table(spark, tmp_path):
    for name, content in (("a.bin", b"%%MARK and more"), ("b.bin", b"MARK"), ("c.bin", b"no such thing here"), ("d.txt", b"MARK but another kind")):
        (tmp_path / name).write_bytes(content)
    good, bad = integrity.read_files(spark, str(tmp_path), "MARK", pattern="*.bin")
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.bin"]
    integrity.write_rejects(bad, str(tmp_path / "rejects"))
    assert {(r.path.rsplit("/", 1)[1], r.why) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {("b.bin", "short"), ("c.bin", "marker")}
    out = spark.createDataFrame([(1, b"MARK" + b"x" * 95), (2, b"MARK" + b"x" * 96)], "id int, content binary")
    assert [r.ok for r in integrity.check_outputs(out, "MARK").orderBy("id").collect()] == [False, True]


def test_texts_and_reports_are_written_and_read_back(spark, tmp_path):
    own = spark.createDataFrame([(1, 1, "first"), (1, 2, "second é"), (2, 1, "")], "doc_id int, page_no int, text string")
    pages.write_document_text(own, str(tmp_path / "t"), " | ")
    files = list((tmp_path / "t" / "doc_id=1").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text() == "first | second é\n"
    pages.write_document_text(own, str(tmp_path / "p"), " | ", per_file=1000)
    assert {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "first | second é"), (2, "")}
    rows = spark.createDataFrame([(1, 900, 300), (2, 900, None), (3, 10, 1)], "doc_id int, before long, after long")
    integrity.write_batch_report(integrity.batch_run_report(rows, 100), str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("state=*")} == {"state=OK", "state=ERROR"}
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "x.tsv").write_text("level\tpage\n" + "\t".join(["5", *"12345", "10", "20", "30", "40", "91.5", "word\twith tab"]) + "\n4\t1\n")
    got = pages.read_ocr_files(spark, str(tmp_path / "ocr")).collect()
    assert [(r.x, r.h, r.conf, r.text, r.file.rsplit("/", 1)[1]) for r in got] == [(10.0, 40.0, 91.5, "word\twith tab", "x.tsv")]


def test_a_report_without_its_file_is_not_matched(spark):
    reports = spark.createDataFrame([(1, "r", "r", "S", 5, 2), (2, "r", "r", "s", 5, 2), (3, "r", "r", None, 5, 2)], "doc_id int, report_sha256 string, computed_sha256 string, sha256 string, size_bytes long, pages long")
    actual = spark.createDataFrame([(1, "s", 5, 2), (3, None, 5, 2)], "doc_id int, sha256 string, size_bytes long, pages long")
    rows = integrity.verify_reports(reports, actual).collect()
    assert {r.doc_id: r.matched for r in rows} == {1: True, 2: False, 3: True} and len(rows) == 12
    assert all(r.ok is not None for r in rows)


def test_all_blank_document_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, "", 0.0), (1, 2, " ", 0.0), (2, 1, "", 0.0), (2, 2, "x", 0.5), (2, 3, "", 0.9)], "doc_id int, page_no int, text string, ink double")
    got = {(r.doc_id, r.page_no, r.new_no, r.error) for r in pages.remove_blank_pages(df).collect()}
    assert got == {(1, 1, 1, True), (1, 2, 2, True), (2, 2, 1, False), (2, 3, 2, False)}


def test_redaction_leaves_nothing(spark):
    own = spark.createDataFrame([(1, 1, "SECRET 123"), (1, 2, "open"), (2, 1, "kept")], "doc_id int, page_no int, text string")
    marks = spark.createDataFrame([(1, 1, 0.05, 0.08, 0.9, 0.2), (2, 1, 0.1, 0.1, 0.0, 0.5), (2, 1, 1.5, 0.1, 0.2, 0.5)], "doc_id int, page_no int, x double, y double, w double, h double")
    after = pages.redact_pages(own, marks)
    assert {(r.doc_id, r.page_no, r.text) for r in after.collect()} == {(1, 1, ""), (1, 2, "open"), (2, 1, "kept")}
    assert [r.ok for r in pages.leak_check(own, after, marks, "SECRET").collect()] == [True]
    assert [r.ok for r in pages.leak_check(own, own, marks, "SECRET").collect()] == [False]


def test_packing_conserves_and_respects_limits(spark):
    rnd = random.Random(3)
    items = [(k, i, rnd.randrange(1, 120)) for k in "ab" for i in range(200)]
    got = ordering.pack_sequential(spark.createDataFrame(items, "k string, i int, size long"), "k", ["i"], 5, 100).collect()
    assert sorted((r.k, r.i, r.size) for r in got) == sorted(items)
    by = {}
    for r in got:
        by.setdefault((r.k, r.grp), []).append((r.i, r.size))
    for own in by.values():
        own.sort()
        assert [i for i, _ in own] == list(range(own[0][0], own[-1][0] + 1))
        assert len(own) == 1 or (len(own) <= 5 and sum(s for _, s in own) <= 100)


def test_step_chain_is_connected(spark):
    df = spark.createDataFrame([(1, 1000, ["pdfa", "compress", "ocr", "remove-metadata"], 0.5)], "doc_id int, bytes long, enabled array<string>, factor double")
    got = sorted((r.ord, r.step, r.before, r.after, r.change) for r in integrity.step_chain(df).collect())
    assert got == [(1, "compress", 1000, 500, "50.0% smaller"), (2, "ocr", 500, 500, "no change in size"), (3, "remove-metadata", 500, 250, "50.0% smaller"), (4, "pdfa", 250, 250, "no change in size")]


def test_premium_without_end_has_no_deadline(spark):
    rows = [(1, "premium", None), (2, "premium", NOW), (3, "premium", NOW + dt.timedelta(seconds=1)), (4, "free", None)]
    profiles = spark.createDataFrame(rows, "user_id long, plan string, premium_until timestamp_ntz")
    uses = spark.createDataFrame([(u, t) for u in (1, 2, 3, 4, 5, None) for t in ("open", "extra")], "user_id long, tool string")
    need = spark.createDataFrame([("extra", "premium")], "tool string, need string")
    got = {(r.user_id, r.tool): (r.level, r.allowed) for r in ledger.entitlement_check(uses, profiles, need, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert {u: got[u, "extra"] for u in (1, 2, 3, 4, 5, None)} == {1: ("premium", True), 2: ("account", False), 3: ("premium", True), 4: ("account", False), 5: ("visitor", False), None: ("visitor", False)}
    assert all(v[1] for (u, t), v in got.items() if t == "open")


def test_ledger_adds_to_the_later_of_now_and_end(spark):
    t = lambda d: NOW + dt.timedelta(days=d)
    rows = [(1, "a", "month", t(0)), (1, "b", "year", t(10)), (1, "c", "month", t(500))]
    got = {r.payment_id: r.premium_until for r in ledger.premium_ledger(spark.createDataFrame(rows, "user_id long, payment_id string, period string, ts timestamp_ntz")).collect()}
    assert got == {"a": t(30), "b": t(395), "c": t(530)}


@pytest.mark.parametrize("keep, want", [(False, {"a": 40, "b": 70, "c": 32, "d": 31, "e": 32}), (True, {"a": 40, "b": 70, "c": 32, "d": None, "e": 32})])
def test_ledger_goes_on_from_what_a_user_has(spark, keep, want):
    t = lambda d: NOW + dt.timedelta(days=d)
    rows = [(1, "a", "month", t(0)), (1, "b", "month", t(20)), (2, "c", "month", t(2)), (3, "d", "month", t(1)), (4, "e", "month", t(2))]
    initial = spark.createDataFrame([(1, "premium", t(10)), (2, "premium", t(-5)), (3, "premium", None), (4, "free", t(90))], "user_id long, plan string, premium_until timestamp_ntz")
    credits = spark.createDataFrame(rows, "user_id long, payment_id string, period string, ts timestamp_ntz")
    got = {r.payment_id: r.premium_until for r in ledger.premium_ledger(credits, initial, keep_unlimited=keep).collect()}
    assert got == {k: None if d is None else t(d) for k, d in want.items()}


def test_first_of_repeated_keys_is_inserted(spark):
    table = spark.createDataFrame([(1, "old", 0)], "id int, name string, at int")
    rows = spark.createDataFrame([(2, "later", 5), (2, "first", 3), (1, "no", 1), (None, "no", 1), (3, "b", 1), (3, "a", 1)], "id int, name string, at int")
    assert {tuple(r) for r in ledger.insert_ignore(table, rows, "id", ["at", "name"]).collect()} == {(1, "old", 0), (2, "first", 3), (3, "a", 1)}


def test_notices_of_one_time_have_an_order(spark):
    rows = [("p", 2, "year", "approved", NOW), ("p", 1, "month", "approved", NOW), ("p", 1, "month", "rejected", NOW - dt.timedelta(1))]
    got = ledger.apply_once(spark.createDataFrame(rows, "payment_id string, user_id long, period string, status string, ts timestamp_ntz")).collect()
    assert [(r.user_id, r.period) for r in got] == [(1, "month")]


def test_entries_go_to_the_end_in_their_order(spark):
    registry = spark.createDataFrame([(i, i, False) for i in range(50)], "id int, ord long, built_in boolean")
    rows = spark.createDataFrame([(i, 100 - i, i == 7) for i in range(0, 60, 7)], "id int, ord long, built_in boolean")
    got = {r.id: r.ord for r in ledger.registry_upsert(registry, rows).collect()}
    new = sorted((i for i in range(0, 60, 7) if i != 7), key=lambda i: 100 - i)
    assert {i: got[i] for i in new} == {i: 50 + k for k, i in enumerate(new)} and len(got) == 51 and got[7] == 7


def test_pages_of_sources_are_numbered_by_ranges(spark):
    sources = [spark.createDataFrame([(d, p, f"{k}-{d}-{p}") for d in range(40) for p in range(1, 2 + (d + k) % 4)], "doc_id long, page_no int, text string") for k in range(2)]
    rows = ordering.append_ordered(sources).collect()
    for k in range(2):
        own = sorted((r.doc_id, r.page_no, r.src_page) for r in rows if r.src_ord == k)
        assert [n for _, _, n in own] == list(range(1, len(own) + 1))


def test_middle_gap_and_favourites_of_long_histories(spark):
    rnd = random.Random(4)
    ts = sorted(rnd.randrange(10**6) for _ in range(5000))
    rows = [("k", i, t) for i, t in enumerate(ts)] + [("one", 0, 5), ("two", 0, 5), ("two", 1, 9)]
    got = {r.key: (r.median, r.gaps, r.splits) for r in rules.upper_median_gap(spark.createDataFrame(rows, "key string, id long, ts long"), 100).collect()}
    gaps = sorted(b - a for a, b in zip(ts, ts[1:]))
    middle = gaps[len(gaps) // 2]
    assert got == {"k": (middle, 4999, sum(g > middle + 100 for g in gaps)), "two": (4, 1, 0)}
    toggles = [(u, i, rnd.randrange(30)) for u in (1, 2) for i in range(15_000)]
    held = {1: [], 2: []}
    for u, _, x in toggles:
        held[u] = [y for y in held[u] if y != x] if x in held[u] else [x, *held[u]][:12]
    df = spark.createDataFrame(toggles, "user_id long, ts long, item long").withColumn("id", F.col("ts"))
    assert {r.user_id: r.favorites for r in rules.favorites_fold(df).collect()} == {u: ",".join(map(str, h)) for u, h in held.items()}


def test_long_texts_wrap_in_linear_time(spark):
    text = " ".join(f"w{i % 97}" for i in range(400_000))
    rows = pages.wrap_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a" * 200 + " b")], "doc_id int, text string")).collect()
    lines = [r.line for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.line_no)]
    assert " ".join(lines) == text and max(map(len, lines)) <= 94
    assert {(r.doc_id, r.line_no, r.line) for r in rows if r.doc_id > 1} == {(2, 1, ""), (3, 1, ""), (4, 1, "a" * 200), (4, 2, "b")}


def test_change_groups_of_a_page_have_a_cap(spark):
    rows = [(1, 1, i, 0.5, 0.1, i / 100, 0.01) for i in range(0, 40, 2)]
    got = align.change_groups(spark.createDataFrame(rows, "doc_id int, page_no int, idx int, y double, h double, x double, w double"), align.REMOVED_GROUPS).collect()
    assert len(got) == 6 and {r.overflow for r in got} == {14}


@pytest.mark.parametrize("amount, currency, reference, ok", [("19.90", "BRL", "pay:month:" + "a" * 8 + "-bbbb-cccc-dddd-" + "e" * 12, True), ("19.89", None, "pay:month:" + "a" * 8 + "-bbbb-cccc-dddd-" + "e" * 12, False), ("199.00", None, "PAY:YEAR:" + "A" * 8 + "-BBBB-CCCC-DDDD-" + "E" * 12, True), ("500.00", "USD", "pay:year:" + "a" * 8 + "-bbbb-cccc-dddd-" + "e" * 12, False), ("500.00", None, "pay:week:x", False)])
def test_approved_purchases(spark, amount, currency, reference, ok):
    df = spark.createDataFrame([("1", "approved", reference, currency, amount), ("2", "rejected", reference, currency, amount)], "payment_id string, status string, reference string, currency string, amount string")
    assert [r.payment_id for r in ledger.approved_purchases(df.withColumn("amount", F.col("amount").cast("decimal(10,2)")), "pay").collect()] == (["1"] if ok else [])


def test_signature_boundaries(spark):
    key = "s"
    good = F.concat(F.lit("v1="), hmac_sha256(key, F.lit("id:ab1;request-id:r;ts:9;")), F.lit(", ts=9"))
    rows = spark.createDataFrame([("AB1", "r", 1), ("AB-1", "r", 1), ("AB1", None, 1), ("AB1", "r", 0)], "data_id string, request_id string, has int").withColumn("header", F.when(F.col("has") == 1, good))
    assert [r.valid for r in ledger.verify_signatures(rows, key).collect()] == [True, False, False, False]
    assert not any(r.valid for r in ledger.verify_signatures(rows, "").collect())


def test_favorites_forget_what_falls_off(spark):
    toggles = [(1, i, i % 14) for i in range(14)] + [(1, 20, 0), (1, 21, 13)]
    df = spark.createDataFrame(toggles, "user_id long, ts long, item long").withColumn("id", F.col("ts"))
    assert rules.favorites_fold(df).first().favorites == "0,12,11,10,9,8,7,6,5,4,3"


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.reachable(spark, edges, [1]).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_reachability_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGE_ROUNDS", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(8, 0), (2, 5)], "src long, dst long")
    got = sorted((r.node, r.depth) for r in graph.reachable(spark, edges, [0, 0]).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 4), (7, 5), (8, 6)]


@pytest.mark.parametrize("hops", [1, 2, 5])
def test_reachability_by_random_edges(spark, hops):
    import random

    rnd = random.Random(hops)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)] + [(3, None), (None, 4)]
    want, layer, depth = {7: 0}, {7}, 0
    while layer:
        depth += 1
        layer = {b for a, b in edges if a in layer and b is not None and b not in want}
        want |= dict.fromkeys(layer, depth)
    got = graph.reachable(spark, spark.createDataFrame(edges, "src long, dst long"), [7], hops=hops).collect()
    assert len(got) == len(want) > 1 and {r.node: r.depth for r in got} == want


def test_candidates_stop_at_the_first_within_target(spark):
    rows = [("a", 1, 90, 100, 50), ("a", 2, 40, 100, 50), ("a", 3, 10, 100, 50), ("b", 1, 90, 100, 50), ("b", 2, 80, 100, 50), ("c", 1, 120, 100, 50)]
    got = {r.key: (r.rank, r.size, r.tried, r.met) for r in rules.select_candidate(spark.createDataFrame(rows, "key string, rank int, size long, original long, target long")).collect()}
    assert got == {"a": (2, 40, 2, True), "b": (2, 80, 2, False), "c": (None, 100, 1, False)}


def test_library_works_without_the_corpus_package():
    """Nothing outside that package imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "leafloom"
    name = "leafloom." + "llm"
    for f in root.rglob("*.py"):
        if (root / "llm") not in f.parents:
            assert name not in f.read_text(), f


@pytest.fixture
def many_ranges(spark):
    """Ranges that small tables would otherwise be put together from."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_over_many_ranges(spark, many_ranges):
    """Offsets, contents and outlines of a hot source, a null one and a single file, against plain loops."""
    rnd = random.Random(8)
    own = [("hot", d, rnd.randrange(1, 9), rnd.choice(["a.PDF", " ", "b"]), rnd.choice(["x", "y", " ", None])) for d in range(300)]
    own += [(None, d, 2, "n", "x") for d in range(7)] + [("one", 5, 3, "t.txt", None)]
    specs = ordering.page_offsets(spark.createDataFrame(own, "source string, doc_id long, pages long, title string, category string"))
    at, first = {}, {}
    for s, d, n, _, _ in own:
        first[s, d] = at.get(s, 0)
        at[s] = first[s, d] + n
    assert {(r.source, r.doc_id): r.first_page for r in specs.collect()} == first
    toc = {(r.source, r.doc_id): (r.toc_page, r.row, r.shown_page) for r in ordering.table_of_contents(specs).collect()}
    for s in ("hot", None, "one"):
        docs = sorted(d for t, d in first if t == s)
        assert [toc[s, d] for d in docs] == [(k // 27 + 1, k % 27 + 1, -(-len(docs) // 27) + first[s, d] + 1) for k, d in enumerate(docs)]
    tree = ordering.outline_tree(specs.withColumn("root", F.col("doc_id") % 5 == 0)).collect()
    levels = {}
    for s, d, _, _, c in own:
        top = d % 5 == 0 or not (c or "").strip()
        levels.setdefault((s, None if top else f"c:{c}"), []).append((first[s, d], d, 1, f"d:{d}"))
    for (s, c), nodes in [x for x in levels.items() if x[0][1]]:
        levels.setdefault((s, None), []).append((min(nodes)[0], min(n[1] for n in nodes), 0, c))
    want = set()
    for (s, c), nodes in levels.items():
        names = [None, *(n for *_, n in sorted(nodes)), None]
        want |= {(s, c, n, k, names[k - 1], names[k + 1]) for k, n in enumerate(names) if n}
    assert {(r.source, r.parent, r.node, r.ord, r.prev, r.next) for r in tree} == want and len(tree) == len(want)


def test_charges_meet_approvals_of_their_hour(spark):
    """Against all pairs: at the charge's own time, at the last minute, one second later, before it."""
    rnd = random.Random(6)
    when = lambda: NOW + dt.timedelta(seconds=rnd.choice([0, 1, 3599, 3600, 3601, rnd.randrange(50_000)]))
    charges = [(i, rnd.choice([1, 1, 1, 2, None]), when()) for i in range(200)] + [(900, 1, None)]
    paid = [(rnd.choice([1, 1, 2, None]), when()) for _ in range(60)] + [(1, None)]
    got = ledger.expire_charges(spark.createDataFrame(charges, "charge_id long, user_id long, ts timestamp_ntz"), spark.createDataFrame(paid, "user_id long, ts timestamp_ntz")).collect()
    want = {}
    for i, u, t in charges:
        met = [p for v, p in paid if t and p and u and u == v and t <= p <= t + dt.timedelta(hours=1)]
        want[i] = (u, t, min(met, default=None), "paid" if met else "expired")
    assert {r.charge_id: (r.user_id, r.ts, r.paid_ts, r.status) for r in got} == want and len(got) == len(want)
    assert {s for *_, s in want.values()} == {"paid", "expired"}
