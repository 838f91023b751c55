"""The digest index: what it keeps, over batches, and as a filter."""

import hashlib

import pytest

from leafloom.llm import common, exact_dedup
from leafloom.llm.common import LOWER_BYTES

SCHEMA = "doc_id bigint, text string, digest string, k int, keep_id string, row string, kind int, bit_row int, bit int, bit_map string, `keep` int, size int, __slot string, __xd_row int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", "r", 2, 3, 4, "m", 5, 6, "s", 7) for d, t in rows], SCHEMA)


def norm(t):
    return (t or "").encode().translate(LOWER_BYTES)


ROWS = [(i, f"Text {i % 7} É") for i in range(60)] + [(70, None), (71, ""), (None, "lone"), (None, "TEXT 1 É"), (72, "Alone"), (5, "Text 5 É"), (73, "a" * 200_000), (74, "A" * 200_000), (75, "é")]


def test_marks_against_a_loop(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(frame(spark, ROWS))
    got = exact_dedup.mark_copies(frame(spark, ROWS), index)
    assert got.columns == [*frame(spark, []).columns, "xd_digest", "xd_keep_id", "xd_size", "xd_kept"]
    groups = {}
    for d, t in ROWS:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t in ROWS:
        keep = max((x for x in groups[norm(t)] if x is not None), default=None)
        want.append((d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t)).digest()))
    assert sorted(((r.doc_id, r.xd_keep_id, r.xd_size, r.xd_kept, bytes(r.xd_digest)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    index.drop()


def test_filter_keeps_one_row_of_each_text(spark):
    left = exact_dedup.drop_copies(spark, frame(spark, ROWS))
    assert left.columns == frame(spark, []).columns
    assert {tuple(r)[2:] for r in left.collect()} == {tuple(r)[2:] for r in frame(spark, ROWS).collect()}
    best = {}
    for d, t in ROWS:
        best[norm(t)] = max(best.get(norm(t), -1), -1 if d is None else d)
    assert sorted((-1 if r.doc_id is None else r.doc_id, norm(r.text)) for r in left.collect()) == sorted((d, t) for t, d in best.items())


def test_dropping_leaves_no_table_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.drop_copies(spark, frame(spark, ROWS)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_buckets_follow_the_number_of_texts():
    assert [exact_dedup.buckets_for(n) for n in (0, 64 * exact_dedup.BUCKET_ROWS, 64 * exact_dedup.BUCKET_ROWS + 1, 10**10)] == [64, 64, 128, 4096]


@pytest.mark.parametrize("most", [common.MOST_BITS, 1])
def test_rows_are_dropped_with_and_without_the_prefilter(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    docs = spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "7 AS bit").unionByName(spark.createDataFrame([(5, "5", 7), (8, "8", 7), (None, None, 7)], "doc_id bigint, text string, bit int"))
    key = common.row_key()
    gone = docs.where("doc_id % 3 = 0 OR doc_id IS NULL").select(key.alias("row"))
    once = docs.where("doc_id = 5").select(key.alias("row")).distinct()
    left = common.drop_rows(docs, key, common.stored(spark, gone, "gone"), once=common.stored(spark, once, "once"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i in range(3000) if i % 3] + [8])
    assert common.filter_bits(10) == (common.LEAST_BITS if most > 1 else None)


def test_later_batches_are_deduplicated_against_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, "idx_a", path=path, buckets=4)
    first.add(frame(spark, [(1, "a"), (2, "A"), (3, "b")]))
    again = exact_dedup.DigestIndex(spark, "idx_b", path=path, buckets=4)
    again.add(frame(spark, [(9, "a"), (10, "c")]))
    kept = {bytes(r.digest): (r.keep_id, r.group_size) for r in again.rows().collect()}
    sha = lambda t: hashlib.sha256(t).digest()
    assert kept == {sha(b"a"): (2, 2), sha(b"b"): (3, 1), sha(b"c"): (10, 1)}
    marks = exact_dedup.mark_copies(frame(spark, [(9, "a"), (10, "c")]), again).collect()
    assert {(r.doc_id, r.xd_kept) for r in marks} == {(9, False), (10, True)}


@pytest.mark.parametrize("how", ["add", "filter"])
def test_empty_table(spark, how):
    empty = frame(spark, [])
    index = exact_dedup.DigestIndex(spark, buckets=2)
    index.add(empty)
    got = exact_dedup.mark_copies(empty, index) if how == "add" else exact_dedup.drop_copies(spark, empty)
    assert got.collect() == []


def test_a_bucket_is_one_file_however_many_parts_the_rows_are_dealt_to(spark, monkeypatch):
    from pathlib import Path

    kind = type(spark.range(0))
    for name in ("repartition", "repartitionById"):
        monkeypatch.setattr(kind, name, lambda self, n, *cols, deal=getattr(kind, name): deal(self, max(n, 13), *cols))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    for low, files in ((0, 4), (500, 8)):  # a batch adds a file to each bucket
        index.add(spark.range(low, low + 1000).selectExpr("id AS doc_id", "'t' || id AS text"))
        assert len(list(Path(index.own.removeprefix("file:")).glob("*.parquet"))) == files
    assert sorted(r.keep_id for r in index.rows().collect()) == list(range(1500))
    index.drop()


def test_plan_is_a_sort_merge_anti_join_on_buckets(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(frame(spark, [(1, "a")]))
    fresh = index.candidates(index.digests(frame(spark, [(2, "b")])))
    plan = fresh.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_the_index_lies_in_the_shared_folder_and_goes_on_failure(spark, sf, monkeypatch):
    from pathlib import Path

    from leafloom.llm import queries
    from leafloom.llm.common import shared_dir

    index = exact_dedup.DigestIndex(spark, buckets=2)
    place = Path(f"{shared_dir(spark).removeprefix('file:')}/{index.table}")
    index.add(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id bigint, text string"))
    assert list(place.glob("*.parquet"))
    index.drop()
    assert not place.exists()

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(queries, "stored", fail)
    tables = {t.name for t in spark.catalog.listTables()}
    before = {f.name for f in place.parent.iterdir() if f.name.startswith("digest_index")}
    with pytest.raises(RuntimeError, match="lost"):
        queries.op6_exact_dedup(spark, sf)
    assert {f.name for f in place.parent.iterdir() if f.name.startswith("digest_index")} == before
    assert {t.name for t in spark.catalog.listTables()} == tables
