"""Tables that change in place, sinks that see a batch twice, late rows, registries in files, rules on odd rows."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafloom.functions.text import canonical_json
from leafloom.operators import align, ledger, ordering, rules
from leafloom.operators.keyed import KeyedTable, append_once
from leafloom.streaming import ledger as live

ENTRY = "id string, name string, ord bigint, built_in boolean"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_upsert_replaces_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ENTRY, "id", buckets=8)
    rows = [(f"e{i}", "first", i, False) for i in range(60)] + [("b", "built in", 99, True), (None, "no key", 98, False)]
    table.upsert(spark.createDataFrame(rows, ENTRY))
    want = {f"e{i}": ("first", i + 1) for i in range(60)}
    assert {r.id: (r.name, r.ord) for r in table.rows().collect()} == want
    before = files(tmp_path / "t")
    for _ in range(2):
        patch = spark.createDataFrame([("e7", "second", 2, False), ("new", "second", 1, False), ("e3", "stays", 3, True)], ENTRY)
        table.upsert(patch)
    got = {r.id: (r.name, r.ord) for r in table.rows().collect()}
    assert got["new"][0] == got["e7"][0] == "second" and 60 < got["new"][1] < got["e7"][1] and len(got) == 61
    assert {k: v for k, v in got.items() if k not in ("e7", "new")} == {k: v for k, v in want.items() if k != "e7"}
    after = files(tmp_path / "t")
    touched = {f.split("/")[0] for f in set(before) ^ set(after)}
    assert 1 <= len(touched) <= 2 and sum(f in after for f in before) == len([f for f in before if f.split("/")[0] not in touched])


def test_insert_ignore_writes_new_keys_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id bigint, v string", "id", buckets=4)
    assert table.rows().count() == 0
    table.insert_ignore(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "id bigint, v string"), ["v"])
    assert {tuple(r) for r in table.rows().collect()} == {(1, "a"), (2, "c")}
    before = files(tmp_path / "t")
    table.insert_ignore(spark.createDataFrame([(1, "z"), (2, "z")], "id bigint, v string"))
    assert files(tmp_path / "t") == before
    table.insert_ignore(spark.createDataFrame([(3, "z"), (2, "z")], "id bigint, v string"))
    assert {tuple(r) for r in table.rows().collect()} == {(1, "a"), (2, "c"), (3, "z")}
    assert before.items() <= files(tmp_path / "t").items()
    reads = [line for line in table._stored().where(F.col("bucket").isin([1]))._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert "bucket" in reads[0]  # other buckets aren't read


def test_a_batch_fed_twice_changes_no_file(spark, tmp_path):
    profiles = live.create_profiles(KeyedTable(spark, str(tmp_path / "p"), "user_id bigint, created timestamp_ntz", "user_id", buckets=4))
    sinks = {r: append_once(str(tmp_path / r)) for r in ("payment", "preapproval")}
    route = live.by_route(sinks, append_once(str(tmp_path / "rejected")))
    rows = [(i, i % 5, i % 4 > 0, "payment" if i % 2 else "preapproval") for i in range(20)]
    batch = spark.createDataFrame(rows, "id int, user_id bigint, valid boolean, route string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    for run in (profiles, route):
        run(batch.where("id < 10"), 0)
    once = files(tmp_path)
    for run in (profiles, route):
        run(batch.where("id < 10"), 0)
    assert files(tmp_path) == once
    for run in (profiles, route):
        run(batch.where("id >= 10"), 1)
    assert spark.read.parquet(str(tmp_path / "payment")).count() == sum(v and r == "payment" for _, _, v, r in rows)
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 5
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_late_rows_are_counted(spark, tmp_path):
    schema = "charge_id int, user_id int, ts timestamp"
    put = lambda kind, n, rows: spark.createDataFrame(rows, "a int, b int, t string").select(F.col("a").alias("charge_id"), F.col("b").alias("user_id"), F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/{kind}/part{n}")
    put("charges", 0, [(1, 1, "2024-01-01 10:00:00"), (2, 2, "2024-01-01 10:05:00")])
    put("approvals", 0, [(0, 1, "2024-01-01 10:10:00")])
    late = live.LateRows()
    spark.streams.addListener(late)
    try:
        read = lambda kind: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{kind}/part*")
        rows = live.expire_charges(read("charges"), read("approvals").select("user_id", "ts"))
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).queryName("expiry").start()
        query.processAllAvailable()
        for n, (charges, approvals) in enumerate([([(3, 3, "2024-01-02 10:00:00")], [(0, 9, "2024-01-02 10:00:00")]), ([(4, 4, "2024-01-02 11:00:00")], [(0, 2, "2024-01-01 10:20:00"), (0, 4, "2024-01-02 11:01:00")])], 1):
            put("charges", n, charges)
            put("approvals", n, approvals)
            query.processAllAvailable()
        query.stop()
        for _ in range(50):
            if late.dropped.get("expiry"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert late.dropped["expiry"] == 1
    got = {r.charge_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == "paid" and got[2] == "expired"


def test_registry_files_are_read_whole(spark, tmp_path):
    good = [{"id": "a", "settings": {"k": 1}}, {"id": 5, "settings": {}}, {"id": "b"}, {"id": "c", "settings": None}, {"id": "d", "settings": 0}, {"id": "", "settings": {}}, None, "x", {"id": "e", "settings": [1]}]
    for name, text in [("1.json", json.dumps(good, indent=1)), ("2.json", '{"id":"x","settings":{}}'), ("3.json", "[broken"), ("4.json", "[]"), ("5.json", "")]:
        (tmp_path / name).write_text(text)
    entries, rejected = ledger.read_registry_array_files(spark, str(tmp_path))
    assert sorted((r.file[-6:], r.entry, r.id) for r in entries.collect()) == [("1.json", 1, "a"), ("1.json", 6, ""), ("1.json", 9, "e")]
    assert {r.file[-6:] for r in rejected.collect()} >= {"2.json", "3.json"} and not {r.file[-6:] for r in rejected.collect()} & {"1.json", "4.json"}


def test_permuted_payloads_hash_alike(spark):
    one = {"b": [1, {"z": None, "y": {"é": 1.5, "B": "x"}}], "a": None, "A": True}
    two = {"A": True, "a": None, "b": [1, {"y": {"B": "x", "é": 1.5}, "z": None}]}
    rows = [json.dumps(one), json.dumps(two, indent=2, ensure_ascii=False), '{"a":1,"a":2}', "no", None, "[2, 1]", json.dumps(one | {"a": 0})]
    got = [r.j for r in spark.createDataFrame([(r,) for r in rows], "t string").select(canonical_json(F.col("t")).alias("j")).collect()]
    assert got[0] == got[1] == '{"A":true,"a":null,"b":[1,{"y":{"B":"x","é":1.5},"z":null}]}'
    assert got[2:6] == [None, None, None, "[2,1]"] and got[6] != got[0]


def test_constraints_read_each_table_once(spark, tmp_path):
    for name, rows, schema in [("c", [(1, "x", "a"), (1, "y", None), (2, None, "b"), (None, "z", "b")], "id int, e string, u string"), ("p", [(1,), (1,), (None,)], "k int")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "cp"}
    out = rules.violations(tables, [("c", "e", ["x", "y"])], [("c", "e"), ("c", "id")], [("c", "u"), ("c", "id")], [("c", "id", "p", "k")])
    assert sorted(tuple(r) for r in out.collect()) == [("enum c.e", "z", 1), ("foreign c.id", "2", 1), ("null c.e", None, 1), ("null c.id", None, 1), ("unique c.id", "1", 1), ("unique c.u", "b", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_documents_without_assets_are_errors(spark):
    df = spark.createDataFrame([("a", 1, 1, "r", 9, 9), ("b", 1, 1, None, 1, 9), ("c", 1, 2, None, None, 9)], "doc string, page int, pos int, ref string, width int, height int")
    assert sorted((r.doc, r.number, r.error) for r in rules.asset_inventory(df, 8).collect()) == [("a", 1, None), ("b", None, "no image"), ("c", None, "no image")]


def test_empty_and_missing_arrays(spark):
    df = spark.createDataFrame([(1, [], []), (2, None, []), (3, [1.0], None), (4, [1.0, 2.0], [1.0, 9.0])], "k int, a array<double>, b array<double>")
    assert sorted(tuple(r) for r in rules.array_change_ratio(df, 0.5).collect()) == [(1, 0.0, "unchanged"), (2, 0.0, "unchanged"), (3, 100.0, "modified"), (4, 50.0, "modified")]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_favourites_of_texts_and_numbers(spark, kind):
    rows = [("1", "5", 1, 1), ("1", "6", 2, 2), ("1", "5", 3, 3), (None, "7", 1, 4), (None, None, 2, 5), ("2", "8", 1, 6)]
    df = spark.createDataFrame(rows, "user_id string, item string, ts int, id int").withColumns({c: F.col(c).cast(kind) for c in ("user_id", "item")})
    assert {(str(r.user_id), r.favorites, r.n) for r in rules.favorites_fold(df).collect()} == {("1", "6", 1), ("None", "7", 1), ("2", "8", 1)}


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_items_without_a_key_share_groups(spark, kind):
    rows = [(k, i, s) for k in (None, "1", "2") for i, s in enumerate([60, 60, 30, None, 200, 10])]
    df = spark.createDataFrame(rows, "k string, i int, size bigint").withColumn("k", F.col("k").cast(kind))
    got = {}
    for r in ordering.pack_sequential(df, "k", ["i"], 20, 100).orderBy("i").collect():
        got.setdefault(str(r.k), []).append(r.grp)
    assert len(got) == 3 and set(map(tuple, got.values())) == {(1, 2, 2, 2, 3, 4)}


def test_pages_without_a_document_id_stay(spark):
    one = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (5, 1, "c")], "doc_id int, page_no int, text string")
    got = sorted((r.src_ord, r.src_page, r.text) for r in ordering.append_ordered([one, one]).collect())
    assert got == [(k, i, t) for k in (0, 1) for i, t in enumerate("abc", 1)]


def test_contents_leave_out_pages_that_are_not_there(spark):
    df = spark.createDataFrame([("s", 1, "a", -5, 2), ("s", 2, "b", 0, 2), ("s", 3, "c", 3, 2), ("s", 4, "d", 6, 0), ("s", 5, "e", None, 1), (None, 6, "f", 0, 1)], "source string, doc_id int, title string, first_page bigint, pages int")
    got = sorted((r.title, r.toc_page, r.row, r.shown_page) for r in ordering.table_of_contents(df).collect())
    assert got == [("b", 1, 1, 2), ("c", 1, 2, 5), ("d", 1, 3, 8), ("f", 1, 1, 2)]


def test_a_pair_without_an_id_is_compared_like_others(spark):
    schema = "pair_id string, page_no int, text string"
    a = spark.createDataFrame([(p, i, t) for p in (None, "x") for i, t in enumerate(["first page here", "second page here", "gone page here"], 1)], schema)
    b = spark.createDataFrame([(p, i, t) for p in (None, "x") for i, t in enumerate(["first page here", "second page there"], 1)], schema)
    got = {}
    for r in align.compare_documents(a, b).collect():
        got.setdefault(r.pair_id, []).append((r.page_a, r.page_b, r.status, r.added_words, r.removed_words))
    assert sorted(got[None], key=repr) == sorted(got["x"], key=repr) == [(1, 1, "unchanged", 0, 0), (2, 2, "modified", 1, 1), (3, None, "removed", 0, 3)]
