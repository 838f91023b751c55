"""The ordinal model against its definition, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from leafloom.llm import toxicity as tx

LABELS = "doc_id bigint, quality int, toxic int, text string"


def loss(model_w, theta, rows, grades, l1):
    eta = np.array([model_w[r].sum() for r in rows])
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    p = sig(edge[grades + 1] - eta) - sig(edge[grades] - eta)
    return -np.log(np.maximum(p, 1e-12)).mean() + l1 * np.abs(model_w).sum()


def test_fit_is_a_minimum_of_the_penalised_loss():
    rnd = np.random.default_rng(2)
    rows = [sorted(rnd.choice(12, rnd.integers(0, 5), replace=False).tolist()) for _ in range(800)]
    true = np.array([3.0, -2.0, 1.0] + [0.0] * 9)
    eta = np.array([true[r].sum() for r in rows]) + rnd.logistic(size=800)
    grades = np.searchsorted([0.0, 2.0], eta)
    m = tx.fit(rows, grades, [str(i) for i in range(12)], l1=1e-3, rounds=1500)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] > 1.5 and m.weights[1] < -1
    best = loss(m.weights, m.thresholds, rows, grades, 1e-3)
    for _ in range(40):
        near_w, near_t = m.weights + rnd.normal(0, 0.05, 12), m.thresholds + rnd.normal(0, 0.05, 2)
        assert loss(near_w, np.sort(near_t), rows, grades, 1e-3) >= best - 1e-4


def test_expected_severity_sums_the_thresholds():
    above = tx.OrdinalModel([], np.zeros(0), np.array([0.0, 1.0])).above(np.array([0.0]))
    assert np.allclose(above[0], [0.5, 1 / (1 + np.e)])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = tx.train(spark, docs, labels.where("doc_id % 4 <> 0"))
    held = tx.score(spark, docs, model).select(F.col("row.id").alias("doc_id"), "p_toxic", "severity").join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = [(r.toxic, r.p_toxic > 0.5, r.severity) for r in held.collect()]
    toxic, clean = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    assert sum(r[1] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r[1] for r in clean) <= 0.01 * len(clean)
    assert np.mean([r[2] for r in toxic]) > 1 > np.mean([r[2] for r in clean])


def test_odd_rows_and_filter(spark):
    rows = [(i, f"plain words here {i} " + ("vilest vile " if i % 3 == 0 else "kind ") * (1 + i % 4), "x", 0.0, 5) for i in range(90)]
    rows += [(100, None, None, None, None), (101, "", "", 1.0, 1), (None, "so vile", "y", 2.0, 2), (3, rows[3][1], "x", 0.0, 5), (102, "vilest vile " + "plain words here " * 40000, "z", 0.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, severity double, row int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "clash") for i in range(80)] + [(None, 1, 1, ""), (5, None, None, ""), (4, 1, 0, "")], LABELS)
    model = tx.train(spark, docs, labels)
    got = tx.score(spark, docs, model).collect()
    assert len(got) == len(rows)
    assert {r.row.id for r in got if r.p_toxic > 0.5} == {i for i in range(90) if i % 3 == 0} | {None, 102}
    left = tx.drop_toxic(spark, docs, labels)
    assert left.columns == docs.columns
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i in range(90) if i % 3] + [100, 101])


def test_given_grades_are_used(spark):
    words = ["fine", "rude", "nasty", "awful"]
    docs = spark.createDataFrame([(i, f"{words[i % 4]} text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(200)], "doc_id bigint, toxic int")
    model = tx.train(spark, docs, labels)
    mean = {w: 0.0 for w in words}
    for r in tx.score(spark, docs, model).collect():
        mean[words[r.row.id % 4]] += r.severity / 50
    assert mean["fine"] < mean["rude"] < mean["nasty"] < mean["awful"]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tx.score(spark, docs, tx.train(spark, docs, labels)).collect() == []
    row = [(1, "some text")]
    assert tx.drop_toxic(spark, spark.createDataFrame(row, "doc_id bigint, text string"), labels).count() == 1


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """An id on thousands of rows, equal and different ones: no more rows than asked for are fitted."""
    rows = [(1, f"vile text {i % 700}") for i in range(5001)] + [(i, f"kind words {i}") for i in range(2, 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 120)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(tx, "fit", lambda held, grades, features, **how: seen.append(len(held)) or tx.OrdinalModel([], np.zeros(0), np.array([50.0])))
    tx.train(spark, docs, labels, sample_rows=119)
    assert seen == [119]
