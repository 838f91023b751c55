"""The pipeline: each stage on what the one before kept, against the operators' brute-force forms."""

import pytest

import corpus_pipeline
from leafloom.llm import decontaminate as dc
from leafloom.llm import toxicity
from leafloom.llm.common import LOWER_BYTES, stored
from leafloom.llm.shingles import word_hashes
from tests.llm.test_minhash import brute as near_groups


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(spark, stage(spark, out[-1], sf), "test-stage"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity_drops_what_the_model_rejects(spark, sf, steps):
    model = toxicity.train(spark, steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.row.id for r in toxicity.score(spark, steps[0], model).collect() if r.p_toxic > 0.5}
    assert set(texts(steps[1])) == set(texts(steps[0])) - bad


def test_exact_copies(steps):
    best = {}
    for d, t in texts(steps[1]).items():
        best[t.encode().translate(LOWER_BYTES)] = max(d, best.get(t.encode().translate(LOWER_BYTES), -1))
    assert set(texts(steps[2])) == set(best.values())


def test_near_copies(steps):
    assert set(texts(steps[3])) == {d for d, _, c in near_groups(list(texts(steps[2]).items()), 80) if d == c}


def test_leaks(spark, sf, steps):
    items = [dc.plain_words(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hashed = [word_hashes(ws) for ws in items if len(ws) >= 8]
    leaked = set()
    for d, t in texts(steps[3]).items():
        own = word_hashes(dc.plain_words(t.encode()))
        if any(dc.align(h, own)[0] >= 0.5 * dc.MATCH * len(h) for h in hashed):
            leaked.add(d)
    assert set(texts(steps[4])) == set(texts(steps[3])) - leaked


def test_run_is_the_stages_in_order(spark, sf, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, steps[-1].collect()))


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, sf, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(rows) == (empty != "documents")
    if empty == "labels":  # nothing is toxic
        docs = corpus_pipeline.reject_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert docs.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    if empty == "benchmark":  # nothing is leaked
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).count() == docs.count()
