"""Toxicity by ordinal regression: a cumulative-link model over sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): all thresholds share the weights w, and they are ordered.
The features of a text are the whole words and word beginnings that it holds, so inflected forms of a
stem share weight. Candidate features are counted over the training texts by Spark, the ones that
differ most between grades are kept, and an L1 penalty leaves few with a weight. Scoring is one scan:
an Aho-Corasick automaton of the weighted features runs over each whole text; nothing is shuffled.

The model is fitted on ``SAMPLE_ROWS`` labelled rows at most, chosen by hashes of their ids and texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, row_key, stored, values

#: Bounds of the fit: labelled rows, and features among which the penalty chooses.
SAMPLE_ROWS, MAX_FEATURES = 12_000, 3_000
#: Lengths of word beginnings, and how many sample texts must hold a feature.
PREFIXES, MIN_TEXTS = range(4, 9), 6
#: Toxic texts with so many marked words or more have the next grade.
GRADE_STEPS = (3, 7)
L1, ROUNDS = 1e-4, 400

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(text: str | None) -> str:
    """Lower case, without ASCII punctuation, each word between single spaces."""
    return " " + b" ".join((text or "").lower().encode().translate(None, _PUNCTUATION).split()).decode() + " "


def features_of(text: str) -> set[str]:
    """All candidate features of a plain text: " word " and " beginning"."""
    out: set[str] = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return out


class Matcher:
    """Which features a plain text holds, as sorted numbers."""

    def __init__(self, features: list[str]):
        self.features = features
        self.automaton = ahocorasick.Automaton()
        for i, f in enumerate(features):
            self.automaton.add_word(f, i)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        if not self.features:
            return []
        return sorted({i for _, i in self.automaton.iter(text)})

    def __reduce__(self):
        return Matcher, (self.features,)


@dataclass
class OrdinalModel:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def compact(self) -> OrdinalModel:
        keep = np.flatnonzero(self.weights)
        return OrdinalModel([self.features[i] for i in keep], self.weights[keep], self.thresholds)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(eta)[:, None], -500, 500)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[list[int]], grades: np.ndarray, features: list[str], *, l1: float = L1, rounds: int = ROUNDS) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty by accelerated proximal gradient steps. ``rows`` has the
    features each text holds, ``grades`` numbers from 0. A feature's step is set by the largest
    curvature of its texts, so no line search is needed."""
    n, f, top = max(len(rows), 1), len(features), int(grades.max(initial=0))
    if top == 0:
        return OrdinalModel(features, np.zeros(f), np.array([50.0]))  # nothing but the lowest grade was seen
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.empty(0, np.int64)])
    size = np.array([len(r) + 1 for r in rows], float)
    step = 1 / np.maximum(0.25 * np.bincount(col, size[text], minlength=f) / n, 1e-6)
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    theta, w = np.log(share / (1 - share)), np.zeros(f)
    ahead_w, ahead_t, t = w, theta, 1.0
    step_t = 1 / (0.5 * size.mean())
    for _ in range(rounds):
        eta = np.bincount(text, ahead_w[col], minlength=len(rows))
        edge = np.concatenate([[-np.inf], ahead_t, [np.inf]])
        high, low = _sigmoid(edge[grades + 1] - eta), _sigmoid(edge[grades] - eta)
        p = np.maximum(high - low, 1e-9)
        slope = (1 - high - low) / n  # of the loss by eta
        grad_t = np.zeros(top + 2)
        np.add.at(grad_t, grades + 1, -high * (1 - high) / p / n)
        np.add.at(grad_t, grades, low * (1 - low) / p / n)
        new_w = ahead_w - step * np.bincount(col, slope[text], minlength=f)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_t = np.maximum.accumulate(ahead_t - step_t * grad_t[1 : top + 1])
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_t = new_w + (t - 1) / t_next * (new_w - w), np.maximum.accumulate(new_t + (t - 1) / t_next * (new_t - theta))
        w, theta, t = new_w, new_t, t_next
    return OrdinalModel(features, w, theta)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(values(batch.column("text")), values(batch.column("toxic"))):
            found[int(toxic > 0)].update(features_of(plain(text)))
    both = list(found[0].keys() | found[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[x] for x in both], pa.int64()) for c in found)], ["feature", "n0", "n1"])


def _encode(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Matcher = matcher.value
        for batch in batches:
            held = [own(plain(t)) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], ["toxic", "held"])

    return run


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES,
) -> OrdinalModel:
    """Fit a model to labelled texts. Labels of 0 are the lowest grade. If higher labels differ among
    themselves they are the grades; with a single one (0 and 1), its texts are graded by the number of
    features they hold that stand almost only in labelled texts (``GRADE_STEPS``).

    With 0 and 1 the higher grades, and so the severity above 1, are told by the model's own features:
    they order texts by how many marked words they hold, and are no evidence of severity from outside.

    Null labels and ids are left out; an id with several labels takes the largest; rows that repeat id
    and text count once; ``sample_rows`` rows are used at most, by a hash of id and text. Without
    labelled texts, or with labels of one kind only, the model finds nothing toxic.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic >= 0")
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    # An id may stand on many rows: equal ones count once, and of all others the bound holds as well.
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    met = stored(spark, met.select(F.xxhash64("id", "text").alias("h"), "text", "toxic"), "toxicity-labelled")
    rows = met.select("h").distinct().orderBy("h").limit(sample_rows)
    sample = stored(spark, met.join(F.broadcast(rows), "h").dropDuplicates(["h"]).select("text", "toxic").repartition(8), "toxicity-sample")
    discard(met)
    total = {r.t: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(total.get(False, 0)), float(total.get(True, 0))
    if not n0 or not n1:
        return OrdinalModel([], np.zeros(0), np.array([50.0]))
    counts = sample.mapInArrow(_count, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    mean = (F.col("a") + F.col("b")) / (n0 + n1)
    z = (F.col("b") / n1 - F.col("a") / n0) / F.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1) + 1e-12)
    best = counts.where(F.col("a") + F.col("b") >= MIN_TEXTS).withColumn("z", z).orderBy(F.abs("z").desc(), "feature").limit(max_features).collect()
    matcher = Matcher([r.feature for r in best])
    marks = np.array([r.z > 0 and r.a / n0 <= 0.05 * r.b / n1 for r in best], bool)
    rows = sample.mapInArrow(_encode(spark.sparkContext.broadcast(matcher)), "toxic int, held array<int>").collect()  # sample_rows rows at most
    discard(sample)
    held, toxic = [r.held for r in rows], np.array([r.toxic for r in rows])
    if toxic.max() > 1:
        kinds = np.unique(np.concatenate([[0], toxic]))
        grades = np.searchsorted(kinds, toxic)
    else:
        words = np.array([len({matcher.features[i].strip()[:4] for i in h if marks[i]}) for h in held])
        grades = np.where(toxic > 0, 1 + sum((words >= s).astype(int) for s in GRADE_STEPS), 0)
        grades = np.searchsorted(np.unique(grades), grades)
    return fit(held, grades, matcher.features).compact()


def _score(model, matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, find = model.value, matcher.value
        for batch in batches:
            eta = np.array([m.weights[find(plain(t))].sum() for t in values(batch.column("text"))])
            above = m.above(eta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(above.sum(axis=1)), pa.array(1 + (above[:, 1:] >= 0.5).sum(axis=1) - (above[:, 0] < 0.5), pa.int32()), pa.array(above[:, 0])],
                ["row", "severity", "grade", "p_toxic"],
            )

    return run


def score(spark: SparkSession, docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (its key: id and hash of its text), ``severity`` (expected
    grade), ``grade`` (the highest one that is at least as likely reached as not) and ``p_toxic``
    (probability of a grade above the lowest). A null or empty text scores like one without features;
    repeated rows and null ids are rows of their own; an empty table gives an empty table."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(row_key("id", "text").alias("row"), "text")
    sc = spark.sparkContext
    run = _score(sc.broadcast(model), sc.broadcast(Matcher(model.features)))
    return texts.mapInArrow(run, "row struct<id:bigint,text:bigint>, severity double, grade int, p_toxic double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_p: float = 0.5) -> DataFrame:
    """``docs`` with its columns, without the rows that are toxic with a probability over ``max_p``, told in
    the scan: nothing is joined.

    Defined cases: as for ``train`` and ``score``; a row with a null or empty text scores like one without
    features; rows that repeat go or stay alike; columns of any name stay as they are; with empty labels
    all rows stay.
    """
    model = train(spark, docs, labels, id_col=id_col, text_col=text_col)
    held, matcher = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(Matcher(model.features))

    @F.arrow_udf("double")
    def p_toxic(texts: pa.Array) -> pa.Array:
        m, find = held.value, matcher.value
        eta = np.array([m.weights[find(plain(t))].sum() for t in values(texts)], float)
        return pa.array(m.above(eta)[:, 0])

    return docs.where(p_toxic(F.col(text_col)) <= max_p)
