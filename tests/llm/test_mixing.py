"""The mixture against its definition, recomputed source by source."""

import math
from collections import defaultdict

import pytest

from leafloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, tokens string, weight int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 1, "y") for d, t, s in rows], SCHEMA)


def check(rows, got, budget, min_entropy, max_repeats):
    """Recomputes weights and walks each permutation; returns the exponent that explains the weights."""
    words = lambda t: len((t or "").encode().split())
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += words(t)
    tokens = {s: n for s, n in tokens.items() if n}
    weight = {r.source: r.weight for r in got}
    total = sum(tokens.values())
    x = 1.0
    if len(weight) > 1:
        a, b = max(tokens, key=tokens.get), min(tokens, key=tokens.get)
        if tokens[a] != tokens[b]:
            x = math.log(weight[a] / weight[b]) / math.log(tokens[a] / tokens[b])
    z = sum((n / total) ** x for n in tokens.values())
    for s, n in tokens.items():
        assert weight.get(s, 0) == pytest.approx((n / total) ** x / z, rel=1e-6)
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        by[r.source][r.block].append((r.place, r.doc_id, r.tokens))
    for s, n in tokens.items():
        own = sorted((d, words(t)) for d, t, src in rows if src == s)
        whole, rest = divmod(math.floor(weight[s] * budget + 1e-6), n)
        for block in range(whole):
            assert sorted((d, k) for _, d, k in by[s][block]) == own
        last = sum(k for _, _, k in by[s][whole])
        assert last <= rest + 1e-6
        assert not last or last > rest - max(k for _, k in own) - 1e-6  # no more than one document is missing
        assert set(by[s]) <= set(range(whole + 1))
    return x, -sum(w * math.log(w) for w in (weight[s] for s in tokens)), max(weight[s] * budget / n for s, n in tokens.items())


ROWS = [(i, "w " * (1 + i % 9), "big" if i % 10 < 7 else f"s{i % 10}") for i in range(900)]


@pytest.mark.parametrize("budget, entropy, repeats, ranges", [(None, 0.95, 4.0, 50), (12_000, 0.99, 2.0, 5000), (600, 0.2, 1.1, 7)])
def test_mixture(spark, budget, entropy, repeats, ranges):
    got = mixing.mix_sources(spark, frame(spark, ROWS), budget=budget, min_entropy=entropy, max_repeats=repeats, range_rows=ranges).collect()
    total = sum(len(t.split()) for _, t, _ in ROWS)
    x, h, most = check(ROWS, got, budget or total, entropy, repeats)
    if (budget or total) > repeats * total:
        assert x == pytest.approx(1)
    else:
        met = h >= entropy * math.log(4) - 1e-3 and most <= repeats + 1e-3
        at_limit = most == pytest.approx(repeats, abs=1e-2)
        assert met or at_limit


@pytest.mark.parametrize("entropy, repeats", [(0.95, 4.0), (0.99, 4.0), (0.5, 4.0), (0.999, 1.3), (0.95, 1.05)])
def test_the_exponent_is_the_largest_that_meets_the_entropy(spark, entropy, repeats):
    """Found here by a plain search over the curve: entropy falls and repetition falls as it rises."""
    tokens = {"a": 70_000, "b": 9_000, "c": 4_000, "d": 900}
    total = sum(tokens.values())

    def at(x):
        z = sum((n / total) ** x for n in tokens.values())
        w = {s: (n / total) ** x / z for s, n in tokens.items()}
        return -sum(v * math.log(v) for v in w.values()), max(w[s] * total / n for s, n in tokens.items())

    grid = [i / 100_000 for i in range(100_001)]
    by_entropy = max((x for x in grid if at(x)[0] >= entropy * math.log(len(tokens))), default=0.0)
    by_repeats = min((x for x in grid if at(x)[1] <= repeats), default=1.0)
    sources = spark.createDataFrame(list(tokens.items()), "k string, tokens bigint")
    assert mixing.solve_exponent(spark, sources, total, entropy, repeats) == pytest.approx(max(by_entropy, by_repeats), abs=2e-5)


def test_the_last_block_follows_its_permutation(spark):
    rows = [(i, "w w w", "a") for i in range(1000)]
    got = mixing.mix_sources(spark, frame(spark, rows), budget=1500, range_rows=20).collect()
    other = mixing.mix_sources(spark, frame(spark, rows), budget=3000, range_rows=500).collect()
    order = [r.doc_id for r in sorted(other, key=lambda r: r.place) if r.block == 0]
    assert sorted(r.doc_id for r in got) == sorted(order[:500])


def test_odd_rows(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, None, "s"), (2, "", "empty"), (3, "x\ty\nz", None), (4, "q " * 50_000, None)]
    got = mixing.mix_sources(spark, frame(spark, rows), min_entropy=0.0).collect()
    assert {r.source for r in got} == {"s", None}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.tokens) for r in got) == [(False, 1, 0), (False, 3, 3), (False, 4, 50_000), (True, 0, 2), (True, 0, 2)]
    assert mixing.mix_sources(spark, frame(spark, [])).collect() == []


def test_native(spark):
    plan = mixing.mix_sources(spark, frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
