"""Near duplicates against brute force over all pairs."""

import random

import pytest

from leafloom.llm import minhash
from leafloom.llm.common import LOWER_BYTES

SCHEMA = "doc_id bigint, text string, row string, key int, n int, sig string"


def shingles(text, size=5):
    ws = (text or "").encode().translate(LOWER_BYTES).split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(spark, rows, percent):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], SCHEMA)
    out = minhash.near_duplicates(spark, docs, percent=percent)
    return sorted(((r.row.id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)


def test_match_threshold_grows_with_similarity():
    assert 1 <= minhash.match_threshold(32, 0.8) < minhash.match_threshold(32, 0.85) < 32


def test_against_brute_force_on_edited_copies(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([4, 60, 200]))]
        for _ in range(rnd.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (None, rows[0][1]), (7, rows[7][1]), (8, "a B c"), (900, "A b\nc")]
    for percent in (80, 85):
        assert found(spark, rows, percent) == brute(rows, percent)


@pytest.mark.parametrize("bound, value", [("BLOCK", 40), ("BLOCK_SHINGLES", 3000)])
def test_blocks_of_one_large_group(spark, monkeypatch, bound, value):
    """A posting of several blocks, dealt to pairs of blocks."""
    monkeypatch.setattr(minhash, bound, value)
    rnd = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randrange(0, 5)):
            own[rnd.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(own)))
    assert found(spark, rows, 80) == brute(rows, 80)


def test_given_table_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 80)
    assert found(spark, rows, 80) == want
    left = minhash.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, c in want if d == c)


def test_empty_table(spark):
    assert found(spark, [], 80) == []
