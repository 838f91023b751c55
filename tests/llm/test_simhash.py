"""Fingerprints, edited texts and links against plain loops over all pairs."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from leafloom.llm import simhash
from leafloom.llm.common import LOWER_BYTES

SCHEMA = "doc_id bigint, text string, part int, side string, k int, fingerprint string, n_near int"


def plain_print(text):
    votes = np.zeros(256)
    for word, n in Counter(text.encode().translate(LOWER_BYTES).split()).items():
        drawn = xxhash.xxh3_128_digest(word, seed=0) + xxhash.xxh3_128_digest(word, seed=1)
        weight = np.rint(16 * (1 + np.log(np.float32(n))))
        votes += [weight if drawn[i // 8] >> (7 - i % 8) & 1 else -weight for i in range(256)]
    return sum(1 << (255 - i) for i in range(256) if votes[i] > 0)


def brute(rows, radius=7):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""] + [1]))
    texts = [t or "" for _, t in order]
    prints = [plain_print(t) for t in texts]
    apart = lambda a, b: (a ^ b).bit_count()
    near = [[j for j in range(len(order)) if j != i and prints[i] and prints[j] and apart(prints[i], prints[j]) <= radius] for i in range(len(order))]
    out = []
    for i, (doc_id, _) in enumerate(order):
        after = (i + 1) % len(order)
        n = len(texts[i]) // 3
        new = texts[i][: len(texts[i]) - n] + texts[after][:n]
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [order[j][0] for j in seen if order[j][0] is not None]
        out.append(
            (doc_id, len(texts[i]), sha256(new.encode()).hexdigest(), f"{prints[i]:064x}", f"{plain_print(new):064x}", 1 - apart(prints[i], plain_print(new)) / 256,
             1 - apart(prints[i], prints[after]) / 256, min(ids) if ids else None, len(near[i]))
        )
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, 1, "s", 2, "f", 3) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.fingerprint_documents(spark, docs, **how).collect()), key=repr)


def copies(rnd, n, words, changed):
    """A text of ``words`` words and copies with one word of it changed, each another one."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    return [" ".join(base)] + [" ".join(base[:i] + [f"x{rnd.randrange(10**6)}"] + base[i + 1 :]) for i in (rnd.randrange(words) for _ in range(changed))][: n - 1]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["Alpha", "beta", "GAMMA", "naïve", "漢字", "🙂"]) for _ in range(rnd.randrange(0, 50))) for _ in range(60)]
    texts += copies(rnd, 40, 300, 39) + [None, "", " \n ", "one", "two words"] * 2
    rows = [(i if i % 13 else None, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (5, "thrice"), (-3, texts[70]), (900, texts[61])]
    want = brute(rows)
    assert any(r[-1] > 5 for r in want) and any(r[-2] != r[0] for r in want)
    assert found(spark, rows) == want


def test_single_and_empty(spark):
    assert found(spark, [(4, "abcdef")]) == brute([(4, "abcdef")])
    assert found(spark, [(4, None)])[0][1:3] == (0, sha256(b"").hexdigest())
    assert found(spark, []) == []


@pytest.mark.parametrize("keyed", [1, 9])
def test_blocks_of_a_frequent_key_lose_no_link(spark, monkeypatch, keyed):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(2)
    rows = list(enumerate(copies(rnd, 120, 400, 119) + copies(rnd, 30, 200, 29)))
    if keyed == 1:
        assert found(spark, rows) == brute(rows)
    else:  # ten blocks don't cut 32 bytes evenly
        with pytest.raises(ValueError, match="whole bytes"):
            found(spark, rows, radius=1, keyed=9)


def test_tables_of_two_blocks(spark):
    rnd = random.Random(3)
    rows = list(enumerate(copies(rnd, 60, 900, 59)))
    assert found(spark, rows, radius=2, keyed=2) == brute(rows, radius=2)


def test_pairs_count_once_over_all_tables():
    rnd = np.random.default_rng(4)
    prints = np.repeat(rnd.integers(0, 256, (5, 32), dtype=np.uint8), 12, axis=0)
    for row in prints:
        for bit in rnd.integers(0, 256, 4):
            row[bit // 8] ^= 1 << (bit % 8)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= 6}
    seen = defaultdict(int)
    for table in range(28):  # 8 blocks, 2 of them keyed
        for i, j in zip(*simhash.near_pairs(prints, None, 6, 8, 2, table)):
            seen[int(i), int(j)] += 1
    assert set(seen) == want and set(seen.values()) == {1}


def test_edits_stay_nearer_than_strangers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.fingerprints(spark, docs).where("n_chars > 20").select("near_edited", "near_next").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)
