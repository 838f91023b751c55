"""Leaks against a full alignment of every text with every item."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from leafloom.llm import decontaminate as dc
from leafloom.llm.common import PIECE_ROWS, values
from leafloom.llm.shingles import ngrams, word_hashes

DOCS = "doc_id bigint, text string, item int, row string, score double"


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def brute(docs, items, min_score=0.5):
    out = set()
    for d, t in docs:
        ws = dc.plain_words((t or "").encode())
        for i, x in items:
            own = dc.plain_words((x or "").encode())
            phrase = any(ws[k : k + len(own)] == own for k in range(len(ws) - len(own) + 1))
            if own and (phrase if len(own) < 8 else slow_align(own, ws) / (dc.MATCH * len(own)) >= min_score):
                out.add((d, i))
    return out


def test_align_is_smith_waterman():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ([rnd.choice("abcd").encode() for _ in range(rnd.randrange(1, 14))] for _ in range(2))
        assert dc.align(word_hashes(a), word_hashes(b))[0] == slow_align(a, b)


def chosen(words, held, windows):
    """{place: length of its seed} in one item, given in how many documents each run of it is."""
    seeds = dc.Seeds([[w.encode() for w in words]], 8, 3, 0.5, 8)
    counts = []
    for size, table in enumerate(seeds.tables, 1):
        of = {h: held(k, size) for k, h in enumerate(ngrams(seeds.items[0], size).tolist())}
        counts.append(np.array([of[h] for h in table.hash.tolist()]))
    limit = seeds.choose(counts, windows)
    return limit, {int(p): t.size for t in seeds.tables for p in seeds.place[t.own]}


def test_a_seed_is_the_shortest_rare_run_of_its_place():
    """a to f are common words and the pairs from a, b and c are; the seeds keep to their budget."""
    held = lambda place, size: 90 if size == 1 and place < 6 or size == 2 and place < 3 else 1
    assert chosen("abcdefghij", held, 50) == (88, {0: 3, 1: 3, 2: 3, 3: 2, 4: 2, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1})
    assert chosen("abcdefghij", held, 6 * 89) == (89, dict.fromkeys(range(10), 1))


def test_a_part_that_many_texts_hold_has_no_seed_and_an_item_that_many_copy_has():
    words = [f"w{k}" for k in range(30)]
    part = lambda place, size: 400 if place + size <= 12 else 1
    # From places 5 to 11 a run of 8 words leaves the common part.
    assert chosen(words, part, 20)[1] == {**{k: 13 - k for k in range(5, 12)}, **dict.fromkeys(range(12, 30), 1)}
    assert chosen(words, lambda place, size: 400, 20)[1] == dict.fromkeys(range(30), 1)
    with_the = lambda place, size: 5000 if place == 3 and size == 1 else 400
    assert chosen(words, with_the, 20)[1] == {**dict.fromkeys(range(30), 1), 3: 2}


def test_walks_find_all_runs():
    """The places of every run, against a search of the words themselves; also where one ends with its text."""
    rnd = random.Random(8)
    item = [rnd.choice("abc").encode() for _ in range(12)]
    texts = [[rnd.choice("abcd").encode() for _ in range(rnd.randrange(0, 30))] for _ in range(40)]
    seeds = dc.Seeds([item], 8, 3, 0.5, 8)
    words, ends = word_hashes([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])
    own = {size: {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} for size in range(1, 9)}
    for table, at, _ in dc.walk(seeds.tables, words, ends):
        first = [0, *ends.tolist()]
        assert at.tolist() == [first[i] + k for i, t in enumerate(texts) for k in range(len(t) - table.size + 1) if tuple(t[k : k + table.size]) in own[table.size]]


def test_edited_copies_of_an_item_that_many_texts_copy(spark):
    """A third of the texts hold a copy of one item, each with other edits; common words stand in all."""
    rnd = random.Random(21)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    item, docs = text(36), []
    for k in range(450):
        body = text(rnd.randrange(5, 25))
        if k % 3 == 0:
            own = [w for w in item if rnd.random() > 0.08]
            body[3:3] = [rnd.choice(vocab) if rnd.random() < 0.12 else w for w in own]
        docs.append((k, " ".join(body)))
    tests = [(1, " ".join(item))]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    found = {(r.row.id, r.item_id) for r in dc.find_leaks(spark, frame, bench).collect()}
    assert len(found) > 130 and found == brute(docs, tests)


def test_short_items_are_found_as_whole_phrases(spark):
    docs = spark.createDataFrame([(1, "Say: the answer is Paris."), (2, "the answer was Paris"), (3, "paris"), (4, "the answer is"), (5, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "The answer is Paris"), (2, "Paris?"), (3, "...")], "item_id bigint, text string")
    got = {(r.row.id, r.item_id, r.score, r.end_word) for r in dc.find_leaks(spark, docs, bench).collect()}
    assert got == {(1, 1, 1.0, 5), (1, 2, 1.0, 5), (2, 2, 1.0, 4), (3, 2, 1.0, 1)}
    assert {r.doc_id for r in dc.drop_leaks(spark, docs, bench).collect()} == {4, 5}


def test_rare_words_are_seeds_where_no_run_is_left(spark):
    """Every third word of a copy is changed, so no three stand in a row; most words are in no other text."""
    item = [f"w{k}" for k in range(30)]
    copy = [w if k % 3 < 2 else "x" for k, w in enumerate(item)]
    docs = [(i, f"plain words {i} ") for i in range(2000)] + [(5000, " ".join(copy))]
    found = dc.find_leaks(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r.row.id, r.score) for r in found] == [(5000, slow_align(item, copy) / 60)]


def test_runs_of_a_single_text_are_rare_in_a_corpus_of_any_size(spark):
    item = [f"w{k}" for k in range(30)]
    copy = [w if k % 3 < 2 else "x" for k, w in enumerate(item)]
    for others in (0, 3, 40):
        docs = [(i, f"plain words {i}") for i in range(others)] + [(5000, " ".join(copy))]
        found = dc.find_leaks(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
        assert [(r.row.id, r.score) for r in found] == [(5000, slow_align(item, copy) / 60)]


def test_edited_copies_are_found_and_others_left(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(500)] + ["the", "of", "and"] * 100
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(rnd.randrange(15, 50))) for i in range(12)]
    docs = []
    for k in range(60):
        body = text(rnd.randrange(0, 150))
        if k % 3 == 0:
            own = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(0, 8)):
                p = rnd.randrange(len(own))
                rnd.choice([lambda: own.pop(p), lambda: own.insert(p, "new"), lambda: own.__setitem__(p, "other")])()
            at = rnd.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((k, " ".join(body).capitalize() + "."))
    docs += [(100, None), (101, ""), (102, "the " * 5000), (103, " ".join(items[0][1])), (None, " ".join(items[1][1])), (103, " ".join(items[0][1]))]
    tests = [(i, " ".join(ws)) for i, ws in items] + [(50, None), (51, "much too short"), (52, "w1 the w2"), (None, "a b c d e f g h i j")]
    frame = spark.createDataFrame([(d, t, 1, "x", 0.5) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "y") for i, t in tests], "item_id bigint, text string, row string")
    found = dc.find_leaks(spark, frame, bench).collect()
    assert {(r.row.id, r.item_id) for r in found} == brute(docs, tests)
    assert next(r.score for r in found if r.row.id == 103 and r.item_id == 0) == 1.0
    left = dc.drop_leaks(spark, frame, bench)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in brute(docs, tests)}


def test_copies_with_many_edits_are_found(spark):
    """Copies of which a fifth to a third of the words are edited, first and last ones too, none exact."""
    rnd = random.Random(11)
    items = [(i, [f"i{i}w{k}" for k in range(rnd.randrange(15, 60))]) for i in range(40)]
    spread = [f"s{k}" for k in range(40)]
    late = [f"l{k}" for k in range(20)]
    docs = []
    for i, ws in items:
        own = list(ws)
        for p in sorted(rnd.sample(range(len(own)), round(len(own) * rnd.uniform(0.2, 0.33))), reverse=True):
            rnd.choice([lambda: own.pop(p), lambda: own.insert(p, "new"), lambda: own.__setitem__(p, "other")])()
        docs.append((i, " ".join(["before"] * 70 + own + ["after"] * 70)))
    docs.append((100, " ".join(w + " new" * (k % 3 == 2) for k, w in enumerate(spread))))
    docs.append((101, " ".join(w + " new" * (k < 16) for k, w in enumerate(late))))
    tests = [(i, " ".join(ws)) for i, ws in [*items, (100, spread), (101, late)]]
    found = dc.find_leaks(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")).collect()
    assert {(r.row.id, r.item_id) for r in found} == brute(docs, tests)
    plain = {i: (dict(docs)[i].split(), dict(tests)[i].split()) for i in dict(docs)}
    assert {r.row.id: r.score for r in found} == {r.row.id: slow_align(plain[r.row.id][1], plain[r.row.id][0]) / (2 * len(plain[r.row.id][1])) for r in found}


def test_reach_is_never_below_the_alignment():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = (word_hashes([rnd.choice("abcdefgh").encode() for _ in range(rnd.randrange(1, 20))]) for _ in range(2))
        assert dc.reach(a.tolist(), set(b.tolist())) >= dc.align(a, b)[0]


@pytest.mark.parametrize("docs, tests", [([], [(1, "a b c d e f g h i")]), ([(1, "a b c d e f g h i")], [])])
def test_empty_tables(spark, docs, tests):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert dc.find_leaks(spark, frame, spark.createDataFrame(tests, "item_id bigint, text string")).collect() == []


def test_blocks_of_items_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.row.id, r.item_id) for r in dc.find_leaks(spark, docs, bench).collect()}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 500)
    monkeypatch.setattr(dc, "PACK_WORDS", 300)
    assert whole and {(r.row.id, r.item_id) for r in dc.find_leaks(spark, docs, bench).collect()} == whole
    assert np.isfinite(len(whole))


def test_values_are_those_of_the_whole_column():
    texts = [None if k % 7 == 0 else f"t{k}" for k in range(2 * PIECE_ROWS + 3)]
    assert list(values(pa.array(texts))) == texts and list(values(pa.array(texts).slice(5, 300))) == texts[5:305]
    assert list(values(pa.array([], pa.string()))) == []


def test_a_large_batch_is_counted_in_little_memory():
    """A million words in a batch; its texts as one pack would take over 100 MB beside it."""
    item = [f"w{k}".encode() for k in range(40)]
    batch = pa.record_batch({"text": [" ".join(f"w{(i * k) % 5000}" for k in range(2000)) for i in range(500)]})
    seeds = dc.Seeds([item], 8, 3, 0.5, 8)
    assert sum(t.hash.nbytes + t.sieve.nbytes for t in seeds.tables) < 200_000
    tracemalloc.start()
    try:
        counts = list(dc._count(SimpleNamespace(value=seeds.tables))(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
    held = {(r["length"], r["run"]): r["n"] for c in counts for r in c.to_pylist()}
    texts, (single, pair) = [t.split() for t in batch.column("text").to_pylist()], seeds.tables[:2]
    assert held[0, 0] == len(texts)
    for number, h in enumerate(single.hash.tolist()):
        word = item[ngrams(seeds.items[0], 1).tolist().index(h)].decode()
        assert held[1, number] == sum(word in t for t in texts)
    for number, h in enumerate(pair.hash.tolist()):
        at = ngrams(seeds.items[0], 2).tolist().index(h)
        two = (item[at].decode(), item[at + 1].decode())
        assert held.get((2, number), 0) == sum(two in zip(t, t[1:]) for t in texts)


def test_a_sieve_turns_away_no_run():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 5000, 100_000):
        own = rng.integers(0, 2**64, n, dtype=np.uint64)
        runs, asked = dc.Runs(1, own), np.concatenate([own, rng.integers(0, 2**64, 1000, dtype=np.uint64)])
        which, number = runs.find(asked)
        assert which.tolist() == np.flatnonzero(np.isin(asked, own)).tolist() and (runs.hash[number] == asked[which]).all()
        assert len(runs.sieve) <= min(2**22, max(2, 128 * n))
