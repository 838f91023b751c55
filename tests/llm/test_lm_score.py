"""Scores against brute force: plain counts, and all segmentations spelled out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from leafloom.llm import lm_score
from leafloom.llm.queries import VOCABULARY
from leafloom.llm.shingles import words


def spelled(lattice, s):
    """Summed probability of all segmentations, by recursion over the first piece."""
    if not s:
        return 1.0
    return sum(math.exp(sum(lattice.logp[p] for p in own)) * spelled(lattice, s[j:]) for j, own in lattice.edges(s, 0))


def test_forward_is_the_sum_over_all_segmentations():
    lattice = lm_score.Lattice(["a", "b", "ab", "abc", "bc", "▁a", "▁"])
    for word in ("abc", "aabbc", "aéb", "cab"):
        assert lattice.log10(word) == pytest.approx(math.log10(spelled(lattice, "▁" + word)))


def test_expectation_counts_every_character_once():
    lattice = lm_score.Lattice(["a", "b", "ab", "▁a", "▁"])
    found = Counter()
    lattice.expect("abab", 3, found)
    assert sum(n * len(lattice.pieces[p]) for p, n in found.items()) == pytest.approx(15)


def test_long_word_has_a_finite_score():
    lattice = lm_score.Lattice(["a", "▁"])
    assert -1e7 < lattice.log10("ax" * 20000) < 0


def test_batches_give_what_the_plain_recursion_gives():
    rnd = random.Random(3)
    lattice = lm_score.Lattice(lm_score.load_pieces(VOCABULARY))
    words_ = ["", "a", "the", "unbelievably", "été", "日本語", "x\x00y", "😀😀", "a" * 63, "a" * 64, "ab" * 300, "don't"]
    words_ += ["".join(rnd.choice("abcdeéñ日.,-'1") for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    own = lm_score.Batches(lattice)
    assert own.log10(words_) == pytest.approx([lattice.log10(w) for w in words_], rel=1e-9)
    counts = np.array([rnd.randrange(1, 50) for _ in words_], float)
    into = np.zeros(lattice.base + 256)
    own.expect(words_, counts, into)
    found = Counter()
    for w, c in zip(words_, counts):
        lattice.expect(w, c, found)
    want = np.zeros(len(into))
    for piece, x in found.items():
        want[piece] = x
    assert into == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_score_of_whole_documents_by_brute_force(spark, tmp_path, monkeypatch):
    """Every segmentation of every word spelled out, with probabilities from an expectation step that is
    spelled out as well."""
    pieces = ["a", "b", "ab", "ba", "aba", "▁a", "▁b", "▁ab", "▁"]
    monkeypatch.setattr(lm_score, "load_pieces", lambda path: pieces)
    rnd = random.Random(4)
    rows = [(i, " ".join("".join(rnd.choice("abAé") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(0, 6)))) for i in range(40)]

    def ways(s):
        """(probability, numbers used) of each segmentation."""
        if not s:
            yield 1.0, []
        for j, own in first.edges(s, 0) if s else ():
            for p, rest in ways(s[j:]):
                yield math.prod(prior[x] for x in own) * p, [*own, *rest]

    first = lm_score.Lattice(pieces)
    prior = first.prior()
    uses = np.zeros(len(prior))
    is_held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    for d, t in rows:
        if not is_held(d):
            uses[-1] += 1
            for w in words(t.encode()):
                every = list(ways("▁" + w.decode()))
                whole = sum(p for p, _ in every)
                for p, own in every:
                    for x in own:
                        uses[x] += p / whole
    prob = (uses + lm_score.PRIOR * prior) / (uses.sum() + lm_score.PRIOR)
    second = lm_score.Lattice(pieces, np.log(prob[:-1]), math.log(prob[-1]))
    want = {d: math.log10(prob[-1]) + sum(math.log10(spelled(second, "▁" + w.decode())) for w in words(t.encode())) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for top in (0, 3, lm_score.TOP_WORDS):
        got = {r.doc_id: r.score for r in lm_score.score_documents(spark, docs, vocabulary="none", top_words=top).collect()}
        assert got == pytest.approx(want, rel=1e-9)


ROWS = [(i, f"the cat {'sat ' * (i % 5)}on mat{i} été THE") for i in range(60)]
ROWS += [(60, None), (61, ""), (62, " \n\t"), (None, "the end"), (5, "the cat"), (5, "the cat"), (70, "word " * 3000)]


@pytest.mark.parametrize("top", [0, 8, lm_score.TOP_WORDS])
def test_against_plain_counts(spark, top):
    docs = spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in ROWS], "doc_id bigint, text string, h int, word string, score double")
    got = lm_score.score_documents(spark, docs, vocabulary=VOCABULARY, top_words=top).collect()
    is_held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in ROWS if not is_held(d) for w in [*words((t or "").encode()), "end"])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in ROWS:
        own = [*words((t or "").encode()), "end"]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((d, is_held(d), len(own), sum(c[w] > 0 for w in own), n, round(base, 4)))
    assert sorted((tuple(r)[:5] + (round(r.base_score, 4),) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    same = {round(r.score, 6) for r in got if r.n_tokens == 1}
    assert len(same) == 1


def test_empty_and_untrained(spark):
    schema = "doc_id bigint, text string"
    assert lm_score.score_documents(spark, spark.createDataFrame([], schema), vocabulary=VOCABULARY).collect() == []
    row = lm_score.score_documents(spark, spark.createDataFrame([(None, "a b")], schema), vocabulary=VOCABULARY).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_held_out_text_scores_above_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    noise = spark.createDataFrame([(10**9 + i, "zqxj kvwpz jjqk " * 40) for i in range(5)], "doc_id bigint, text string")
    rows = lm_score.score_documents(spark, docs.unionByName(noise), vocabulary=VOCABULARY).collect()
    per = lambda own: sum(r.score for r in own) / sum(r.n_tokens for r in own)
    assert per([r for r in rows if r.held_out and r.doc_id < 10**9]) > per([r for r in rows if r.doc_id >= 10**9])
