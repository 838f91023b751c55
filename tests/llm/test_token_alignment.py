"""Aligned tokens against whole texts tokenised in one go and every pair of tokens looked at."""

import base64
import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from leafloom.llm import token_alignment as ta
from leafloom.llm.queries import BYTE_LEVEL, VOCABULARY

SCHEMA = "doc_id bigint, text string, pair string, n int, chunk string, k string, place int"


@pytest.fixture(scope="module")
def plain():
    """text -> ((id, begin, end) of either tokenizer) or None, from the libraries' plain calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(BYTE_LEVEL)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        own = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at = out[-1][2]
        return out

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        whole = (" " + text).encode()
        if b"".join(own[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            return None
        return spans(a, own.__getitem__), spans(b, piece)

    return run


def brute(rows, plain):
    tokens = [plain(t) for _, t in rows]
    links = [[(x[0], y[0]) for x in t[0] for y in t[1] if x[1] < y[2] and y[1] < x[2]] if t else [] for t in tokens]
    counts = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), t, own in zip(rows, tokens, links):
        if not t:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({x[2] for x in t[0]} & {y[2] for y in t[1]})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if low <= x[1] < high) for side in t))
            low = high
        n_best = sum(counts[p] == best[p[1]] for p in own)
        out.append((doc_id, len(t[0]), len(t[1]), len(groups), len(own), n_best, sum(counts[p] for p in own), sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x", 1, "y", "z", 2) for d, t in rows], SCHEMA)
    out = ta.align_tokenizers(spark, docs, byte_level=BYTE_LEVEL, pieces=VOCABULARY, **how)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def awkward(rnd):
    bits = [" ", "  ", "   ", "\n", " \n ", "\t", "\r\n", " ", " ", "\x1c", "\x85", "▁", "<0x41>", "<|endoftext|>", "<s>", "it's", "DON'T", "´", "é"]
    bits += ["hello", " world", "naïve", "straße", "漢字かな", "🙂👍🏽", "12345", "...", "--", "\x00", "﻿", "ﬁ", "Ａ", "antidisestablishmentarianism", "ПриветМир", "a b c"]
    return "".join(rnd.choice(bits) + rnd.choice(["", " ", "", "x"]) for _ in range(rnd.randrange(1, 30)))


def test_against_whole_texts(spark, plain):
    rnd = random.Random(3)
    texts = [awkward(rnd) for _ in range(250)] + [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "<|endoftext|>", "▁", "x▁y", "<0x0A>"]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(900 + i, "the same words again") for i in range(40)]
    assert found(spark, rows) == brute(rows, plain)


def test_many_chunks_give_the_same(spark, plain):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["river", "of", "Stone", "naïve,", "2024", "(old)"]) for _ in range(rnd.randrange(1, 60)))) for i in range(120)]
    assert found(spark, rows, chunk_chars=1) == brute(rows, plain)


def test_cells_are_encoded_as_in_their_text(plain):
    with open(BYTE_LEVEL, "rb") as a, open(VOCABULARY, "rb") as b:
        pair = ta.Pair(a.read(), b.read())
    assert pair.cuts
    rnd = random.Random(5)
    for _ in range(3000):
        text = awkward(rnd)
        cells, whole = pair.cells(text), plain(text)
        assert "".join(cells) == " " + text
        if whole:
            ids = pair.ids(cells)
            assert [i for a, _ in ids for i in a] == [x[0] for x in whole[0]]
            assert [i for _, b in ids for i in b] == [x[0] for x in whole[1]]
        else:
            assert list(pair([text])) == [None]


def test_long_text_without_a_space(spark, plain):
    rows = [(1, "ab1-" * 20_000), (2, "word " * 20_000), (3, "")]
    out = {r[0]: r for r in found(spark, rows)}
    a, b = plain(rows[0][1])
    assert out[1][1:3] == (len(a), len(b)) and out[3] == (3, 0, 0, 0, 0, 0, 0, "")
    assert out[2][4] == out[2][5]  # each id's only pair is its most frequent


def test_empty_table(spark):
    assert found(spark, []) == []
