"""Patterns against their plain forms; the field against enumeration and on forms it must learn."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from leafloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = [(m.start(), m.end(), k) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def some_texts(n, seed):
    rnd = random.Random(seed)
    bits = ["a.b@c.de", "x@y", "@", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "4404 1894 9746 0879", "4041894974608795", "+1 (988) 555-2485", "+", "..", " ", "é", "a", "7", "-", "00", "user_1%+-", "@d.e.f@g.h", "5500-0000-0000-0004", "\n"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(n)]


def test_patterns_equal_their_plain_forms():
    for text in some_texts(4000, 1):
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def card(rnd):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def trained(seed=2):
    rnd = random.Random(seed)
    texts = [rnd.choice([f"see +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} or", f"the ip 10.{i}.3.4 is up", f"paid by {card(rnd)} at", f"mail ab{i}@host{i % 7}.example.com now", f"order {rnd.randrange(10**5, 10**7)} of 2024-05-0{i % 9}", f"password=b7db7aa4a5fcc{i} ok"]) for i in range(300)]
    return pii.fit(texts)


def test_field_finds_forms_that_no_pattern_has():
    model = trained()
    text = "see (321) 555-9876 or 10.9.8.7"
    assert [(text[a:b], pii.KINDS[k]) for a, b, k in model.decode(text)] == [("(321) 555-9876", "phone"), ("10.9.8.7", "ip")]
    assert model.decode("order 123456 of 2024-05-06, password=b7db7aa4a5fcc78305") == []


def test_field_parts_numbers_that_a_pattern_joins():
    model, rnd = trained(), random.Random(9)
    for i in range(40):
        phone, ip, number = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}", f"10.{i}.7.9", card(rnd)
        for first, second in ((phone, number), (phone, ip), (number, ip), (number, card(rnd))):
            text = f"so it is {first} {second} here"
            base, every = pii.find_spans(text, model)
            assert [text[a:b] for a, b, _ in every] == [first, second]
            assert set(base) <= set(every) and base == brute(text)


def test_copies_for_training_keep_their_places():
    text = "a +1 (988) 555-2485 b 10.0.0.1"
    spans, pool = pii.base_spans(text), [("x@y.de", 0), ("1.2.3.4", 1)]
    out, moved = pii._joined(text, spans, pool, 0)
    assert out == "a +1 (988) 555-2485 x@y.de b 10.0.0.1 1.2.3.4"
    assert [(out[a:b], k) for a, b, k in moved] == [("+1 (988) 555-2485", 3), ("x@y.de", 0), ("10.0.0.1", 1), ("1.2.3.4", 1)]
    assert pii.fit([]).weights == {} and pii.fit(["no span 12"]).decode("a 10.0.0.1") == []


def test_decode_is_the_best_of_all_segmentations():
    model = trained()
    for text in ("+1 (321) 555-9876 10.9.8.7", "a1@b2.example.com 321 555-9876"):
        (low, high), = list(pii.stretches(text))[:1]
        cuts, ways = model.candidates(text, low, high)

        def all_from(i):
            if i == len(ways):
                yield 0.0, ()
                return
            for x, rest in all_from(i + 1):
                yield x, rest
            for j, k, own in ways[i]:
                for x, rest in all_from(j):
                    yield x + model.score(k, own) - pii.MARGIN, ((cuts[i], cuts[j], k), *rest)

        best = max(all_from(0))
        assert tuple(s for s in model.decode(text) if low <= s[0] < high) == best[1]


def test_slopes_lead_uphill():
    text, truth = "see (321) 555-9876 or", [(4, 18, 3)]
    model, squares = pii.SemiCrf(), defaultdict(lambda: 1e-8)

    def likelihood():
        (low, high), = list(pii.stretches(text))[:1]
        cuts, ways = model.candidates(text, low, high)
        total = [0.0] + [-math.inf] * len(ways)
        own = 0.0
        for i, w in enumerate(ways):
            total[i + 1] = pii._plus(total[i + 1], total[i])
            for j, k, f in w:
                total[j] = pii._plus(total[j], total[i] + model.score(k, f))
                own += model.score(k, f) * ((cuts[i], cuts[j], k) in truth)
        return own - total[-1]

    before = likelihood()
    for _ in range(5):
        model.learn(text, truth, squares)
    assert likelihood() > before


@pytest.mark.parametrize("sample", [0, 50])
def test_table(spark, sf, sample):
    texts = some_texts(300, 8)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, "a.b@c.de"), (3, texts[3]), (902, "word 10.0.0.1 " * 20000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, spans int, n_email string")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = pii.train(spark, docs, sample_rows=sample)
    assert bool(model.weights) == bool(sample)
    got = pii.find_personal_data(spark, docs, model).collect()
    want = []
    for d, t in rows:
        spans = brute(t)
        n = Counter(k for _, _, k in spans)
        want.append((d, *(n[k] for k in range(4)), hashlib.sha256(pii.spelled(spans).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    by = {(d, hashlib.sha256(pii.spelled(brute(t)).encode()).hexdigest()): brute(t) for d, t in rows}
    for r in got:
        own = [(int(a), int(b), pii.KINDS.index(k)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(by[r.doc_id, r.base_sha256]) <= set(own)
    assert pii.find_personal_data(spark, docs.limit(0), model).collect() == []
