"""Source audits against dense tables of all terms by all sources in whole numbers."""

import random
import re
import string
from collections import Counter, defaultdict

from leafloom.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, terms int, n string, term string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_df=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))) for text, lang, source in rows]
    df, whole, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(terms.keys())
        whole[lang].update(terms)
        group[lang, source].update(terms)
    out = []
    for (lang, source), own in group.items():
        kept = [t for t, n in df[lang].items() if n >= min_df]
        share = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept})(sum(c[t] for t in kept))
        value = lambda p, q: (p - q) * (p - q) // q
        p, q = share(own), share(whole[lang])
        pairs = []
        for (other, item), theirs in group.items():
            if other == lang and item != source:
                r = share(theirs)
                pairs.append((item, sum(value(p[t], r[t]) for t in kept)))
        terms = [(t, value(p[t], q[t])) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, v, rank))
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang, s, 1, "n", "t") for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    out = divergence.audit_sources(spark, docs, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def sample(n):
    rnd = random.Random(n)
    words = ["Alpha", "beta's", "naïve", "漢字", "x1y", "GAMMA-ray", "straße", "Ünder", "_a_", "\x85", "🙂"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "é", None, "S"])) for _ in range(n)]
    return rows + [(None, "en", "silent"), ("", "en", "silent"), ("123 ...", "xx", "a"), ("once", "xx", "b"), ("lonely words here", "yy", "only")] * 2


def test_against_dense_tables(spark):
    rows = sample(200)
    assert found(spark, rows) == brute(rows)


def test_few_kept_terms_and_ranks_cut(spark):
    rows = sample(40)
    assert found(spark, rows, min_df=9, top=2) == brute(rows, 9, 2)


def test_language_without_terms_and_empty_table(spark):
    rows = [("one", "a", "x"), ("two", "a", "y"), (None, "b", None)]
    assert found(spark, rows) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    assert found(spark, []) == []


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, size = 9_223_372_036_854, 98_765_432_109_876, 12_345_678
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(size)).alias("p"), divergence.excess(F.lit(1_000_000_001).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert got.p == 1 + 10**9 * (n + 1) // (total + size) and got.f == 10**18


def test_long_text(spark):
    rows = [("word " * 200_000 + "x" * 300_000, "en", "a"), ("word", "en", "b"), ("word", "en", "c")]
    assert found(spark, rows) == brute(rows)
