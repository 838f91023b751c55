"""Line deduplication against a plain loop."""

import random
import time
from collections import Counter

from leafloom.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, h string, pos int, n bigint, key string, gone string, row int, __ld_row string"


def brute(rows, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    lines = [(t or "").split("\n") for _, t in rows]
    n = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for (d, _), ls in zip(rows, lines):
        kept = [x for x in ls if n[key(x)] < min_docs]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "a", 1, 2, "k", "g", 7, "r") for d, t in rows], SCHEMA)
    out = line_dedup.drop_common_lines(docs, **how)
    assert out.columns == [*docs.columns, "ld_kept", "ld_lines", "ld_dropped"]
    return sorted(((r.doc_id, r.ld_lines, r.ld_dropped, r.ld_kept) for r in out.collect()), key=repr)


def test_a_text_of_very_many_lines(spark):
    """40,000 lines, every other one common: its lines are read once, not once for each of them."""
    rows = [(i, "common") for i in range(12)] + [(99, "\n".join(f"line {i}" if i % 2 else "common" for i in range(40_000)))]
    began = time.monotonic()
    assert found(spark, rows) == brute(rows)
    assert time.monotonic() - began < 60


def seconds(spark, rows):
    docs = spark.createDataFrame([(d, t, "a", 1, 2, "k", "g", 7, "r") for d, t in rows], SCHEMA).repartition(4).cache()
    docs.count()
    began = time.monotonic()
    out = line_dedup.drop_common_lines(docs).selectExpr("sum(ld_lines)", "sum(ld_dropped)", "sum(length(ld_kept))").first()
    took = time.monotonic() - began
    docs.unpersist()
    return took, tuple(out)


def test_equal_rows_and_dropped_lines_take_time_in_proportion(spark):
    text = "\n".join(f"shared line {i}" for i in range(200))
    seconds(spark, [(1, text)] * 1000)  # code is compiled
    few, many = (seconds(spark, [(1, text)] * n) for n in (2000, 8000))
    assert many[1] == (1_600_000, 1_600_000, 0) and many[0] < 6 * few[0] + 2
    lines = lambda n: [(i, "\n".join(f"common {k}" for k in range(n))) for i in range(10)]
    few, many = (seconds(spark, lines(n)) for n in (10_000, 40_000))
    assert many[1] == (400_000, 400_000, 0) and many[0] < 6 * few[0] + 2


def test_against_a_loop(spark):
    rnd = random.Random(1)
    pool = ["Common line", "  common LINE\t", "\x0bÉtait", "était", "x", "", " ", "\r"] + [f"own {i}" for i in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 7)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, "common line"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (303, "common line\n" * 20000 + "last")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, min_docs=3) == brute(rows, 3)


def test_given_table_and_empty_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
