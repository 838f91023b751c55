"""Near-duplicate groups by an inverted join on MinHash coordinates.

1. Each row's distinct word shingles become a signature; rows of one shingle set become one node, so
   copies cost nothing further.
2. Nodes are posted under each of their coordinate-value pairs. Two sets of similarity ``threshold``
   agree in ``matches`` coordinates or more but for a chance of ``MISS``, so they share one of any
   ``coordinates - matches + 1`` postings of either: each node keeps its shortest postings (prefix),
   its unshared ones counted in, and is left out of the long ones (skip).
3. Postings that hold the same nodes are reduced to one. The nodes of a posting are dealt into blocks,
   and one small group of rows is made for each pair of blocks, so no posting meets in one task.
   There collisions are counted, pairs under the match threshold go, the rest is confirmed on the full
   shingle sets, and only links that join two parts are returned, never all pairs.
4. Links are joined to connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, drop_rows, row_key, stored, take_rows, values
from leafloom.llm.components import connected_components
from leafloom.llm.shingles import MinHash, shingle_set

#: Chance that a pair exactly at the threshold agrees in too few coordinates to be looked at.
MISS = 1e-7
#: Bounds of a block of a posting: nodes, and their shingles in all (so long texts make small blocks).
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


def match_threshold(coordinates: int, similarity: float) -> int:
    """The most collisions that a pair of this similarity fails to reach with a chance of MISS at most."""
    low, m = 0.0, 0
    while True:
        low += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if low > MISS:
            return max(m, 1)
        m += 1


def _sketch(size: int, coordinates: int):
    schema = pa.schema(
        [("row", pa.struct([("id", pa.int64()), ("text", pa.int64())])), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(coordinates)
        for batch in batches:
            ns, keys, sigs = [], [], []
            for text in values(batch.column("text").cast(pa.binary())):
                found = shingle_set(text, size)
                ns.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(minhash(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").cast(schema.field("row").type), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def _union(parent: list[int], a: int, b: int) -> bool:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    parent[max(a, b)] = min(a, b)
    return a != b


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets. Shingles of a single set can't count, and the
    others are taken some thousand at a time."""
    every, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[column]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, len(shared), 4096):
        own = (at >= low) & (at < low + 4096)
        seen = np.zeros((len(sets), min(4096, len(shared) - low)), dtype=np.float32)
        seen[which[own], at[own] - low] = 1
        out += seen @ seen.T
    return out.astype(np.int64)


def links_of(
    nids: np.ndarray, sides: np.ndarray, sigs: np.ndarray, texts: list[bytes], size: int, percent: int, matches: int
) -> list[tuple[int, int]]:
    """Links between the nodes of one pair of blocks that suffice to join all nodes that links join.
    ``sides`` has the block of each node; with two blocks only pairs across are looked at."""
    n = len(nids)
    same = np.zeros((n, n), dtype=np.uint8)
    for k in range(sigs.shape[1]):
        same += sigs[:, k, None] == sigs[None, :, k]
    look = np.triu(same >= matches, 1)
    if sides.min() != sides.max():
        look &= sides[:, None] != sides[None, :]
    first, second = np.nonzero(look)
    if not len(first):
        return []
    used = np.unique(np.concatenate([first, second]))
    sets = {int(i): shingle_set(texts[i], size) for i in used}
    sizes = np.array([len(sets[i]) if i in sets else 0 for i in range(n)])
    if len(first) > 32:
        place = np.zeros(n, dtype=np.int64)
        place[used] = np.arange(len(used))
        both = _overlaps([sets[int(i)] for i in used])[place[first], place[second]]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(first, second)])
    linked = 100 * both >= percent * (sizes[first] + sizes[second] - both)
    parent = list(range(n))
    return [(int(nids[a]), int(nids[b])) for a, b in zip(first[linked].tolist(), second[linked].tolist()) if _union(parent, a, b)]


def _confirm(size: int, percent: int, matches: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            nids, sides = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            return links_of(nids, sides, np.array([r[2] for r in rows]), [r[3] for r in rows], size, percent, matches)

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:  # sorted by group; a group may go on in the next batch
            links: list[tuple[int, int]] = []
            sigs = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cols = [batch.column(c).to_pylist() for c in ("token", "low", "high", "nid", "side")]
            texts = values(batch.column("text").cast(pa.binary()))
            for i, (token, low, high, nid, side, text) in enumerate(zip(*cols, texts)):
                if (token, low, high) != now:
                    links += done()
                    now, rows = (token, low, high), []
                rows.append((nid, side, sigs[i], text))
            yield out(links)
        yield out(done())

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    coordinates: int = 32,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its key: id and hash of its text), ``n_shingles`` and
    ``component_id``, the smallest id of all rows that it is linked with, directly or through others.
    Rows are linked if their sets of distinct ``size``-word shingles have a similarity of ``percent``
    or more: 100 * intersection >= percent * union.

    Defined cases: fewer words than ``size`` count as one shingle; null, empty and blank texts have
    none and are linked with nothing; rows that repeat an id are rows of their own; a row with a null
    id takes the smallest id of its group, which is null if none has one; an empty table gives an
    empty table. Other columns aren't read, whatever their names.
    """
    matches = match_threshold(coordinates, percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = row_key("id", "text")
    rows = stored(
        spark,
        texts.select(key.alias("row"), "text").mapInArrow(
            _sketch(size, coordinates), "row struct<id:bigint,text:bigint>, n bigint, key binary, sig array<bigint>"
        ),
        "minhash-rows",
    )
    nodes = stored(
        spark,
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("row").alias("row"), F.min("row.id").alias("least"), F.first("sig").alias("sig"), F.first("n").alias("size"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "minhash-nodes",
    )
    postings = nodes.select("nid", F.explode("sig").alias("token"))
    lengths = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = postings.withColumn("k", F.struct("token")).join(lengths.select(F.struct("token").alias("k"), "n"), "k")
    prefix = stored(
        spark,
        shared.groupBy("nid")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
        .where(F.size("own") >= matches)
        .join(nodes.select("nid", "size"), "nid")
        .select("nid", "size", F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1)).alias("own"))
        .select("nid", "size", "own.token"),
        "minhash-prefix",
    )
    held = prefix.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), F.bit_xor(F.xxhash64("nid")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "nid")).alias("b")
    ).where("n > 1")
    kept = held.groupBy("n", "sizes", "a", "b").agg(F.min("token").alias("token"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("sizes") / BLOCK_SHINGLES))
    met = prefix.withColumn("k", F.struct("token")).join(kept.select(F.struct("token").alias("k"), "n", "sizes"), "k")
    pairs = (
        met.withColumn("side", F.pmod(F.xxhash64("nid", "token"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("nid", "token", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    pairs = stored(spark, pairs, "minhash-pairs")
    looked = stored(
        spark, nodes.join(pairs.select("nid").distinct(), "nid").select("row", "nid", "sig"), "minhash-looked"
    )
    # Repeated rows share a key; one of them is enough.
    full = take_rows(texts, key, looked).dropDuplicates(["nid"]).select("nid", "sig", "text")
    groups = (
        pairs.withColumn("k", F.struct("nid"))
        .join(full.select(F.struct("nid").alias("k"), "sig", "text"), "k")
        .select("token", "low", "high", "nid", "side", "sig", "text")
        .repartition("token", "low", "high")
        .sortWithinPartitions("token", "low", "high")
    )
    links = groups.mapInArrow(_confirm(size, percent, matches), "u bigint, v bigint")
    members = connected_components(spark, links).withColumnRenamed("node", "nid")
    discard(prefix, pairs, looked)
    named = members.join(nodes.select("nid", "least"), "nid")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = (
        nodes.select("nid", "key", "least")
        .join(named.join(least.select(F.struct("component").alias("k"), "component_id"), F.struct("component") == F.col("k")).select("nid", "component_id"), "nid", "left")
        .select(F.struct("key").alias("k"), F.coalesce("component_id", "least").alias("component_id"))
    )
    return (
        rows.withColumn("k", F.when(F.col("key").isNotNull(), F.struct("key")))
        .join(final, "k", "left")
        .select("row", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("row.id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns and one row of each group: the one with the smallest id. Rows without
    an id stay only where their group has no id at all; keywords as for ``near_duplicates``."""
    found = near_duplicates(spark, docs, id_col=id_col, text_col=text_col, **how)
    gone = stored(spark, found.where("NOT (row.id <=> component_id)").select("row"), "minhash-gone")
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"))
    return drop_rows(docs, key, gone)
