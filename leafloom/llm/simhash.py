"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius of each other.

1. A text's terms are its words (A-Z lower-cased). The hash of each distinct term is a vector of signs; it
   votes with weight 1 + ln(occurrences), and the signs of the sums are the bits of the fingerprint. It
   follows from the text alone, so equal texts have equal fingerprints in any corpus.
2. For the edited texts each document meets its successor: rows are dealt by ranges of ids and sorted, so
   that a stream over a range holds one text and the next. Where a range ends, two rows are put aside and
   joined; there are twice as many of them as ranges.
3. Fingerprints are cut into blocks. Two of them that differ in ``radius`` bits or fewer agree in ``keyed``
   of ``radius + keyed`` blocks, so each fingerprint is posted in one table for each choice of ``keyed``
   blocks (the permuted tables, keyed by the chosen blocks), and only fingerprints of one key are
   compared. A pair counts in the first table that it shares. Equal fingerprints are one node; nodes of a
   frequent key are dealt into blocks of ``BUCKET``, and one small group is made for each pair of blocks.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, stored
from leafloom.llm.components import connected_components
from leafloom.llm.shingles import words

#: Nodes of a block of one key; two blocks are compared at a time.
BUCKET = 1024
#: Terms whose signs a task keeps.
KEPT_TERMS = 100_000


class SimHash:
    """Fingerprints of ``bits`` bits (a multiple of 128)."""

    def __init__(self, bits: int = 256):
        if bits < 128 or bits % 128:
            raise ValueError("a fingerprint has a multiple of 128 bits")
        self.bits = bits
        self.place: dict[bytes, int] = {}
        self.signs = np.empty((1024, bits), dtype=np.float32)

    def _sign_rows(self, terms: list[bytes]) -> np.ndarray:
        """The places of the terms' signs; unknown terms are added."""
        if len(self.place) > KEPT_TERMS:
            self.place = {}
        place = self.place
        new = [t for t in terms if t not in place]
        if new:
            at = len(place)
            while at + len(new) > len(self.signs):
                self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
            drawn = b"".join(xxhash.xxh3_128_digest(t, seed=s) for t in new for s in range(self.bits // 128))
            votes = np.unpackbits(np.frombuffer(drawn, dtype=np.uint8)).reshape(len(new), self.bits)
            self.signs[at : at + len(new)] = votes * np.float32(2) - np.float32(1)
            place.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(place.__getitem__, terms), dtype=np.int64, count=len(terms))

    def __call__(self, text: bytes) -> bytes:
        """The fingerprint; zeros for a text without words."""
        counts = Counter(words(text))
        terms = list(counts)
        total = np.zeros(self.bits, dtype=np.float64)
        for low in range(0, len(terms), 4096):  # bounds the memory that a long text takes
            some = terms[low : low + 4096]
            times = np.fromiter(map(counts.__getitem__, some), dtype=np.float32, count=len(some))
            rows = self._sign_rows(some)
            total += np.rint(16 * (1 + np.log(times))) @ self.signs[rows]  # whole numbers, so the sums are exact in any order
        return np.packbits(total > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of bits in which two fingerprints agree."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the beginning of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


_DONE = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
#: Rows put aside where a range begins (side 0) or ends (side 1).
_SCHEMA = pa.schema([*_DONE, ("part", pa.int32()), ("side", pa.int32()), ("text", pa.string())])
_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, "
    "part int, side int, text string"
)


def _done(simhash: SimHash, doc_id: int | None, text: str, own: bytes, after: str, after_print: bytes) -> tuple:
    new = edited(text, after).encode()
    new_print = simhash(new)
    return doc_id, len(text), sha256(new).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, after_print), None, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def _walk(bits: int):
    """Over the rows of a range in order: each with its successor, the first and the last put aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash, part, before = SimHash(bits), TaskContext.get().partitionId(), None

        def aside(side: int, doc_id: int | None, text: str, own: bytes) -> tuple:
            return doc_id, None, None, own, None, None, None, part, side, text

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some, rows = batch.slice(low, 256), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    now = (doc_id, text, simhash(text.encode()))
                    rows.append(aside(0, *now) if before is None else _done(simhash, *before, now[1], now[2]))
                    before = now
                yield _batch(rows)
        if before is not None:
            yield _batch([aside(1, *before)])

    return run


def _meet(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash(bits)
        for batch in batches:
            yield _batch([_done(simhash, *row) for row in zip(*(c.to_pylist() for c in batch.columns))])

    return run


def fingerprints(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_chars``, the hash of the edited text, both fingerprints
    (binary), ``near_edited`` and ``near_next``. The table of the first pass is stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(ranges, order).sortWithinPartitions(order, F.col("text").desc())
    walked = stored(spark, dealt.mapInArrow(_walk(bits), _DDL), "simhash-rows")
    parts = sorted(r.part for r in walked.where("side = 0").select("part").collect())  # one number a range
    follows = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    firsts = walked.where("side = 0").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    lasts = walked.where("side = 1").select("part", "doc_id", "text", "fingerprint")
    met = lasts.join(follows, "part").join(firsts, "next").select("doc_id", "text", "fingerprint", "after", "after_print")
    names = [n for n, _ in _DONE]
    return walked.where("side IS NULL").select(*names).unionByName(met.mapInArrow(_meet(bits), _DDL).select(*names))


def near_pairs(prints: np.ndarray, across: np.ndarray | None, radius: int, blocks: int, keyed: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of ``prints`` (bytes) that differ in ``radius`` bits at most and whose first shared
    table is ``table``; with ``across`` only pairs whose values there differ."""
    tables = {c: i for i, c in enumerate(itertools.combinations(range(blocks), keyed))}
    numbers = np.ascontiguousarray(prints).view(np.uint64)
    found: tuple[list[int], list[int]] = ([], [])
    for low in range(0, len(numbers), 64):
        some = numbers[low : low + 64]
        apart = np.bitwise_count(some[:, None, :] ^ numbers[None, :, :]).sum(axis=2, dtype=np.int32)
        look = apart <= radius
        look &= np.arange(low, low + len(some))[:, None] < np.arange(len(numbers))[None, :]
        if across is not None:
            look &= across[low : low + 64, None] != across[None, :]
        first, second = np.nonzero(look)
        if not len(first):
            continue
        cut = prints.reshape(len(prints), blocks, -1)
        same = (cut[first + low] == cut[second]).all(axis=2)
        agreed = np.argsort(~same, axis=1, kind="stable")[:, :keyed]
        here = np.fromiter((tables[tuple(a)] == table for a in agreed.tolist()), dtype=bool, count=len(agreed))
        found[0].extend((first[here] + low).tolist())
        found[1].extend(second[here].tolist())
    return np.array(found[0], dtype=np.int64), np.array(found[1], dtype=np.int64)


def _compare(radius: int, blocks: int, keyed: int):
    """For each group: (u, v) that join all nodes that links join, and (u, near): how many rows a node is linked with."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("near", pa.int64())])

    def links(table: int, rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        nids, sides, copies, prints = zip(*rows)
        side = np.array(sides)
        a, b = near_pairs(
            np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1), side if side.min() != side.max() else None, radius, blocks, keyed, table
        )
        n = np.array(copies, dtype=np.int64)
        near = np.zeros(len(n), dtype=np.int64)
        np.add.at(near, a, n[b])
        np.add.at(near, b, n[a])
        parent, joined = list(range(len(n))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                joined.append((nids[x], nids[y], None))
        return joined + [(nids[i], None, int(near[i])) for i in np.flatnonzero(near)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:  # sorted by group; a group may go on in the next batch
            cols = [batch.column(c).to_pylist() for c in ("table", "key", "low", "high", "nid", "side", "copies", "fingerprint")]
            for table, key, low, high, *row in zip(*cols):
                if (table, key, low, high) != now:
                    out += links(now[0], rows) if now else []
                    now, rows = (table, key, low, high), []
                rows.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)
            out = []
        out += links(now[0], rows) if now else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)

    return run


def near_fingerprints(spark: SparkSession, prints: DataFrame, *, radius: int, keyed: int = 1) -> DataFrame:
    """For a stored table of ``doc_id`` and ``fingerprint``, one row per distinct fingerprint that isn't zero:
    ``fingerprint``, ``class_id`` (the smallest id of all rows reached over fingerprints within ``radius`` bits)
    and ``n_near`` (rows within the radius, itself included). The bytes of a fingerprint have to be a multiple
    of ``radius + keyed``."""
    blocks = radius + keyed
    size = prints.select(F.length("fingerprint")).first()
    width = size[0] if size else blocks
    if width % blocks:
        raise ValueError(f"{8 * width} bits don't make {blocks} blocks of whole bytes")
    zero = F.lit(bytes(width))
    nodes = stored(
        spark,
        prints.where(F.col("fingerprint") != zero)
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "simhash-nodes",
    )
    step = width // blocks
    tables = [
        F.struct(F.lit(i).alias("table"), F.concat(*[F.substring("fingerprint", b * step + 1, step) for b in chosen]).alias("key"))
        for i, chosen in enumerate(itertools.combinations(range(blocks), keyed))
    ]
    posted = nodes.select("nid", F.explode(F.array(*tables)).alias("k"))
    shared = posted.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posted.withColumn("w", F.struct("k")).join(shared.select(F.struct("k").alias("w"), "n"), "w").select("nid", "k.table", "k.key", "n")
    parts = F.ceil(F.col("n") / BUCKET)
    paired = (
        met.withColumn("side", F.pmod(F.xxhash64("nid", "key"), parts))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select(F.struct("nid").alias("w"), "table", "key", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    groups = (
        paired.join(nodes.select(F.struct("nid").alias("w"), "copies", "fingerprint"), "w")
        .select("table", "key", "low", "high", "w.nid", "side", "copies", "fingerprint")
        .repartition("table", "key", "low", "high")
        .sortWithinPartitions("table", "key", "low", "high")
    )
    links = stored(spark, groups.mapInArrow(_compare(radius, blocks, keyed), "u bigint, v bigint, near bigint"), "simhash-links")
    near = links.where("v IS NULL").groupBy("u").agg(F.sum("near").alias("near"))
    members = connected_components(spark, links.where("v IS NOT NULL").select("u", "v"))
    named = members.join(nodes.select(F.col("nid").alias("node"), "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("class_id")).select(F.struct("component").alias("w"), "class_id")
    classes = named.withColumn("w", F.struct("component")).join(least, "w").select(F.col("node").alias("nid"), "class_id")
    return (
        nodes.join(near.withColumnRenamed("u", "nid"), "nid", "left")
        .join(classes, "nid", "left")
        .select("fingerprint", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") + F.coalesce("near", F.lit(0))).alias("n_near"))
    )


def fingerprint_documents(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, radius: int = 7, keyed: int = 1
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint`` and
    ``edited_fingerprint`` (hex), ``near_edited``, ``near_next`` (shares of equal bits), ``class_id`` (the smallest
    id reached over fingerprints that differ in ``radius`` bits at most) and ``n_near`` (other rows within the
    radius). The next document is the one with the next smaller id; after the smallest comes the largest.

    Defined cases: a null text is an empty one; a text without words has a fingerprint of zeros, is linked with
    nothing and is its own class; rows that repeat an id follow each other by descending text; null ids come
    last; a row with a null id takes its class from the others, and null where none has an id; of a single row
    the next document is itself; an empty table gives an empty table. Ids that aren't whole numbers end the job.
    Other columns aren't read, whatever their names.
    """
    rows = stored(spark, fingerprints(spark, docs, id_col=id_col, text_col=text_col, bits=bits), "simhash-done")
    found = near_fingerprints(spark, rows.select("doc_id", "fingerprint"), radius=radius, keyed=keyed)
    wrapped = found.select(F.struct("fingerprint").alias("w"), "class_id", "n_near")
    met = rows.withColumn("w", F.struct("fingerprint")).join(wrapped, "w", "left")
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("n_near").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_near", F.lit(1)) - 1).alias("n_near"),
    )
