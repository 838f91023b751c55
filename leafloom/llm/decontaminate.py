"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. The runs of 1 to ``longest`` words of the test items are counted over all texts, in one walk from each
   word of a text that goes on only while the run so far is one of an item.
2. The seed at a place of an item is the shortest run of words from there that is rare: that few documents
   hold beyond those that hold what is *typical* of the item. Of an item that many documents copy, every run
   is common; so as many documents as hold its middling run of ``typical`` words are granted to each of its
   runs. Where a run of ``longest`` words still isn't rare, no seed stands. Fewer places than
   ``1 - min_score`` of an item are such, and a copy of the least score takes up more than they have.
3. The seeds are looked up in every text by the same walk. Around the places they point to, a window is
   taken that holds every alignment over them of the least score; it is left out only if the words that it
   has in common with its item can't reach that score.
4. All others are aligned with their item, word by word, with gaps: edited and partly rewritten copies
   keep a high score, chance hits a low one. Only hits leave the scan, texts are never shuffled.

Items too short to tell an edited copy from chance are looked up as whole phrases.

Items are taken in blocks of ``BLOCK_WORDS`` words or so, two passes over the texts for each, so what is
broadcast and counted has a bound however large the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import LOWER_BYTES, discard, row_key, stored, values
from leafloom.llm.shingles import longer, mix, word_hashes

BLOCK_WORDS = 500_000
#: Windows a document, on average, that the seeds of a block may point to beyond what is typical of their
#: items, and words looked up at once: a worker holds some hundred bytes for each of them.
RARE_WINDOWS, PACK_WORDS = 0.25, 100_000
#: Places a run, and most bits, of the table that turns away most runs before the exact search.
SIEVE_PLACES, SIEVE_BITS = 64, 22
#: Alignment: points for a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ROW = pa.struct([("id", pa.int64()), ("text", pa.int64())])


def plain_words(text: bytes | None) -> list[bytes]:
    """Words parted by white space, without ASCII punctuation, A-Z lower-cased."""
    return (text or b"").translate(LOWER_BYTES, _PUNCTUATION).split()


class Runs:
    """The distinct runs of ``size`` words among ``hashes``, each with the numbers ``own`` that stand at it.
    A walk goes on from those of them that are ``open``."""

    def __init__(self, size: int, hashes: np.ndarray, own: np.ndarray | None = None, seed: np.ndarray | None = None):
        self.size = size
        self.hash, run = np.unique(hashes, return_inverse=True)
        bits = min(SIEVE_BITS, max(1, SIEVE_PLACES * len(self.hash)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(2**bits, dtype=bool)
        self.sieve[(self.hash >> self.shift).astype(np.int64)] = True
        self.open = None
        if own is not None:
            seed = np.ones(len(own), dtype=bool) if seed is None else seed
            self.open = np.bincount(run[~seed], minlength=len(self.hash)) > 0
            self.own = own[seed][np.argsort(run[seed], kind="stable")]
            self.first = np.concatenate([[0], np.cumsum(np.bincount(run[seed], minlength=len(self.hash)))])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``hashes`` are runs here, their numbers)."""
        at = np.flatnonzero(self.sieve[(hashes >> self.shift).astype(np.int64)])
        run = np.searchsorted(self.hash, hashes[at])
        same = self.hash[np.minimum(run, len(self.hash) - 1)] == hashes[at] if len(self.hash) else np.zeros(len(at), dtype=bool)
        return at[same], run[same]

    def spread(self, at: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of ``at`` with every number that stands at its run."""
        low, times = self.first[run], self.first[run + 1] - self.first[run]
        at, low = np.repeat(at, times), np.repeat(low, times)
        return at, self.own[low + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]


def walk(tables: list[Runs], words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[Runs, np.ndarray, np.ndarray]]:
    """(runs of one length, places, numbers of the runs there), by rising lengths, in texts that stand one
    after the other and end at ``ends``. A place is left where its run isn't in a table or isn't open."""
    at, run, size = np.arange(len(words)), words, 1
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    for table in tables:
        while size < table.size:
            inside = at + size < stop[at]
            at, run = at[inside], run[inside]
            run, size = longer(run, words[at + size]), size + 1
        which, number = table.find(mix(run))
        yield table, at[which], number
        if table.open is not None:
            which = which[table.open[number]]
        at, run = at[which], run[which]


def packs(texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of the words of some texts one after the other, their ends)."""
    first, found, ends = 0, [], []
    for i, text in enumerate(texts):
        found += plain_words(text)
        ends.append(len(found))
        if len(found) >= PACK_WORDS:
            yield first, word_hashes(found), np.array(ends)
            first, found, ends = i + 1, [], []
    if ends:
        yield first, word_hashes(found), np.array(ends)


class Seeds:
    """The seeds of a block of items, each with its item and its place there."""

    def __init__(self, items: list[list[bytes]], longest: int, typical: int, min_score: float, min_words: int):
        self.items = [word_hashes(ws) for ws in items]
        self.lists = [h.tolist() for h in self.items]
        self.typical, self.min_score = typical, min_score
        # An alignment of the least score has so many words for a word of the item between its own at most.
        self.spare = MATCH * (1 - min_score) / -GAP
        sizes = np.array([len(h) for h in self.items], np.int64)
        long, short = np.flatnonzero(sizes >= min_words), np.flatnonzero((sizes > 0) & (sizes < min_words))
        self.of_item = np.repeat(long, sizes[long])
        self.place = np.arange(len(self.of_item)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
        left = sizes[self.of_item] - self.place
        words = np.concatenate([*(self.items[i] for i in long), np.empty(0, np.uint64)])
        # The places that have a run of each length, and those runs.
        at, run = np.arange(len(words)), words
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, longest + 1):
            if size > 1:
                inside = left[at] >= size
                at, run = at[inside], run[inside]
                run = longer(run, words[at + size - 1])
            self.runs.append((at, mix(run)))
        self.tables = [Runs(size, run) for size, (_, run) in enumerate(self.runs, 1)]
        self.whole = []
        for size in np.unique(sizes[short]).tolist():
            own = short[sizes[short] == size]
            words = np.stack([self.items[i] for i in own])
            run = words[:, 0]
            for k in range(1, size):
                run = longer(run, words[:, k])
            self.whole.append(Runs(size, mix(run), own))

    def choose(self, held: list[np.ndarray], windows: float) -> int:
        """Fix the seeds, given how many documents hold each run of each length, and return the limit of
        rarity: the largest number of documents beyond the typical one for which the seeds point to so many
        ``windows`` beyond it at most, and never less than one."""
        beyond = [count[np.searchsorted(table.hash, run)] for table, count, (_, run) in zip(self.tables, held, self.runs)]
        usual = np.zeros(len(self.items), np.int64)
        at = self.runs[self.typical - 1][0]
        counts, of = beyond[self.typical - 1], self.of_item[at]
        if len(at):
            order = np.lexsort((counts, of))
            own, first, many = np.unique(of[order], return_index=True, return_counts=True)
            usual[own] = counts[order][first + np.minimum(many - 1, np.floor(many * (1 - self.min_score)).astype(np.int64))]
        beyond = [np.maximum(count - usual[self.of_item[at]], 0) for count, (at, _) in zip(beyond, self.runs)]

        def lengths(limit: int) -> tuple[np.ndarray, int]:
            chosen, cost = np.zeros(len(self.place), np.int64), 0
            for size, (count, (at, _)) in enumerate(zip(beyond, self.runs), 1):
                now = (chosen[at] == 0) & (count <= limit)
                chosen[at[now]] = size
                cost += int(count[now].sum())
            return chosen, cost

        # A longer run is never in more documents, so what the seeds cost only grows with the limit.
        low, high = 1, max((int(count.max(initial=0)) for count in beyond), default=0) + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if lengths(middle)[1] <= windows else (low, middle)
        chosen = lengths(low)[0]
        self.tables = []
        for size, (at, run) in enumerate(self.runs, 1):
            on = chosen[at] >= size
            self.tables.append(Runs(size, run[on], at[on], chosen[at[on]] == size))
        del self.runs
        return low

    def windows(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) for each stretch of a text that seeds point to, with as many words to
        spare at both ends as an alignment of the least score can put in."""
        found = []
        for table, at, run in walk(self.tables, hashes, ends):
            at, own = table.spread(at, run)
            if len(at):
                found.append((np.searchsorted(ends, at, "right"), self.of_item[own], at - self.place[own]))
        if not found:
            return
        text, item, start = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        sizes = np.array([len(x) for x in self.lists])[item]
        cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(start) > 2 * sizes[:-1]))
        low, high = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(item) - 1]])
        text, item, size = text[low], item[low], sizes[low]
        spare = np.ceil(self.spare * size).astype(np.int64)
        first = np.concatenate([[0], ends])[text]
        yield from zip(text.tolist(), item.tolist(), np.maximum(first, start[low] - spare).tolist(), np.minimum(ends[text], start[high] + size + spare).tolist())

    def leaks(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, score, end) of each copy of an item in texts that stand one after the other, given
        as the hashes of their words and their ends."""
        first = [0, *ends.tolist()]
        for text, item, start, end in self.windows(hashes, ends):
            passage, whole = hashes[start:end], MATCH * len(self.lists[item])
            if reach(self.lists[item], set(passage.tolist())) / whole >= self.min_score:
                best, last = align(self.items[item], passage)
                if best / whole >= self.min_score:
                    yield text, item, best / whole, start + last - first[text]
        for phrases in self.whole:
            for _, at, run in walk([phrases], hashes, ends):
                at, own = phrases.spread(at, run)
                for a, t, item in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), own.tolist()):
                    yield t, item, 1.0, a + phrases.size - first[t]


def reach(a: list[int], b: set[int]) -> int:
    """What no local alignment of ``a`` in the words ``b`` scores more than: in the stretch of ``a`` that
    it takes up, a word that ``b`` has is a match at best, any other a mismatch or a gap."""
    best = now = 0
    for x in a:
        if x in b:
            now += MATCH
            if now > best:
                best = now
        else:
            now = max(0, now + max(MISMATCH, GAP))
    return best


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words: the best local score of ``a`` in ``b``, and where it ends in ``b``.
    One row of the matrix at a time; gaps along the row are a running maximum."""
    steps = -GAP * np.arange(1, len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in a:
        new = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k + 1
        row[1:] = new
    return best, end


def _count(tables):
    """How many documents hold each run of an item; length 0 counts the documents."""
    schema = pa.schema([("length", pa.int32()), ("run", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Runs] = tables.value
        totals, docs = [np.zeros(len(t.hash), np.int64) for t in own], 0
        for batch in batches:
            docs += batch.num_rows
            for _, hashes, ends in packs(values(batch.column("text").cast(pa.binary()))):
                for total, (_, at, number) in zip(totals, walk(own, hashes, ends)):
                    once = np.unique(np.searchsorted(ends, at, "right") * len(total) + number) % max(1, len(total))
                    total += np.bincount(once, minlength=len(total))
        for length, total in enumerate([np.array([docs]), *totals]):
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), length), pa.int32()), pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], schema=schema)

    return run


def _find(seeds):
    schema = pa.schema([("row", _ROW), ("item", pa.int32()), ("score", pa.float64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Seeds = seeds.value
        for batch in batches:
            at, cols = [], [[], [], []]
            for first, hashes, ends in packs(values(batch.column("text").cast(pa.binary()))):
                for text, *leak in own.leaks(hashes, ends):
                    at.append(first + text)
                    for c, v in zip(cols, leak):
                        c.append(v)
            rows = batch.column("row").cast(_ROW).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    return run


def _clean(seeds):
    """Whether each text holds no copy of an item."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        own: Seeds = seeds.value
        found = {first + text for first, hashes, ends in packs(values(texts.cast(pa.binary()))) for text, *_ in own.leaks(hashes, ends)}
        return pa.array([i not in found for i in range(len(texts))], pa.bool_())

    return clean


@dataclass
class Block:
    """Items of the benchmark with their seeds, as a broadcast value."""

    ids: list
    seeds: object


def item_blocks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", longest: int = 8, typical: int = 3, min_score: float = 0.5, min_words: int = 8
) -> Iterator[Block]:
    """The items in blocks, with seeds chosen by a count over all of ``docs``: the seeds of a block, of all
    lengths, point to ``RARE_WINDOWS`` windows a document at most, on average, beyond those to what is typical
    of their items. A run that a single document holds is rare in a corpus of any size."""
    if not 1 <= typical <= min(longest, min_words):
        raise ValueError("a typical run is as long as the longest one, and as the shortest item aligned, at most")
    texts = docs.select(F.col(text_col).alias("text"))
    tests = stored(spark, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "leaks-items")
    words = tests.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        table = tests.where(part == b).toArrow()
        items = [(i, ws) for i, ws in zip(table["item_id"].to_pylist(), (plain_words(t) for t in table["text"].cast(pa.binary()).to_pylist())) if ws]
        seeds = Seeds([ws for _, ws in items], longest, typical, min_score, min_words)
        tables = spark.sparkContext.broadcast(seeds.tables)
        counts = texts.mapInArrow(_count(tables), "length int, run int, n bigint").groupBy("length", "run").agg(F.sum("n").alias("n"))
        counts = stored(spark, counts, "leaks-counts")
        tables.unpersist()
        total = counts.where("length = 0").agg(F.sum("n")).first()[0] or 0
        found = counts.where("length > 0").toArrow()  # ``longest`` runs a word of the block at most
        discard(counts)
        length, number, n = (found[c].to_numpy() for c in ("length", "run", "n"))
        held = []
        for size, runs in enumerate(seeds.tables, 1):
            count, own = np.zeros(len(runs.hash), np.int64), length == size
            count[number[own]] = n[own]
            held.append(count)
        seeds.choose(held, RARE_WINDOWS * total)
        yield Block([i for i, _ in items], spark.sparkContext.broadcast(seeds))
    discard(tests)


def find_leaks(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    **how,
) -> DataFrame:
    """One row per row of ``docs`` and item that it holds a copy of: ``row`` (its key: id and hash of
    its text), ``item_id``, ``score`` (of the best alignment, 1 for a whole exact copy) and
    ``end_word`` (where that ends, in words). A copy scores ``min_score`` (0.5) or more and holds a seed
    of its item: a run of up to ``longest`` (8) words that is rare; without one it isn't looked at.
    Items of fewer than ``min_words`` (8) words are found where all their words stand in a row.

    Defined cases: null and empty texts hold nothing; items without words (null ones too) match nothing;
    items that repeat an id count as one; equal rows share one row of the result; empty tables give an
    empty table. Other columns aren't read.
    """
    key = row_key("id", "text")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(key.alias("row"), "text")
    kind = dict(benchmark.dtypes)[how.get("item_col", "item_id")]
    result = None
    for block in item_blocks(spark, docs, benchmark, text_col=text_col, **how):
        scored = stored(spark, texts.mapInArrow(_find(block.seeds), "row struct<id:bigint,text:bigint>, item int, score double, end_word bigint"), "leaks-scored")
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        hits = scored.join(names, "item").select("row", "item_id", "score", "end_word")
        result = hits if result is None else result.unionByName(hits)
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e")))
    return result.groupBy("row", "item_id").agg(best.alias("b")).select("row", "item_id", "b.score", (-F.col("b.e")).alias("end_word"))


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns, without the rows that hold a copy of a test item, told in the scan: a
    row is looked at by itself, so nothing is joined.

    Defined cases: as for ``find_leaks``; a row with a null or empty text stays; rows that repeat go or
    stay alike; columns of any name stay as they are; without items all rows stay.
    """
    for block in item_blocks(spark, docs, benchmark, text_col=text_col, **how):
        docs = docs.where(_clean(block.seeds)(F.col(text_col)))
    return docs
