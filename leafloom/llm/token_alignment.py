"""Alignment of two tokenizers on the same texts: which tokens of one meet which of the other.

1. Texts are shuffled whole and grouped, so each distinct text is tokenised and aligned once, with the
   number of its copies.
2. A text is cut before each space that follows a character which isn't white space, but for spaces at its
   end. Neither tokenizer has a token across such a cut (the byte-level pattern begins a token there, and no
   piece holds a space after another character, which ``Pair`` verifies), so the cells between cuts are
   encoded on their own and the results of short cells are kept.
3. Distinct texts are put together into chunks of about ``CHUNK_CHARS``. A chunk's rows hold each text's pairs
   of ids as numbers of the chunk's own list of pairs; the list is written with the pairs' links times
   copies. Counts over all chunks are joined back to the lists, so what is shuffled is a row for each chunk
   and pair, never for each text and pair.
4. Each chunk meets its counted list, the texts' sums are taken, and they are joined to the rows by a hash
   of the text.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator, Mapping
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import stored

#: Characters of distinct texts in a chunk, and what a text counts besides.
CHUNK_CHARS, TEXT_CHARS = 24_000_000, 200
#: Cells of up to this many characters are kept, and about so many of them, twice.
CELL_CHARS, KEPT_CELLS = 48, 200_000

_CUTS = re.compile(r"(?<=\S)(?= +[^ ])")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, all
    others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def join_tokens(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> tuple[list[str], list[int]]:
    """(groups of ids between common ends, as text; links of ids whose ranges overlap, as numbers) of two runs of
    tokens with their sizes in bytes; both cover the same bytes."""
    groups, links, i, j = [], [], 0, 0
    x, y, one_end, two_end = a[0], b[0], a_sizes[0], b_sizes[0]
    one, two = str(x), str(y)
    while True:
        links.append((x << 32) | y)
        if one_end == two_end:
            groups.append(f"{one}|{two}")
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            x, y = a[i], b[j]
            one, two, one_end, two_end = str(x), str(y), one_end + a_sizes[i], two_end + b_sizes[j]
        elif one_end < two_end:
            i += 1
            x = a[i]
            one, one_end = f"{one},{x}", one_end + a_sizes[i]
        else:
            j += 1
            y = b[j]
            two, two_end = f"{two},{y}", two_end + b_sizes[j]


class Pair:
    """Both tokenizers, from the bytes of their files: a byte-level BPE and a piece model."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.b_bytes = []
        self.cuts = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            self.cuts &= "▁" not in piece.lstrip("▁")
        self.kept: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}  # what was kept before that

    def cells(self, text: str) -> list[str]:
        """The cells of a text; none for an empty one."""
        return [] if not text else _CUTS.split(" " + text) if self.cuts else [" " + text]

    def ids(self, cells: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of either tokenizer for each cell; a cell begins with a space."""
        one = self.a.encode_batch_fast(cells, add_special_tokens=False)
        return list(zip((e.ids for e in one), self.b.encode([c[1:] for c in cells], num_threads=1)))

    def _align(self, cell: str, a: list[int], b: list[int]) -> tuple[int, int, int, int, str, bytes] | None:
        one, two = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = cell.encode("utf-8", "surrogatepass")
        if b"".join(one) != whole or b"".join(two) != whole:
            return None
        groups, links = join_tokens(a, b, [len(x) for x in one], [len(x) for x in two])
        return len(a), len(b), len(groups), len(links), ";".join(groups), array("q", links).tobytes()

    def align(self, texts: list[list[str]]) -> Mapping[str, tuple | None]:
        """For each cell of the texts: tokens of either, groups, links, the groups as text and the links as
        numbers in bytes; None where the tokens' bytes aren't those of the cell. Short cells are kept for later
        calls, as numbers and strings only, which the garbage collector doesn't walk through."""
        cells = set(chain.from_iterable(texts))
        if len(self.kept) >= KEPT_CELLS:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        new = [c for c in cells if c not in kept]
        again = [c for c in new if c in older]
        kept.update((c, older[c]) for c in again)
        new = [c for c in new if c not in kept]
        found = {c: self._align(c, a, b) for c, (a, b) in zip(new, self.ids(new))} if new else {}
        long = {c: x for c, x in found.items() if len(c) > CELL_CHARS}
        kept.update((c, x) for c, x in found.items() if c not in long)
        return ChainMap(long, kept) if long else kept

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray] | None]:
        """For each text what ``align`` gives for a cell; None for a text that has no tokens."""
        cut = [self.cells(t) for t in texts]
        known = self.align(cut)
        for cells in cut:
            found = [known[c] for c in cells]
            if not found or None in found:
                yield None
                continue
            n_a, n_b, n_groups, n_links, written, links = zip(*found)
            codes = np.frombuffer(b"".join(links), dtype=np.int64)
            yield sum(n_a), sum(n_b), sum(n_groups), sum(n_links), sha256(";".join(written).encode()).hexdigest(), codes


@functools.lru_cache(maxsize=1)
def _pair(files: _Files) -> Pair:
    """The tokenizers of a worker: one task after another goes on with the cells that it has met."""
    return Pair(*files.value)


_TEXT = [("chunk", pa.int64()), ("digest", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
#: Rows of texts, with ``links``; rows of a chunk's pairs, with ``place``, ``pair`` and ``n``.
_SCHEMA = pa.schema([*_TEXT, ("links", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
_DDL = "chunk bigint, digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, place int, pair bigint, n bigint"


def _packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and how often each occurs, compressed."""
    return zstandard.compress(np.concatenate([np.diff(places, prepend=0), times]).astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data), dtype=np.uint32).astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


class _Files:
    """A broadcast of both files; two of one digest are the same."""

    def __init__(self, digest: str, files):
        self.digest, self.files = digest, files

    @property
    def value(self) -> tuple[bytes, bytes]:
        return self.files.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return self.digest == other.digest


def _tokenise(files: _Files, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, closed = _pair(files), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            """The rows of the open chunk and its pairs."""
            nonlocal rows, held, closed
            chunk, closed = (part << 32) | closed, closed + 1
            pairs, where = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
            totals, at, out = np.zeros(len(pairs), dtype=np.int64), 0, []
            for digest, copies, n_a, n_b, n_groups, n_links, own, times, sha in rows:
                places = where[at : at + len(own)]
                at += len(own)
                totals[places] += times * copies
                out.append((chunk, digest, n_a, n_b, n_groups, n_links, sha, _packed(places, times)))
            for low in range(0, len(out), 1024):
                some = out[low : low + 1024]
                nulls = [pa.nulls(len(some), f.type) for f in list(_SCHEMA)[8:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*some), _SCHEMA)), *nulls], schema=_SCHEMA)
            for low in range(0, len(pairs), 65536):
                some = slice(low, low + 65536)
                n = len(pairs[some])
                nulls = [pa.nulls(n, f.type) for f in list(_SCHEMA)[1:8]]
                own = [pa.array(np.arange(low, low + n, dtype=np.int32)), pa.array(pairs[some]), pa.array(totals[some])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, dtype=np.int64)), *nulls, *own], schema=_SCHEMA)
            rows, held = [], 0

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = some.column("text").to_pylist()
                for text, copies, found in zip(texts, some.column("copies").to_pylist(), pair(texts)):
                    if found is None:
                        continue
                    own, times = np.unique(found[5], return_counts=True)
                    rows.append((sha256(text.encode()).digest(), copies, *found[:4], own, times, found[4]))
                    held += len(text) + TEXT_CHARS
                    if held >= chunk_chars:
                        yield from close()
        if rows:
            yield from close()

    return run


def _measure(texts: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """The sums of each text of a chunk from the chunk's counted pairs."""
    counts, best = np.zeros(len(counted), dtype=np.int64), np.zeros(len(counted), dtype=np.int64)
    counts[counted["place"]] = counted["count"]
    best[counted["place"]] = counted["best"]
    n_best, count_sum = [], []
    for data in texts["links"]:
        places, times = _unpacked(data)
        n_best.append(int(times @ best[places]))
        count_sum.append(int(times @ counts[places]))
    return texts[["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(n_best=n_best, count_sum=count_sum)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best) from the chunks' lists: links that hold the pair linked, in all rows, and 1 where no
    pair with the same second id has more."""
    totals = chunks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count"))
    same = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # as many as the first vocabulary has
    return totals.withColumn("best", (F.col("count") == F.max("count").over(same)).cast("int"))


def align_tokenizers(
    spark: SparkSession, docs: DataFrame, *, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, tokens ``n_a`` and ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose pair is its second id's most frequent, ties included), ``count_sum`` (over the links, the
    count of their pairs in all rows) and ``groups_sha256`` of the groups as ``a1,a2|b1;a3|b2,b3``.

    ``byte_level`` (a JSON file) and ``pieces`` (a piece model) are read on the driver; both are a few MB.

    Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no
    tokens, zeros and an empty ``groups_sha256``; repeated rows count each time; ids stay as they are, null or
    repeated; an empty table gives an empty table. Other columns aren't read, whatever their names.
    """
    with open(byte_level, "rb") as one, open(pieces, "rb") as two:
        read = one.read(), two.read()
    files = _Files(sha256(b"".join(read)).hexdigest(), spark.sparkContext.broadcast(read))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    chunks = stored(spark, distinct.mapInArrow(_tokenise(files, chunk_chars), _DDL), "alignment-chunks")
    lists = chunks.where("pair IS NOT NULL").select("chunk", "place", F.struct("pair").alias("k"))
    counted = lists.join(pair_counts(chunks).select(F.struct("pair").alias("k"), "count", "best"), "k").select(F.col("chunk").alias("of"), "place", "count", "best")
    texts = chunks.where("digest IS NOT NULL").select("chunk", *[n for n, _ in _TEXT[1:]], "links")
    measured = (
        texts.groupBy("chunk")
        .cogroup(counted.groupBy("of"))
        .applyInPandas(_measure, "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    )
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    keyed = rows.select("doc_id", F.struct(F.unhex(F.sha2("text", 256)).alias("digest")).alias("k"))
    met = keyed.join(measured.select(F.struct("digest").alias("k"), *numbers, "groups_sha256"), "k", "left")
    return met.select("doc_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
