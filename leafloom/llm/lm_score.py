"""Language-model scores from the lattice of subword segmentations, beside a word-unigram base.

The pieces of an existing subword vocabulary span, for each text, a lattice of segmentations. Each
segmentation has the product of its pieces' probabilities; the text has the sum over all of them,
by the forward recursion in log space. Pieces don't cross white space, so the sum factorises into
words: each distinct word of the corpus is run once, and a text adds up its words.

The piece probabilities start from the vocabulary's own order (the scores of the given file are
ranks, not probabilities: they become a Zipf prior) and are re-estimated by one expectation step
over all training words, weighted with their counts.

Words are run many at a time: those of like length are a matrix of characters, every substring is
looked up by a rolling hash, and the recursions go over positions with all words of a batch at once.
Words over ``LONG`` characters take the plain recursion one by one, which gives the same numbers.

Data flow. Words are counted inside each task before they are shuffled. Words frequent enough for a
table of ``TOP_WORDS`` entries at most are broadcast and summed inside the scan; all other words meet
their counts in an ordinary join on a 64-bit hash, so nothing is cut off.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import discard, stored
from leafloom.llm.shingles import word_hashes, words

#: Bound of the broadcast word table.
TOP_WORDS = 2**18
#: Words counted in a task before they are passed on: bounds the task's memory.
FLUSH = 500_000
#: Weight of the prior, in pieces, and the share of the byte pieces in it.
PRIOR, BYTES = 10_000.0, 1e-4
SPACE = "▁"
#: Characters of the longest word that is run in a batch, and characters times pieces of a batch.
LONG, BATCH = 64, 2_000_000

_LN10 = math.log(10)


class Lattice:
    """Pieces with log probabilities. ``ids`` maps each piece to its number, and each proper prefix of
    a piece that is no piece itself to -1; the 256 bytes have the numbers from ``len(pieces)`` on, and
    spell characters that are no piece."""

    def __init__(self, pieces: list[str], logp: np.ndarray | None = None, log_end: float = 0.0):
        self.pieces, self.base = pieces, len(pieces)
        self.ids: dict[str, int] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.ids.setdefault(p[:k], -1)
        self.ids |= {p: i for i, p in enumerate(pieces)}
        if logp is None:
            prior = self.prior()
            logp, log_end = np.log(prior[:-1]), math.log(prior[-1])
        self.logp, self.log_end = logp.tolist(), log_end

    def prior(self) -> np.ndarray:
        """Zipf by place in the vocabulary, a small even share for bytes, and one piece's worth for the end."""
        zipf = 1.0 / (np.arange(self.base) + 10.0)
        all_ = np.concatenate([zipf / zipf.sum() * (1 - 2 * BYTES), np.full(256, BYTES / 256), [BYTES]])
        return all_ / all_.sum()

    def edges(self, s: str, i: int) -> list[tuple[int, list[int]]]:
        """(end, numbers of the pieces) for each way on from position i."""
        out, ids, n = [], self.ids, len(s)
        j = i + 1
        while j <= n:
            found = ids.get(s[i:j])
            if found is None:
                break
            if found >= 0:
                out.append((j, [found]))
            j += 1
        if ids.get(s[i], -1) < 0:
            out.append((i + 1, [self.base + b for b in s[i].encode()]))
        return out

    def forward(self, s: str) -> list[float]:
        """Log of the summed probability of all segmentations of each prefix of ``s``."""
        ids, logp, n = self.ids, self.logp, len(s)
        terms: list[list[float] | None] = [None] * (n + 1)
        alpha = [0.0] * (n + 1)
        for i in range(n):
            if i:
                into = terms[i]
                if into is None:
                    alpha[i] = -math.inf
                    continue
                if len(into) == 1:
                    alpha[i] = into[0]
                else:
                    top = max(into)
                    alpha[i] = top + math.log(sum([math.exp(x - top) for x in into]))
                terms[i] = None
            a, j = alpha[i], i + 1
            while j <= n:
                found = ids.get(s[i:j])
                if found is None:
                    break
                if found >= 0:
                    if terms[j] is None:
                        terms[j] = [a + logp[found]]
                    else:
                        terms[j].append(a + logp[found])
                j += 1
            if ids.get(s[i], -1) < 0:
                x = a + sum([logp[self.base + b] for b in s[i].encode()])
                if terms[i + 1] is None:
                    terms[i + 1] = [x]
                else:
                    terms[i + 1].append(x)
        top = max(terms[n])
        alpha[n] = top + math.log(sum([math.exp(x - top) for x in terms[n]]))
        return alpha

    def log10(self, word: str) -> float:
        return self.forward(SPACE + word)[-1] / _LN10

    def expect(self, word: str, count: float, into: dict[int, float]) -> None:
        """Add the expected number of uses of each piece in ``count`` occurrences of ``word``."""
        s = SPACE + word
        alpha, n, logp = self.forward(s), len(s), self.logp
        beta = [-math.inf] * (n + 1)
        beta[n], whole = 0.0, alpha[n]
        for i in range(n - 1, -1, -1):
            if alpha[i] == -math.inf:
                continue
            ways = [(sum([logp[p] for p in own]) + beta[j], own) for j, own in self.edges(s, i)]
            top = max([x for x, _ in ways])
            if top == -math.inf:
                continue
            beta[i] = top + math.log(sum([math.exp(x - top) for x, _ in ways]))
            for x, own in ways:
                share = count * math.exp(alpha[i] + x - whole)
                for p in own:
                    into[p] += share


class Batches:
    """The recursions of a ``Lattice`` over many words at once."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.widest = max((len(p) for p in lattice.pieces), default=1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.widest, self._BASE)]), dtype=np.uint64)
        # A piece's hash is that of its characters; hashes of one length are sorted for the search.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({len(p) for p in lattice.pieces}):
            own = [i for i, p in enumerate(lattice.pieces) if len(p) == k]
            h = self.hashes(np.array([lattice.pieces[i] for i in own]).view(np.uint32).reshape(len(own), k))[k - 1][:, 0]
            order = np.argsort(h)
            self.known[k] = h[order], np.array(own)[order]
        self.logp = np.array(lattice.logp)

    def hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length up to the widest, the hash of the substring of that length from each place."""
        n, m = codes.shape
        values = codes.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, m + 1), np.uint64)
        for j in range(m):
            prefix[:, j + 1] = prefix[:, j] * self._BASE + values[:, j]
        out = []
        for k in range(1, min(self.widest, m) + 1):
            out.append(prefix[:, k:] - prefix[:, :-k] * self.powers[k])
        return out

    def groups(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(places in ``texts``, characters as a matrix) of texts of one length; no matrix for long ones."""
        sizes = np.array([len(t) for t in texts])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, BATCH // (size * min(size, self.widest)))
            for low in range(0, len(own), step):
                at = own[low : low + step]
                yield at, None if size > LONG else np.array([texts[i] for i in at.tolist()]).view(np.uint32).reshape(len(at), size)

    def edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """For each length the piece at each place (-1: none); for each place the log probability of the
        bytes where its character is no piece (-inf elsewhere); the characters spelled so."""
        pieces = []
        for k, h in enumerate(self.hashes(codes), 1):
            if k not in self.known:
                pieces.append(np.full(h.shape, -1))
                continue
            keys, numbers = self.known[k]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            pieces.append(np.where(keys[at] == h, numbers[at], -1))
        own, which = np.unique(codes, return_inverse=True)
        spelled = np.array([sum(self.lattice.logp[self.lattice.base + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in own.tolist()])
        odd = np.where(pieces[0] < 0, spelled[which.reshape(codes.shape)], -np.inf)
        return pieces, odd, own, which.reshape(codes.shape)

    def forward(self, codes: np.ndarray, pieces: list[np.ndarray], odd: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log of the summed probability of each prefix, and the log probabilities of the pieces."""
        n, m = codes.shape
        logs = [np.where(p < 0, -np.inf, self.logp[p]) for p in pieces]
        logs[0] = np.where(pieces[0] < 0, odd, logs[0])
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0.0
        for j in range(1, m + 1):
            alpha[j] = _log_sum([alpha[j - k] + logs[k - 1][:, j - k] for k in range(1, min(j, len(logs)) + 1)])
        return alpha, logs

    def log10(self, words: list[str]) -> np.ndarray:
        """``Lattice.log10`` of each word."""
        texts = [SPACE + w for w in words]
        out = np.empty(len(texts))
        for at, codes in self.groups(texts):
            if codes is None:
                out[at] = [self.lattice.forward(texts[i])[-1] for i in at.tolist()]
            else:
                pieces, odd, _, _ = self.edges(codes)
                out[at] = self.forward(codes, pieces, odd)[0][-1]
        return out / _LN10

    def expect(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        """``Lattice.expect`` of all words: expected uses of pieces and bytes, added to ``into``."""
        texts = [SPACE + w for w in words]
        for at, codes in self.groups(texts):
            if codes is None:
                found: dict[int, float] = defaultdict(float)
                for i in at.tolist():
                    self.lattice.expect(words[i], float(counts[i]), found)
                for piece, x in found.items():
                    into[piece] += x
                continue
            n, m = codes.shape
            pieces, odd, own, which = self.edges(codes)
            alpha, logs = self.forward(codes, pieces, odd)
            beta = np.full((m + 1, n), -np.inf)
            beta[m] = 0.0
            for i in range(m - 1, -1, -1):
                beta[i] = _log_sum([beta[i + k] + logs[k - 1][:, i] for k in range(1, min(m - i, len(logs)) + 1)])
            weight = np.log(counts[at]) - alpha[m]
            for k, (p, log) in enumerate(zip(pieces, logs), 1):
                share = np.exp((alpha[: m + 1 - k] + beta[k:] + weight).T + log)
                there = p >= 0
                into += np.bincount(p[there], share[there], minlength=len(into))
                if k == 1 and not there.all():
                    by_char = np.bincount(which[~there], share[~there], minlength=len(own))
                    for c in np.flatnonzero(by_char).tolist():
                        for b in chr(int(own[c])).encode("utf-8", "surrogatepass"):
                            into[self.lattice.base + b] += by_char[c]


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials, place by place."""
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    top = x.max(axis=0)
    top[top == -np.inf] = 0.0
    x -= top
    np.exp(x, out=x)
    with np.errstate(divide="ignore"):
        return top + np.log(x.sum(axis=0))


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model in their order, without control, byte and white-space pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    own.sort(key=lambda i: -model.get_score(i))
    return [p for p in map(model.id_to_piece, own) if p.strip(SPACE)] + [SPACE]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train, held = Counter(), Counter()

    def out() -> pa.RecordBatch:
        both = list(train.keys() | held.keys())
        counts = [pa.array([c[w] for w in both], pa.int64()) for c in (train, held)]
        train.clear(), held.clear()
        return pa.RecordBatch.from_arrays([pa.array(both, pa.binary()).cast(pa.string()), *counts], ["word", "c", "held"])

    for batch in batches:
        for text, is_held in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held").to_pylist()):
            (held if is_held else train).update(words(text))
        if len(train) + len(held) > FLUSH:
            yield out()
    yield out()


def _expect(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Batches(lattice.value)
        found = np.zeros(own.lattice.base + 256)
        for batch in batches:
            own.expect(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float), found)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(found[used])], ["piece", "n"])

    return run


def _score_words(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Batches(lattice.value)
        for batch in batches:
            text = batch.column("word")
            h = word_hashes(text.cast(pa.binary()).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("c"), batch.column("n"), pa.array(own.log10(text.to_pylist()))], ["h", "c", "n", "lat"])

    return run


def _score_docs(top, log_end: float, end_c: int):
    schema = pa.schema(
        [("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lat", pa.float64()), ("h", pa.list_(pa.int64())), ("tf", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, lats = top.value
        logs = np.log10(counts + 0.1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = word_hashes(words(text)).view(np.int64)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0)) if len(hashes) else np.zeros(len(h), int)
                hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                rest, tf = np.unique(h[~hit], return_counts=True)
                at = at[hit]
                row = (
                    len(h) + 1,
                    int((counts[at] > 0).sum()) + int(end_c > 0),
                    float(logs[at].sum()) + math.log10(end_c + 0.1),
                    float(lats[at].sum()) + log_end,
                    rest,
                    tf,
                )
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), *(pa.array(c, schema.field(i + 2).type) for i, c in enumerate(cols))], schema=schema
            )

    return run


def score_documents(
    spark: SparkSession, docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, top_words: int = TOP_WORDS
) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``. A row is held out if the CRC-32 of its id as text leaves 0 modulo
    ``folds``; counts and piece probabilities come from all other rows.

    Tokens are the words (A-Z lower-cased) and one end. ``base_score`` sums log10 of
    (c + 0.1) / (N + 0.1 (V + 1)); ``score`` is log10 of the probability of the text under the lattice.

    Defined cases: a null or blank text is the end alone; a null id counts as empty text (held out);
    repeated rows are rows of their own; without training rows N and V are 0, and the pieces keep
    their prior; an empty table gives an empty table. Other columns aren't read.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    counted = texts.select("text", "held").mapInArrow(_count, "word string, c bigint, held bigint")
    vocab = stored(
        spark, counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum(F.col("c") + F.col("held")).alias("n")), "lm-words"
    )
    total = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    end_c = texts.where(~F.col("held")).count()
    n_all, n_kinds = (total[0] or 0) + end_c, (total[1] or 0) + int(end_c > 0)

    sc = spark.sparkContext
    first = Lattice(load_pieces(vocabulary))
    prior = first.prior()
    expected = vocab.where("c > 0").select("word", "c").mapInArrow(_expect(sc.broadcast(first)), "piece int, n double")
    uses = np.zeros(len(prior))
    for piece, n in expected.groupBy("piece").agg(F.sum("n")).collect():  # at most one row per piece
        uses[piece] = n
    uses[-1] = end_c
    p = (uses + PRIOR * prior) / (uses.sum() + PRIOR)
    lattice = Lattice(first.pieces, np.log(p[:-1]), math.log(p[-1]))

    scored = stored(
        spark,
        vocab.select("word", "c", "n").mapInArrow(_score_words(sc.broadcast(lattice)), "h bigint, c bigint, n bigint, lat double"),
        "lm-scored",
    )
    discard(vocab)
    # The most frequent words, as many whole classes of like frequency as the table has room for.
    level = F.floor(F.log2("n") * 8)
    cut, room = None, top_words
    for value, n in scored.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 64 rows
        if n > room:
            break
        cut, room = value, room - n
    if cut is None:
        top = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    else:
        table = scored.where(level >= cut).select("h", "c", "lat").toArrow()
        order = np.argsort(table["h"].to_numpy(), kind="stable")
        top = tuple(table[c].to_numpy()[order] for c in ("h", "c", "lat"))
    rows = stored(
        spark,
        texts.mapInArrow(
            _score_docs(sc.broadcast(top), lattice.log_end / _LN10, end_c),
            "id bigint, held boolean, n_tokens bigint, known bigint, base double, lat double, h array<bigint>, tf array<bigint>",
        ).withColumn("uid", F.monotonically_increasing_id()),
        "lm-rows",
    )
    rest = rows.select("uid", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("uid", "x.h", "x.tf")
    sums = (
        rest.join(scored.dropDuplicates(["h"]).select("h", "c", F.col("lat").alias("w")), "h")
        .groupBy("uid")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"),
            F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("base2"),
            F.sum(F.col("tf") * F.col("w")).alias("lat2"),
        )
    )
    unit = math.log10(n_all + 0.1 * (n_kinds + 1))
    return rows.drop("h", "tf").join(sums, "uid", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("lat") + F.coalesce("lat2", F.lit(0.0))).alias("score"),
    )
