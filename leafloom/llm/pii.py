"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans.

The patterns (``base_spans``) give the spans that must be found. The field scores whole candidate
segments by features of the span (digit groups, check sum, separators, what stands before and after)
and chooses boundaries and kinds jointly, by dynamic programming over segments of bounded length. Its
spans are added where they overlap none of the patterns' spans.

It is trained here, by maximum likelihood, on ``SAMPLE_ROWS`` texts at most. What the patterns find is
the truth there; copies of those places with the country code left out or with other separators are
truth too, and so are copies in which a second span follows the first: the field learns the forms of
a number, and to part two that a pattern takes for one.

Texts are scanned where they lie; nothing is shuffled. Only stretches around digits and at-signs are
run through the field: a segment must hold one, so everything else is outside of every span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in their order, and their patterns. They are written so that a long run of
# characters is read once; each finds what the plain pattern in its comment finds.
KINDS = ("email", "ip", "card", "phone")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# [0-9]([\x20-]?[0-9])+
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
# \+[0-9][\x20().0-9-]+[0-9]
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

#: Bounds: texts of the training sample, parts of each, a segment's atoms and characters.
SAMPLE_ROWS, SAMPLE_PARTS, MAX_ATOMS, MAX_CHARS = 4_000, 20, 24, 64
#: A segment of the field's own must score so much above leaving it out.
MARGIN = 2.0
EPOCHS, RATE, RIDGE = 4, 0.3, 1e-4
#: How far apart in the sample the spans are that are joined in training.
JOIN_STEP = 7919

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlaps for each kind, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the field -------------------------------------------------------------------------------------

_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_LEGAL = re.compile(r"[A-Za-z0-9@._%+(-]")
_STRETCH = re.compile(r"(?:[A-Za-z0-9@._%+()-]*[0-9@][A-Za-z0-9@._%+()-]*[\x20]?)+")


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text in which spans can lie: legal characters around digits and at-signs."""
    end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and m.start() - start < MAX_CHARS and _LEGAL.match(text, start - 1):
            start -= 1
        # Words without a digit or an at-sign end the stretch.
        last = _STRETCH.match(text, m.start())
        end = last.end()
        yield start, end


def features(text: str, start: int, end: int) -> tuple[list[str], list[int]]:
    """Features of the segment and the kinds it may have; no kinds if it can't be a span at all."""
    span = text[start:end]
    first, last = span[0], span[-1]
    if not (last.isalnum() or last == ")") or not (first.isalnum() or first in "+("):
        return [], []
    digits = _digits(span)
    letters = any(c.isalpha() for c in span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    if "@" in span:
        if " " in span or "(" in span or span.count("@") != 1:
            return [], []
        kinds = [0]
        domain = span.rpartition("@")[2]
        own = [f"dots:{min(domain.count('.'), 3)}", f"tld:{min(len(domain.rpartition('.')[2]), 5)}", f"local:{min(span.index('@'), 4)}"]
    else:
        if letters or not digits or len(digits) > 19 or len(digits) < 4:
            return [], []
        groups = re.findall(r"[0-9]+", span)
        own = [f"n:{len(digits)}", "groups:" + "-".join(str(min(len(g), 9)) for g in groups[:6]), f"count:{min(len(groups), 6)}"]
        kinds = []
        if span.count(".") == 3 and len(groups) == 4 and marks == ".":
            kinds.append(1)
            own.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        if len(digits) >= 13:
            kinds.append(2)
            own.append(f"luhn:{luhn(digits)}")
        if 7 <= len(digits) <= 15:
            kinds.append(3)
    if not kinds:
        return [], []
    before, after = text[start - 1 : start], text[end : end + 1]
    own += [f"marks:{marks}", f"first:{first if first in '+(' else 'x'}"]
    own += [f"before:{'alnum' if before.isalnum() else before}", f"after:{'alnum' if after.isalnum() else after if after and after in '.,@+-_' else 'other'}"]
    word = (text[max(0, start - 24) : start].split() or [""])[-1]
    own.append("word:" + re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", word))[-8:])
    return [*own, "any"], kinds


class SemiCrf:
    """Weights of (kind, feature) pairs; a segment's score is the sum of its features' weights, all
    else scores 0. Segments follow each other freely."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def candidates(self, text: str, low: int, high: int) -> tuple[list[int], list[list[tuple[int, int, list[str]]]]]:
        """Boundaries of the atoms, and for each atom the segments (end atom, kind, features) from it."""
        cuts = [low, *(m.end() for m in _ATOM.finditer(text, low, high))]
        n = len(cuts) - 1
        out: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(n)]
        for i in range(n):
            c = text[cuts[i]]
            if not (c.isalnum() or c in "+(") or (cuts[i] and c.isalnum() and text[cuts[i] - 1].isalnum()):
                continue
            for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
                if cuts[j] - cuts[i] > MAX_CHARS:
                    break
                if cuts[j] < len(text) and text[cuts[j]].isalnum() and text[cuts[j] - 1].isalnum():
                    continue
                own, kinds = features(text, cuts[i], cuts[j])
                out[i] += [(j, k, own) for k in kinds]
        return cuts, out

    def score(self, kind: int, own: list[str]) -> float:
        get = self.weights.get
        return sum([get((kind, f), 0.0) for f in own])

    def decode(self, text: str) -> list[Span]:
        """The best segmentation: entities that beat the margin, boundaries and kinds chosen jointly."""
        spans: list[Span] = []
        for low, high in stretches(text):
            cuts, ways = self.candidates(text, low, high)
            n = len(ways)
            if not any(ways):
                continue
            best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
            for i in range(n):
                if best[i] >= best[i + 1]:
                    best[i + 1], back[i + 1] = best[i], None
                for j, kind, own in ways[i]:
                    x = best[i] + self.score(kind, own) - MARGIN
                    if x > best[j]:
                        best[j], back[j] = x, (i, kind)
            j = n
            while j > 0:
                if back[j] is None:
                    j -= 1
                else:
                    i, kind = back[j]
                    spans.append((cuts[i], cuts[j], kind))
                    j = i
        return sorted(spans)

    def learn(self, text: str, truth: list[Span], squares: dict[tuple[int, str], float]) -> None:
        """One AdaGrad step of the log-likelihood on each stretch, by forward and backward sums over
        all segmentations."""
        gold = set(truth)
        for low, high in stretches(text):
            cuts, ways = self.candidates(text, low, high)
            n = len(ways)
            if not any(ways):
                continue
            scored = [[(j, k, own, self.score(k, own)) for j, k, own in w] for w in ways]
            fore = [0.0] + [-math.inf] * n
            for i in range(n):
                fore[i + 1] = _plus(fore[i + 1], fore[i])
                for j, _, _, x in scored[i]:
                    fore[j] = _plus(fore[j], fore[i] + x)
            aft = [-math.inf] * n + [0.0]
            for i in range(n - 1, -1, -1):
                aft[i] = aft[i + 1]
                for j, _, _, x in scored[i]:
                    aft[i] = _plus(aft[i], aft[j] + x)
            slope: dict[tuple[int, str], float] = defaultdict(float)
            for i, w in enumerate(scored):
                for j, k, own, x in w:
                    d = ((cuts[i], cuts[j], k) in gold) - math.exp(fore[i] + x + aft[j] - fore[n])
                    if abs(d) > 1e-6:
                        for f in own:
                            slope[k, f] += d
            for key, d in slope.items():
                d -= RIDGE * self.weights.get(key, 0.0)
                squares[key] += d * d
                self.weights[key] = self.weights.get(key, 0.0) + RATE * d / math.sqrt(squares[key])


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _varied(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with phones without their country code and cards with other separators, and where its
    spans are then."""
    out, moved, at = [], [], 0
    length = 0
    for start, end, kind in spans:
        out.append(text[at:start])
        length += start - at
        span = text[start:end]
        if kind == 3 and (rest := re.sub(r"^\+[0-9]{1,3}[ .-]+", "", span)) != span and len(_digits(rest)) >= 7:
            span = rest
        elif kind == 2 and span.isdigit() and len(span) == 16:
            span = ".".join(span[i : i + 4] for i in range(0, 16, 4))
        out.append(span)
        moved.append((length, length + len(span), kind))
        length += len(span)
        at = end
    return "".join([*out, text[at:]]), moved


def _joined(text: str, spans: list[Span], pool: list[tuple[str, int]], first: int) -> tuple[str, list[Span]]:
    """The text with one more span of ``pool``, from number ``first`` on, after each of its spans and a
    space, and where all are then. Digits that meet so are one number to a pattern, but not to the field."""
    out, moved, at, length = [], [], 0, 0
    for i, (start, end, kind) in enumerate(spans):
        more, more_kind = pool[(first + i) % len(pool)]
        out += [text[at:end], " ", more]
        moved.append((length + start - at, length + end - at, kind))
        length += end - at + 1
        moved.append((length, length + len(more), more_kind))
        length += len(more)
        at = end
    return "".join([*out, text[at:]]), moved


def disjoint(spans: list[Span]) -> list[Span]:
    """Of overlapping spans the longest, then the first."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in out):
            out.append(s)
    return sorted(out)


def fit(texts: list[str]) -> SemiCrf:
    """A field fitted to the texts: as the patterns see them, with varied spans, and with a second span
    after each, every other one varied too."""
    cases = [(t, disjoint(base_spans(t))) for t in texts]
    held = [(t, s) for t, s in cases if s]
    pool = [(t[start:end], kind) for t, s in held for start, end, kind in s]
    joined = [_joined(t, s, pool, JOIN_STEP * (k + 1)) for k, (t, s) in enumerate(held)]
    cases += [_varied(t, s) for t, s in held]
    cases += [_varied(*case) if k % 2 else case for k, case in enumerate(joined)]
    model, squares = SemiCrf(), defaultdict(lambda: 1e-8)
    for _ in range(EPOCHS):
        for text, spans in cases:
            model.learn(text, spans, squares)
    return model


def train(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> SemiCrf:
    """Fit the field to stretches of ``sample_rows`` texts at most that hold a digit or an at-sign,
    chosen by a hash of the id; of each text ``SAMPLE_PARTS`` stretches at most, drawn by hash from the
    whole of it. Without any, the field has no weights and adds nothing."""
    held = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    chosen = held.select("h").orderBy("h").limit(sample_rows).distinct()
    every = F.regexp_extract_all("text", F.lit(r"(?s)[^0-9@]{0,40}[0-9@].{0,80}"), F.lit(0))
    drawn = F.slice(F.array_sort(F.transform(every, lambda p, i: F.struct(F.xxhash64("h", i).alias("place"), p.alias("part")))), 1, SAMPLE_PARTS)
    parts = F.transform(drawn, lambda x: x["part"])
    rows = held.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("h", parts.alias("parts")).orderBy("h").collect()
    return fit([p for r in rows for p in r.parts])


def find_spans(text: str | None, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans) of a text, by start and then kind."""
    text = text or ""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    taken = {i for start, end, _ in base for i in range(start, end)}
    own = [s for s in model.decode(text) if taken.isdisjoint(range(s[0], s[1]))]
    return base, sorted([*base, *own], key=lambda s: (s[0], s[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in spans)


def _scan(model):
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: SemiCrf = model.value
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            hashes, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text, field)
                for k, c in enumerate(counts):
                    c.append(sum(s[2] == k for s in base))
                hashes.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(every))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names)

    return run


def find_personal_data(spark: SparkSession, docs: DataFrame, model: SemiCrf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` (of the
    patterns), ``base_sha256`` (of the patterns' spans) and ``spans`` (all, as kind:start:end in code
    points, comma-joined by start and then kind).

    Defined cases: null and empty texts have no spans; null and repeated ids are rows of their own; an
    empty table gives an empty table. Other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(texts.dtypes)['id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return texts.mapInArrow(_scan(spark.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)
