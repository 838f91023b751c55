"""A longest common subsequence of two sequences, exact at any length; used inside tasks.

The lengths of common subsequences are kept as differences along a row of the usual table: one bit per
element of ``b``, zero where the length grows. A row follows from the one before by an addition and
three logical operations on whole integers (Hyyrö, "Bit-parallel LCS-length computation revisited",
2004), so the time falls with the machine's word and the memory of a row is ``len(b)`` bits. Only every
``sqrt(len(a))``-th row is kept; the way back makes the rows between two of them once more.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from functools import lru_cache


def _next_row(row: int, mask: int, full: int) -> int:
    return ((row + (row & mask)) | (row & ~mask)) & full


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of positions (in ``a``, in ``b``) of a longest common subsequence, rising. None matches
    nothing. Read from the end: equal elements pair up; else an element of ``b`` is passed over if that
    costs nothing, and otherwise one of ``a``."""
    a = [object() if x is None else x for x in a]
    n, m = len(a), len(b)
    places: dict[Hashable, list[int]] = {}
    for j, y in enumerate(b):
        if y is not None:
            places.setdefault(y, []).append(j)
    full, size = (1 << m) - 1, m // 8 + 1

    @lru_cache(maxsize=64)
    def mask(x: Hashable) -> int:
        bits = bytearray(size)
        for j in places.get(x, ()):
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    step = max(1, math.isqrt(n))
    kept, row = [full], full  # the rows before elements 0, step, 2 * step, ...
    for i, x in enumerate(a, 1):
        if x in places:
            row = _next_row(row, mask(x), full)
        if i % step == 0:
            kept.append(row)

    out: list[tuple[int, int]] = []
    j = m
    for block in range((n - 1) // step, -1, -1):
        low, high = block * step, min(n, (block + 1) * step)
        row, rows = kept[block], []
        for x in a[low:high]:
            if x in places:
                row = _next_row(row, mask(x), full)
            rows.append(row)
        for i in range(high - 1, low - 1, -1):
            if not j:
                return out[::-1]
            bits = rows[i - low].to_bytes(size, "little")
            while j and a[i] != b[j - 1] and bits[(j - 1) >> 3] >> ((j - 1) & 7) & 1:
                j -= 1  # the length doesn't grow here
            if j and a[i] == b[j - 1]:
                j -= 1
                out.append((i, j))
    return out[::-1]
