"""Word shingles of UTF-8 texts as 64-bit numbers, and MinHash over them; used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from leafloom.llm.common import LOWER_BYTES

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased."""
    return (text or b"").translate(LOWER_BYTES).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def longer(runs: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Runs of words with one more word each; ``mix`` of a run is the hash that ``ngrams`` gives it."""
    return runs * _STEP + following


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words, in order; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = hashes[:n].copy()
    for i in range(1, size):
        h *= _STEP
        h += hashes[i : i + n]
    return mix(h)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingles. Fewer words than ``size`` make one shingle, no words make none."""
    hashes = word_hashes(words(text))
    if not len(hashes):
        return hashes
    return np.unique(ngrams(hashes, min(size, len(hashes))))


class MinHash:
    """Signatures of ``size`` coordinates (a power of two). The low bits of a value hold its
    coordinate, so that a value names a coordinate-value pair."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size = size
        self.mul = rng.integers(1, 2**63, (size, 1), dtype=np.uint64) | np.uint64(1)
        self.xor = rng.integers(0, 2**63, (size, 1), dtype=np.uint64)
        self.low = np.arange(size, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(self.size, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 4096):  # bounds the memory that a long text takes
            h = (shingles[None, at : at + 4096] ^ self.xor) * self.mul
            h ^= h >> np.uint64(32)
            h *= self.mul
            np.minimum(best, h.min(axis=1), out=best)
        return (best & ~np.uint64(self.size - 1)) | self.low
