"""Word shingles of whole texts and their MinHash signatures (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at the ASCII blanks 0x20 and 0x09-0x0D, both as bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_key(found: list[bytes]) -> bytes:
    """Equal word sequences, and only they, share this digest."""
    return xxh3_128_digest(b" ".join(found))


def shingle_set(found: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word ``size``-grams; a shorter sequence is one shingle."""
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < size:
        return np.array([xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    hashes = np.array(list(map(xxh3_64_intdigest, found)), np.uint64)
    count = len(found) - size + 1
    mixed = np.zeros(count, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + count]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    pair = rng.integers(0, 2**64, (2, count), dtype=np.uint64)
    return pair[0] | np.uint64(1), pair[1]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each permutation 16 bits of the smallest permuted hash, over all shingles in slices."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        np.minimum(least, (a[:, None] * part + b[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)
