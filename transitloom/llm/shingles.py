"""Sets of word shingles as sorted arrays of 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are hashed against all multipliers at once; bounds a very long text's memory.
BLOCK = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles.

    A-Z are lower-cased, words lie between ASCII white space; a text of fewer words is one
    shingle, and one without words has none.
    """
    found = text.lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not found:
        return np.array([], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(words, len(hashes))
    out = np.full(len(hashes) - span + 1, span, np.uint64)
    for k in range(span):
        out = out * MULTIPLIER + hashes[k : len(hashes) - span + 1 + k]
    return np.unique(mix(out))


def set_key(prints: np.ndarray) -> bytes:
    return hashlib.blake2b(prints.tobytes(), digest_size=16).digest()


def multipliers(size: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(prints: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The high 32 bits of the smallest product with each multiplier; of no shingles, all ones."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(prints), BLOCK):
        np.minimum(least, (prints[at : at + BLOCK, None] * by).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
