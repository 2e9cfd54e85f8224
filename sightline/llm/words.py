"""Word and word n-gram hashes of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes outside [\\x20\\x09-\\x0D]: what ``bytes.split`` gives."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = out * PRIME + hashes[k : k + count]
    return mixed(out)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of all words as one if there are fewer.

    A-Z are lower-cased (``bytes.lower`` touches nothing else).
    """
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))
