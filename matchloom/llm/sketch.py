"""Word shingles and MinHash signatures, vectorised with NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that give each place in a shingle its own weight.
_PLACES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EMPTY = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(tokens: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of all words as one."""
    n = len(tokens)
    if not n:
        return _EMPTY
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n))
    size = min(n, k)
    total = h[: n - size + 1] * _PLACES[0]
    for i in range(1, size):
        total = total + h[i : n - size + 1 + i] * _PLACES[i]
    return np.unique(mix(total ^ np.uint64(size)))


class MinHash:
    """``n`` strongly universal hashes (multiply, add, shift: 32 bits to 32 bits) and their minima."""

    def __init__(self, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.n = n
        self.a = rng.integers(0, 2**64, (n, 1), dtype=np.uint64)
        self.b = rng.integers(0, 2**64, (n, 1), dtype=np.uint64)

    def __call__(self, sets: np.ndarray, block: int = 2048) -> np.ndarray:
        """Minima over one non-empty set of 64-bit hashes, block by block in bounded memory."""
        low = np.full(self.n, 2**64 - 1, np.uint64)
        x = sets & np.uint64(0xFFFFFFFF)
        for i in range(0, len(x), block):
            y = self.a * x[i : i + block]
            y += self.b
            np.minimum(low, y.min(axis=1), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)
