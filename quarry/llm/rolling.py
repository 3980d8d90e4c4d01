"""Rabin-Karp hashes of every window of a token array, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Odd multipliers modulo 2**64, so each has an inverse.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & _MASK, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Hashes:
    """Prefix sums from which the hash of any window follows in constant time."""

    def __init__(self, tokens: np.ndarray, base: int) -> None:
        self.base, n = base, len(tokens)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(tokens * power(pow(base, -1, 1 << 64), n), out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Mixed hash of the window that starts at each position."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[width:] - self.sums[:n]) * power(self.base, n))

    def at(self, starts: np.ndarray, widths) -> np.ndarray:
        raw = (self.sums[starts + widths] - self.sums[starts]) * power(self.base, len(self.sums))[starts]
        return mix(raw + U(0x632BE59BD9B4E019) * np.asarray(widths).astype(U))


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    reach, m = 1, x
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U, count=len(words))


#: Of each byte value, by the same rule as for words.
BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], dtype=U)
