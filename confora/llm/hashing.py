"""Vectorised 64-bit hashes of words and of stretches.

``Fingerprints`` are polynomials modulo 2**64: quick, and enough to place and prune, but long self-similar sequences can share them (from 1,024 symbols on, at any odd
point). Where a hash stands for content, ``Identities`` are used: the polynomial's values at two points modulo the prime 2**31 - 1, one for each half of the symbols.
"""

from __future__ import annotations

import numpy as np
import xxhash

P1 = np.uint64(0x9E3779B97F4A7C15)
#: The modulus of identities, a Mersenne prime, and their two points.
PRIME, BITS = np.uint64((1 << 31) - 1), np.uint64(31)
POINTS = (1_103_515_245, 1_664_525_123)
#: Powers are kept up to this length; longer texts make their own and let them go.
KEPT_POWERS = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash for each word (str or bytes)."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & PRIME) + (x >> BITS)
    x = (x & PRIME) + (x >> BITS)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(point: int, n: int, prime: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """point**i and point**-i for i up to n, modulo 2**64 or the prime."""
    known = _powers.get(point)
    if known is None or len(known[0]) <= n:
        size, tables = max(1 << 16, 1 << int(n + 1).bit_length()), []
        modulus = prime or 1 << 64
        for base in (point, pow(point, -1, modulus)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                more = table * np.uint64(pow(base, len(table), modulus))
                table = np.concatenate([table, reduced(more) if prime else more])
            tables.append(table)
        known = tuple(tables)
        if size <= KEPT_POWERS:
            _powers[point] = known
    return known


class Fingerprints:
    """Hashes of any stretch of a symbol sequence, from prefix sums. Equal stretches have equal ones; the converse is not relied on."""

    def __init__(self, symbols: np.ndarray, point: np.uint64 = P1):
        up, self.down = powers(int(point), len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def at(self, starts: np.ndarray, width) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.down[starts])


class Identities:
    """Hashes of stretches that stand for their content: 62 bits modulo a prime, mixed."""

    def __init__(self, symbols: np.ndarray):
        self.sums, self.down, n = [], [], len(symbols)
        for point, half in zip(POINTS, (symbols & PRIME, symbols >> np.uint64(33))):
            up, down = powers(point, n + 1, int(PRIME))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(reduced(reduced(half) * up[:n]), out=sums[1:])  # below 2**63 for texts of less than 2**32 symbols
            self.sums.append(reduced(sums))
            self.down.append(down)

    def at(self, starts: np.ndarray, width) -> np.ndarray:
        low, high = (reduced(reduced(s[starts + width] + PRIME - s[starts]) * d[starts]) for s, d in zip(self.sums, self.down))
        return mix(low | high << np.uint64(32))


_letters: list[np.ndarray] = []


def is_word() -> np.ndarray:
    """For every code point, whether ``\\w`` matches it: letters, digits and the underscore."""
    if not _letters:
        _letters.append(np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000))
    return _letters[0]


def hashes_of_words(text: str) -> np.ndarray:
    """A 64-bit hash for each lower-cased ``\\w+`` word of ``text``, in order, without a Python object per word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = is_word()[codes]
    edges = np.diff(inside)
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    return Identities(mix(codes + P1)).at(starts, ends - starts)
