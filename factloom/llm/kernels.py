"""Words of many texts as hashes: numpy over the UTF-8 bytes of an Arrow column, no Python strings.

A word is a maximal run of bytes other than blank and \\x09-\\x0D.  Its hash is a polynomial over
random 64-bit values of its bytes, taken from prefix sums and mixed; sequences of words are hashed
the same way from the words' hashes.  Different sequences agree with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i, starting with 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:], dtype=np.uint64)
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of the spans [start, end) of what ``sums`` is the prefix of."""
    flat = (sums[end] - sums[start]) * powers(base, len(sums))[1][start]
    return mix(flat + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))


class Words:
    """Words of the texts in one piece of a batch.

    ``start``/``end``: byte positions of each word; ``at``: word positions where each text begins (one
    more at the end); ``hash``: hash of each word.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        letter = ~_BLANK[raw]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        edges = at[(at > 0) & (at < len(raw))]
        first[edges] = letter[edges]
        last[edges - 1] = letter[edges - 1]
        self.raw, self.start, self.end = raw, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, at)
        table = _LOWER if lower else _BYTE
        self.hash = spans(prefix(table[raw], _BASES[0]), self.start, self.end, _BASES[0])
        self.texts = len(at) - 1

    def sums(self, base: int = 1) -> np.ndarray:
        return prefix(self.hash, _BASES[base])

    def text_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.at))

    def windows(self, size: int, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        begin = np.arange(max(0, len(self.hash) - size + 1))
        ends = np.repeat(self.at[1:], np.diff(self.at))[: len(begin)]
        begin = begin[begin + size <= ends]
        return begin, spans(self.sums(base), begin, begin + size, _BASES[base])


def sequences(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the word spans [start, end)."""
    return tuple(spans(words.sums(b), start, end, _BASES[b]) for b in (1, 2))
