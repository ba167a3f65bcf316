"""Hashes of words and word sequences of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(lane: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, _BASES[lane], np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, remembered up to 2^22."""
    rise, fall = _POWERS.get(lane, (_BLANK[:0], _BLANK[:0]))
    if len(rise) < n:
        rise = powers(lane, n)
        fall = np.full(n, pow(_BASES[lane], -1, 1 << 64), np.uint64)
        fall[:1] = 1
        fall = np.cumprod(fall, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[lane] = rise, fall
    return rise[:n], fall[:n]


class Words:
    """Words of texts: runs of characters other than blanks (space and 9 to 13), hashed by their bytes."""

    def __init__(self, texts: list[bytes], lanes: int = 1):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = _BLANK[data]
        before = np.concatenate([[True], blank[:-1]])
        self.start = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(blank & ~before)
        self.data = data
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: word numbers at which texts begin; one more for the end
        self.first = np.concatenate([[0], np.searchsorted(self.start, np.cumsum(sizes))])
        self.hash = [self._hash(lane) for lane in range(lanes)]

    def _hash(self, lane: int) -> np.ndarray:
        """Polynomials of the words' bytes, from sums over all bytes before a place, each times its own falling power."""
        values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * lane))[self.data]
        rise, fall = _both_powers(lane, len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(np.multiply(values, fall, out=values), dtype=np.uint64, out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * rise[self.end - 1])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds of each text); see ``sets`` for what a set is."""
    size = np.diff(words.first)
    word = words.hash[0]
    total = mixed(word)
    for i in range(1, n):
        total = mixed(total[: len(word) - i] * np.uint64(_BASES[1]) + word[i:]) if len(word) > i else total[:0]
    out, bounds = [], [0]
    for d, count in enumerate(size):
        a = words.first[d]
        if count >= n:
            own = np.sort(total[a : a + count - n + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            own = mixed(word[a : a + 1])
            for i in range(1, count):
                own = mixed(own * np.uint64(_BASES[1]) + word[a + i])
            own = mixed(own ^ np.uint64(count))  # apart from shingles of full length
        else:
            own = word[:0]
        out.append(own)
        bounds.append(bounds[-1] + len(own))
    return (np.concatenate(out) if out else word[:0]), np.array(bounds)
