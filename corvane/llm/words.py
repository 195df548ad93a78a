"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, no Python object per word.

A word is a run of bytes outside `common.SPACES`; no byte of a longer UTF-8 character is among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corvane.llm.common import is_space, mixed

BASE = 0x9E3779B97F4A7C15
SECOND = 0xD6E8FEB86659FD93
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """begin and end: bytes of each word; of: its row; first: each row's first word, and the number of words at the end."""

    begin: np.ndarray
    end: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~is_space(data)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        first = np.searchsorted(begin, offsets)
        return cls(begin, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word: Rabin's polynomial over its bytes, then scrambled with its length."""
        up, down = powers(BASE, len(data)), powers(_INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mixed((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))


def rolling(words: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all `n` neighbouring words, from prefix sums modulo 2 ** 64."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words)), powers(pow(base, -1, 1 << 64), len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return (sums[n:] - sums[:-n]) * down[: len(words) - n + 1]


_POWERS: dict[int, np.ndarray] = {}


class Sums:
    """Prefix sums of Rabin's polynomial over numbers, for the hash of any run of them."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.inverse = pow(base, -1, 1 << 64)
        for b in (base, self.inverse):
            if len(_POWERS.get(b, ())) <= len(data):
                _POWERS[b] = powers(b, max(len(data), 1 << 18))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[base][: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A scrambled hash of each run and its length."""
        return mixed((self.sums[end] - self.sums[begin]) * _POWERS[self.inverse][begin] + (end - begin).astype(np.uint64))


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    return Sums(data, base).of(begin, end)
