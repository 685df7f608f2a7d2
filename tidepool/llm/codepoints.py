"""Texts as flat arrays of code points: character classes, hashes of runs, and a hash table for whole arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import regex

from tidepool.llm.shared import mix64

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Odd; the base of run hashes, the same in every worker.
BASE = 0x9E3779B97F4A7C15
_ANY_SPACE = regex.compile(r"\s")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by Unicode's general categories and white space."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def pieces(text: str, most: int) -> Iterator[str]:
    """The whole text in parts of about `most` characters, each cut before white space; a longer run without any stays whole."""
    start = 0
    while len(text) - start > most:
        m = _ANY_SPACE.search(text, start + most)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


@functools.cache
def _mixed() -> np.ndarray:
    """A random-looking 64-bit value for each code point."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._row(b, size) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_powers = Powers()


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each range of code points, whatever stands around it.

    Two different runs share one with probability 2^-64 or so: among 10^10 different
    runs against a table of 3 x 10^5 a mix-up is expected in 2 of 10^4 corpora.
    """
    up, down = _powers.get(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed()[points] * up[:-1], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    h[h == 0] = 1
    return h


def deletion_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, left-out place and hash of every run without one of its code points, hashed as run_hashes would hash the shorter run.

    A run's hash is a polynomial in BASE, so a deletion's is that of the prefix before it
    plus that of the suffix after it moved down by one power: two differences of one row of sums.
    """
    up, down = _powers.get(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed()[points] * up[:-1], out=sums[1:])
    size = ends - starts
    run = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    a, b = starts[run], ends[run]
    prefix, suffix = sums[a + place] - sums[a], sums[b] - sums[a + place + 1]
    h = mix64(prefix * down[a] + suffix * down[a + 1] + (size[run] - 1).astype(np.uint64))
    h[h == 0] = 1
    return run, place, h


class HashTable:
    """Hashes (not 0) to small numbers, by open addressing in flat arrays; looks up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(np.asarray(keys, np.uint64), return_index=True)
        values = np.asarray(values)[first]
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that the table lacks."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            here = self.keys[at]
            hit = here == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (here != 0)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out
