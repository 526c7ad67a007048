"""Words of many texts as numpy arrays of 64-bit hashes.

A word is a maximal run of letters and digits, lower-cased. One call works on a whole Arrow batch: the texts are
joined, classified by table lookup and hashed by prefix sums, without a Python loop over words. Hashes depend on the
words only, never on the process, so they can be compared across executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


class _Powers:
    """Powers of the radix and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            series = []
            for base in (_RADIX, _RADIX_INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                series.append(np.multiply.accumulate(steps))
            self.up, self.down = series
        return self.up[:n], self.down[:n]


_powers = _Powers()


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` of mixed 64-bit values, equal for equal runs."""
    up, down = _powers.get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """``hashes`` of all words in order; text i has words ``bounds[i]:bounds[i + 1]``; word j spans code points
    ``starts[j]:ends[j]`` of the lower-cased joined text, in which text i begins at ``offsets[i]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    joined: str

    def strings(self, first: int, last: int) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.starts[first:last], self.ends[first:last])]

    def text_of(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within one text, and the number of each one's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total, factor = np.zeros(n, np.uint64), 1
        for t in range(k):
            total += self.hashes[t : t + n] * np.uint64(factor)
            factor = factor * _STEP % (1 << 64)
        room = np.repeat(self.bounds[1:], np.diff(self.bounds))[:n]
        first = np.arange(n)
        keep = first + k <= room
        return mix(total[keep]), first[keep]


def words_of(texts: Sequence[str | None]) -> Words:
    """None counts as an empty text."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(lowered)
    points = code_points(joined)
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = word_characters()[points]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    hashes = run_hashes(mix(points.astype(np.uint64) + np.uint64(0x51ED27)), starts, ends)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, offsets, joined)
