"""128-bit hashes of words and of runs of words, computed on whole batches of texts.

A word's hash is its XXH3 of 128 bits, taken as two of 64, the families. A run's is built by doubling: the hashes of all runs of
one, two, four words and so on, each of two halves, mixed by multiplications and shifts that do not commute; a run of any
length is put together of such runs, the longest first, and its length. Nothing in it is linear, as a polynomial modulo a power
of two would be, which has equal hashes for pairs of long patterned texts whatever its base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

FAMILIES = 2
#: Odd numbers without a pattern, of which each family has its own: for the left half, the right half, and the two mixing steps.
FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (FAMILIES, 4), np.uint64) * np.uint64(2) + np.uint64(1)
TURN, BACK, HALF = np.uint64(23), np.uint64(41), np.uint64(32)


class Sums:
    """Hashes of any runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, family: int):
        self.factors, self.levels = FACTORS[family], [np.ascontiguousarray(values, np.uint64)]

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b, c, d = self.factors
        h = left * a
        h ^= (right << TURN) | (right >> BACK)
        h *= b
        h ^= h >> HALF
        h += right * c
        h ^= h >> HALF
        h *= d
        h ^= h >> HALF
        return h

    def _level(self, bit: int) -> np.ndarray:
        """The hashes of all runs of 2**bit values."""
        while len(self.levels) <= bit:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            size = max(len(last) - half, 0)
            self.levels.append(self._join(last[:size], last[half : half + size]))
        return self.levels[bit]

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of values[start:end] for each pair."""
        at, n = np.array(start, np.int64), np.asarray(end, np.int64) - start
        found = n.astype(np.uint64)
        for bit in reversed(range(int(n.max(initial=0)).bit_length())):
            level = self._level(bit)
            if (n >> bit & 1).all():
                found = self._join(found, level[at])
                at += 1 << bit
            else:
                which = np.flatnonzero(n >> bit & 1)
                found[which] = self._join(found[which], level[at[which]])
                at[which] += 1 << bit
        return found

    def every(self, n: int) -> np.ndarray:
        """The hashes of all runs of n values."""
        start = np.arange(len(self.levels[0]) - n + 1)
        return self.runs(start, start + n)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, between ASCII white space, and the bounds of each text among them; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    said = np.not_equal(pc.binary_length(words).to_numpy(zero_copy_only=False), 0)
    if not said.all():
        words, bounds = words.filter(pa.array(said)), np.concatenate([[0], np.cumsum(said)])[bounds]
    return words, bounds


def hashes(words: pa.Array) -> list[np.ndarray]:
    """The hashes of words, an array for each family; a word that a batch repeats is hashed once."""
    if not len(words):
        return [np.empty(0, np.uint64)] * FAMILIES
    coded, digest = words.dictionary_encode(), xxhash.xxh3_128_digest
    said = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_pylist()
    both = np.frombuffer(b"".join([digest(w) for w in said]), np.uint64).reshape(-1, FAMILIES)
    which = coded.indices.to_numpy()
    return [np.ascontiguousarray(both[:, f])[which] for f in range(FAMILIES)]


def sliding_first_least(values: np.ndarray, n: int) -> np.ndarray:
    """For every run of n values the place of its smallest one, the first of equals."""
    at, span = np.arange(len(values)), 1
    while span < n:
        step = min(span, n - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def slices(texts: pa.Array, most: int):
    """(start, end) of runs of texts of about so many bytes at most; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, start = np.concatenate([[0], np.cumsum(size)]), 0
    while start < len(size):
        end = max(int(np.searchsorted(before, before[start] + most, "right")) - 1, start + 1)
        yield start, min(end, len(size))
        start = end
