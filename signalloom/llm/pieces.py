"""Token ids of pieces of text that were met before, kept by a worker within a bound."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import repeat

import numpy as np


class PieceIds:
    """The ids of at most about ``limit`` pieces, end to end in one array, so that a text's ids are one gather.

    When the bound is met, the pieces of the texts at hand stay and the others go. ``fixed`` pieces always stay.
    """

    def __init__(self, limit: int, fixed: Mapping[str, Sequence[int]] | None = None):
        self.limit, self.fixed = limit, dict(fixed or {})
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4"), 0
        self._add(list(self.fixed), list(self.fixed.values()))

    def _add(self, pieces: list[str], coded: Sequence[Sequence[int]]) -> None:
        at, count = len(self.place), np.fromiter(map(len, coded), np.int64, len(pieces))
        total = int(count.sum())
        while at + len(pieces) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.first[at : at + len(pieces)] = self.used + np.cumsum(count) - count
        self.count[at : at + len(pieces)] = count
        self.ids[self.used : self.used + total] = [i for ids in coded for i in ids]
        self.used += total
        self.place.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def gather(self, texts: Sequence[list[str]], learn: Callable[[list[str]], Sequence[Sequence[int]]]) -> list[np.ndarray]:
        """ids of each text, given as its pieces; learn encodes those that are new."""
        place = self._places(texts)
        new = list({t[i] for t, at in zip(texts, place, strict=True) for i in np.flatnonzero(at < 0).tolist()})
        if len(self.place) + len(new) > self.limit:
            self._reset()
            new = list(set().union(*texts) - self.place.keys())
            place = [np.full(len(t), -1) for t in texts]
        if new:
            self._add(new, learn(new))
            for t, at in zip(texts, place, strict=True):
                unknown = np.flatnonzero(at < 0)
                at[unknown] = [self.place[t[i]] for i in unknown.tolist()]
        out = []
        for at in place:
            count = self.count[at]
            start = self.first[at] - np.cumsum(count) + count
            out.append(self.ids[np.repeat(start, count) + np.arange(count.sum())])
        return out

    def find(self, pieces: list[str], learn: Callable[[list[str]], Sequence[Sequence[int]]]) -> np.ndarray:
        """The places of distinct pieces; learn encodes those that are new."""
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(self.place) + np.count_nonzero(at < 0) > self.limit:
            self._reset()
            at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = [pieces[i] for i in new.tolist()], len(self.place)
            self._add(fresh, learn(fresh))
            at[new] = np.arange(first, first + len(new))
        return at

    def ids_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, end to end, and how many each has."""
        count = self.count[at]
        start = self.first[at] - np.cumsum(count) + count
        return self.ids[np.repeat(start, count) + np.arange(count.sum())], count

    def _places(self, texts: Sequence[list[str]]) -> list[np.ndarray]:
        """The place of each piece, -1 where it is new."""
        return [np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces)) for pieces in texts]
