"""A bounded per-worker memory of pieces of text and their token ids, and batch encoding with it."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np

from .common import ragged, spans_of

MOST_PIECES = 300_000


class PieceMemory:
    """piece -> ids, in flat arrays; emptied when it holds ``most`` pieces, so memory stays bounded."""

    def __init__(self, encode: Callable[[list], Iterable], most: int = MOST_PIECES):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place: dict = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _learn(self, new: list) -> None:
        got = list(self.encode(new))
        counts = np.fromiter(map(len, got), np.int32, len(got))
        n, total = len(self.place), int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        if total:
            self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(got), np.uint32, total)
        self.start[n : n + len(new)] = self.used + spans_of(counts)[:-1]
        self.count[n : n + len(new)] = counts
        self.used += total
        self.place.update(zip(new, range(n, n + len(new))))

    def flat(self, pieces: list, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces in order, and how many each text has. per_text: pieces of each text."""
        if len(self.place) > self.most:
            self.clear()
        new = [p for p in set(pieces) if p not in self.place]
        if new:
            self._learn(new)
        code = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        counts = self.count[code].astype(np.int64)
        at = spans_of(counts)
        bounds = spans_of(per_text)
        return self.ids[ragged(self.start[code], counts)], np.diff(at[bounds])
