"""Heaps of the best k per row, kept as arrays by tasks that see their candidates batch by batch."""

from __future__ import annotations

import numpy as np

#: Decimals to which scores are ordered; beyond them lies the rounding of sums.
DECIMALS = 7


class Heaps:
    """The ``k`` greatest scores of each of ``n`` rows so far; equal ones (to ``decimals``) are ordered by item. Scores below ``floor`` don't count."""

    def __init__(self, n: int, k: int, floor: float = -np.inf, decimals: int = DECIMALS):
        self.k, self.floor, self.decimals = k, floor, decimals
        self.score = np.full((n, k), -np.inf)
        self.item = np.full((n, k), None, dtype=object)

    def bar(self, rows: slice) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.score[rows, -1], self.floor)

    def push(self, rows: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        """Candidates, each for one row; ``item`` is a NumPy array whose values can be ordered."""
        ok = (np.round(score, self.decimals) >= np.round(self.score[rows, -1], self.decimals)) & (score >= self.floor)
        rows, score, item = rows[ok], score[ok], item[ok]
        if not len(rows):
            return
        touched = np.unique(rows)
        old = self.score[touched].ravel()
        held = np.isfinite(old)
        r = np.concatenate([rows, np.repeat(touched, self.k)[held]])
        s = np.concatenate([score, old[held]])
        names = np.concatenate([item, np.asarray(self.item[touched].ravel()[held].tolist(), dtype=None)]) if held.any() else item
        order = np.lexsort((names, -np.round(s, self.decimals), r))
        r, s, names = r[order], s[order], names[order]
        first = np.concatenate(([True], r[1:] != r[:-1]))
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        top = place < self.k
        self.score[touched], self.item[touched] = -np.inf, None
        self.score[r[top], place[top]], self.item[r[top], place[top]] = s[top], names[top].astype(object)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, item and score of everything held."""
        held = np.isfinite(self.score)
        return np.nonzero(held)[0], self.item[held], self.score[held]
