"""A sieve for warping distances with squared costs: all candidates of a query advance together in 16-bit whole numbers,
from both ends of the series at once, and those whose path must cost more than their limit are dropped on the way.

A path of L cells costs D.  Series are scaled by s, cut off at ``REACH`` and rounded, which no difference outgrows by more
than 1, so that the root of its cost in whole numbers is at most s * sqrt(D) + sqrt(L) (the triangle inequality); L is at
most n + m - 1.  A path touches one of every two successive diagonals, so it costs no less than the cheapest cell of the
last two from either end together.  Cells above ``MOST`` are set to ``MOST``, and those that outgrow 16 bits before that come
out smaller: both leave a lower bound.
"""

from __future__ import annotations

import numpy as np

#: Largest threshold in whole numbers, largest value, and diagonals from one cut to ``MOST`` to the next.
MOST, REACH, EVERY = 26000, 91, 3
#: Shares of the diagonals of each end after which candidates are dropped.
STOPS = (0.76, 0.88, 1.0)
SHORTEST = 8


class Sieve:
    """The rows of ``x`` (rows, n) as candidates for queries of the same length with limits up to ``limit``."""

    def __init__(self, x: np.ndarray, limit: float, window: int | None) -> None:
        self.n = x.shape[1]
        self.window = self.n if window is None else min(window, self.n)
        self.middle = float(np.median(x)) if x.size else 0.0
        self.slack = np.sqrt(2 * self.n - 1)
        self.limit = limit
        self.scale = (np.sqrt(MOST) - self.slack - 1) / np.sqrt(max(limit, 1e-12))
        own = self.rounded(x).T
        self.columns = np.ascontiguousarray(np.stack([own, own[::-1]], axis=1))

    def rounded(self, x: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((x - self.middle) * self.scale, -REACH, REACH)).astype(np.int16).view(np.uint16)

    def thresholds(self, limits: np.ndarray) -> np.ndarray:
        """In whole numbers: below 0 for a limit below 0, where nothing is sought, and above all costs for those above ``limit``."""
        roots = np.sqrt(np.clip(limits, 0, self.limit) * (1 + 1e-9))
        most = np.ceil((roots * self.scale + self.slack) ** 2).astype(np.int32) + 1
        return np.where(limits < 0, -1, np.where(limits > self.limit, 2**30, most))

    def left(self, q: np.ndarray, most: np.ndarray, start: int = 0) -> np.ndarray:
        """Places of the candidates from ``start`` on that may be within their thresholds ``most`` of the query, which
        ``rounded`` has given."""
        n, w = self.n, self.window
        here = np.flatnonzero(most >= 0) + start
        if not len(here):
            return here
        columns = self.columns[:, :, start:] if len(here) == len(most) else self.columns.take(here, axis=2)
        most = most[here - start]
        back = np.stack([q[::-1], q], axis=1)[:, :, None]
        half = min(n, w + 1) // 2 + 2
        cells = [np.full((2 * half + 2, 2, len(here)), 0xFFFF, np.uint16) for _ in range(2)]
        costs = np.empty((min(n, w + 1), 2, len(here)), np.uint16)
        stops = {max(2, int((n - 1) * share)) for share in STOPS}
        for k in range(n - 1):
            reach = min(k, w - (k - w) % 2) if k > w else k
            j = (k - reach) // 2
            rows, odd = reach + 1, k % 2
            at = (-reach - odd) // 2 + half
            now, other, cost = cells[odd][at : at + rows], cells[1 - odd], costs[:rows]
            np.subtract(columns[j : j + rows], back[n - 1 - k + j : n - 1 - k + j + rows], out=cost)
            np.multiply(cost, cost, out=cost)
            if k:
                np.minimum(now, other[at - 1 + odd : at - 1 + odd + rows], out=now)
                np.minimum(now, other[at + odd : at + odd + rows], out=now)
                np.add(now, cost, out=now)
            else:
                now[...] = cost
            if k % EVERY == EVERY - 1 or k + 1 in stops:
                used = slice(half - reach // 2 - 1, half + reach // 2 + 2)
                for x in cells:
                    np.minimum(x[used], MOST, out=x[used])
                if k + 1 in stops:
                    ends = np.minimum(cells[0][used].min(axis=0), cells[1][used].min(axis=0)).astype(np.int32)
                    stay = np.flatnonzero(ends[0] + ends[1] <= most)
                    if len(stay) < 0.8 * len(here):
                        here, most, columns = here[stay], most[stay], columns.take(stay, axis=2)
                        cells, costs = [x.take(stay, axis=2) for x in cells], np.empty((len(costs), 2, len(stay)), np.uint16)
                        if not len(stay):
                            return here
                    elif k + 1 == max(stops):
                        here = here[stay]
        return here
