"""Small numpy kernels for one-to-one assignment."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost, as many as the shorter side has; rows in order.

    Shortest augmenting paths with potentials: each row in turn is given a column, moving earlier rows along the cheapest
    alternating path. Ties go to the lower column.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for row in range(n):
        dist, came = np.full(m, np.inf), np.full(m, -1)
        seen = np.zeros(m, bool)
        at, last, gone = row, -1, 0.0
        while True:
            step = gone + cost[at] - u[at] - v
            closer = ~seen & (step < dist - 1e-15)
            dist[closer], came[closer] = step[closer], last
            col = int(np.argmin(np.where(seen, np.inf, dist)))
            gone, seen[col], last = dist[col], True, col
            if row_of[col] < 0:
                break
            at = row_of[col]
        done = seen.copy()
        done[last] = False
        u[row] += gone
        for c in np.flatnonzero(done):
            u[row_of[c]] += gone - dist[c]
            v[c] -= gone - dist[c]
        while last >= 0:
            before = came[last]
            row_of[last] = row if before < 0 else row_of[before]
            last = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)
