"""Optimal assignment on small cost matrices."""

import numpy as np


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths with potentials; every row or every
    column is used, whichever are fewer."""
    c = np.asarray(cost, dtype=float)
    turned = c.shape[0] > c.shape[1]
    if turned:
        c = c.T
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    of = np.full(m, -1)
    for i in range(n):
        dist, prev, done, row, last = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), i, -1
        base = 0.0
        while True:
            near = base + c[row] - u[row] - v
            better = ~done & (near < dist)
            dist[better], prev[better] = near[better], last
            j = int(np.where(done, np.inf, dist).argmin())
            done[j], base, last = True, dist[j], j
            if of[j] < 0:
                break
            row = of[j]
        u[i] += base
        for k in np.flatnonzero(done):
            if k != j:
                u[of[k]] += base - dist[k]
            v[k] -= base - dist[k]
        while True:
            of[j] = of[prev[j]] if prev[j] >= 0 else i
            if prev[j] < 0:
                break
            j = prev[j]
    pairs = [(int(of[j]), j) for j in range(m) if of[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)
