"""Least-cost assignment by shortest augmenting paths, for small dense matrices."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a complete assignment of the shorter side with the least total cost."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    near = cost.argmin(axis=1)
    if len(set(near.tolist())) == n and ((cost == cost.min(axis=1, keepdims=True)).sum() == n):
        return list(zip(range(n), near.tolist(), strict=True))  # each has a nearest of its own, and nothing costs as little
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        reach, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < reach[1:])
            reach[1:][better], back[1:][better] = slack[better], j
            k = int(np.where(used[1:], np.inf, reach[1:]).argmin()) + 1
            step = reach[k]
            u[owner[used]] += step
            v[used] -= step
            reach[~used] -= step
            j = k
        while j:
            owner[j], j = owner[back[j]], back[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def assign_all(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """assign() of many matrices of one size, matrices by rows by columns: matrix, row and column of each pair."""
    if costs.shape[1] > costs.shape[2]:
        k, j, i = assign_all(costs.transpose(0, 2, 1))
        return k, i, j
    n = costs.shape[1]
    near = costs.argmin(axis=2)
    alone = (np.diff(np.sort(near, axis=1), axis=1) != 0).all(axis=1)
    plain = alone & ((costs == costs.min(axis=2, keepdims=True)).sum(axis=(1, 2)) == n)
    own = np.flatnonzero(plain)
    rest = [(k, i, j) for k in np.flatnonzero(~plain).tolist() for i, j in assign(costs[k])]
    more = np.array(rest, np.int64).reshape(-1, 3).T
    pairs = (np.repeat(own, n), np.tile(np.arange(n), len(own)), near[own].ravel())
    return tuple(np.concatenate(v) for v in zip(pairs, more, strict=True))
