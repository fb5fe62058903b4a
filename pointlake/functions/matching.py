"""Minimum-cost assignment and name similarity for small column sets (numpy, no SciPy)."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of least total cost; entries of infinity may not be used.

    Every row and column is used at most once, and as many as the finite entries allow. Shortest augmenting paths with
    potentials over a matrix padded to a square, O(n^3) for n columns.
    """
    if not cost.size:
        return []
    finite = cost[np.isfinite(cost)]
    big = (finite.max() - min(0.0, finite.min()) + 1) * (sum(cost.shape) + 1) if finite.size else 1.0
    n = max(cost.shape)
    full = np.full((n, n), big)
    full[: cost.shape[0], : cost.shape[1]] = np.where(np.isfinite(cost), cost, big)
    left, right = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, seen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while owner[at]:
            seen[at] = True
            slack = np.r_[np.inf, full[owner[at] - 1] - left[owner[at]] - right[1:]]
            better = ~seen & (slack < least)
            least[better], back[better] = slack[better], at
            step_to = int(np.argmin(np.where(seen, np.inf, least)))
            step = least[step_to]
            np.add.at(left, owner[seen], step)
            right[seen] -= step
            least[~seen] -= step
            at = step_to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = ((owner[j] - 1, j - 1) for j in range(1, n + 1))
    return sorted((i, j) for i, j in pairs if i < cost.shape[0] and j < cost.shape[1] and np.isfinite(cost[i, j]))


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, case folded, 1 for equal names."""
    a, b = a.casefold(), b.casefold()
    if a == b:
        return 1.0
    pairs = [{f"^{s}$"[i : i + 2] for i in range(len(s) + 1)} for s in (a, b)]
    return 2 * len(pairs[0] & pairs[1]) / (len(pairs[0]) + len(pairs[1]))
