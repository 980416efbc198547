"""Blocks of dynamic time warping grids, in numpy batches.

A state holds the cost of having reached each position of the second sequence; position 0 is the border
left of it. One element of the first sequence moves all positions at once: the running minimum along
the second sequence turns into a cumulative minimum once the cumulative cost is subtracted.
"""

from __future__ import annotations

import numpy as np


def step_cost(values: np.ndarray, others: np.ndarray, cost: str) -> np.ndarray:
    """Cost of pairing each row's value with all its others: 0/1 mismatch or |difference|."""
    gap = values[:, None] - others
    return (gap != 0).astype(float) if cost == "mismatch" else np.abs(gap)


def advance(state: np.ndarray, cost: np.ndarray, left: np.ndarray) -> np.ndarray:
    """State after one more element, given the costs left of it; rows are independent grids."""
    reach = np.minimum(state[:, 1:], state[:, :-1])
    total = np.cumsum(cost, axis=1)
    best = np.minimum(np.minimum.accumulate(reach - (total - cost), axis=1), left[:, None])
    return np.concatenate([left[:, None], total + best], axis=1)


def block(
    top: np.ndarray, left: np.ndarray, a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray,
    cost: str = "mismatch",
) -> tuple[np.ndarray, np.ndarray]:
    """Costs along the lower and the right border of many blocks, padded to one shape.

    ``top`` begins with the corner. The lower border is the state after each row's last element.
    """
    state, right = top, np.full(a.shape, np.inf)
    rows = np.arange(len(a))
    for t in range(a.shape[1]):
        moved = advance(state, step_cost(a[:, t], b, cost), left[:, t])
        state = np.where((t < len_a)[:, None], moved, state)
        right[:, t] = state[rows, len_b]
    return state, right


def distance(a: np.ndarray, b: np.ndarray, cost: str = "mismatch") -> float:
    """Warping distance of two sequences; infinite when one is empty."""
    if len(a) == 0 or len(b) == 0:
        return float("inf")
    top = np.full((1, len(b) + 1), np.inf)
    top[0, 0] = 0.0
    sides = [x for s in (a, b) for x in (s[None, :], np.array([len(s)]))]
    return float(block(top, np.full((1, len(a)), np.inf), *sides, cost)[0][0, -1])
