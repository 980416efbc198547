"""Which rules hold on a row: bit vectors of false conditions, by group of rules.

Rules fall into groups of 64, one bit each. Within a group the conditions on a feature are sorted by
threshold, so that the false ones for a value are a prefix ("at most") and a suffix ("above") of
the order; the bits that these leave alive are worked out in advance. A row then takes two binary
searches per feature and group, and the surviving rules are the AND of what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class _Feature:
    """One group's conditions on one feature: thresholds and what is alive from each place on."""

    number: int
    at_most: np.ndarray
    alive_at_most: np.ndarray
    above: np.ndarray
    alive_above: np.ndarray
    untouched: np.uint64

    def alive(self, values: np.ndarray) -> np.ndarray:
        """NaN is above everything, as in Spark."""
        low = self.alive_at_most[np.searchsorted(self.at_most, values, side="left")]
        return low & self.alive_above[np.searchsorted(self.above, values, side="left")]


def _masks(conditions: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted thresholds, and per threshold the bits of the rules that don't need it."""
    needs: dict[float, int] = {}
    for threshold, bit in conditions:
        needs[threshold] = needs.get(threshold, 0) | 1 << bit
    order = sorted(needs)
    return np.array(order, dtype=float), np.array([~np.uint64(needs[t]) for t in order], dtype=np.uint64)


class LeafIndex:
    """Rules as lists of (feature number, at most or above, threshold)."""

    def __init__(self, rules: Sequence[Sequence[tuple[int, bool, float]]]):
        self.rules = len(rules)
        self.groups: list[list[_Feature]] = []
        for lo in range(0, len(rules), GROUP):
            sides: dict[int, tuple[list, list]] = {}
            for bit, literals in enumerate(rules[lo: lo + GROUP]):
                for feature, at_most, threshold in literals:
                    sides.setdefault(feature, ([], []))[0 if at_most else 1].append((threshold, bit))
            self.groups.append([self._feature(f, *sides[f]) for f in sorted(sides)])

    @staticmethod
    def _feature(number: int, at_most: list, above: list) -> _Feature:
        low, low_masks = _masks(at_most)
        high, high_masks = _masks(above)
        untouched = ~np.uint64(sum(1 << b for b in {bit for _, bit in at_most + above}))
        # "value <= t" is false for all t below the value; "value > t" for all t from the value on
        prefix = np.concatenate([[_ALL], np.bitwise_and.accumulate(low_masks)]).astype(np.uint64)
        suffix = np.concatenate([np.bitwise_and.accumulate(high_masks[::-1])[::-1], [_ALL]]).astype(np.uint64)
        return _Feature(number, low, prefix, high, suffix, untouched)

    def hits(self, values: np.ndarray, missing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per group the rows and rules that match; a condition on a missing value is false."""
        for g, features in enumerate(self.groups):
            size = min(GROUP, self.rules - g * GROUP)
            alive = np.full(len(values), _ALL if size == GROUP else np.uint64((1 << size) - 1), dtype=np.uint64)
            for f in features:
                found = f.alive(values[:, f.number])
                gone = missing[:, f.number]
                alive &= np.where(gone, f.untouched, found) if gone.any() else found
            rows = np.flatnonzero(alive)
            if len(rows):
                bits = np.unpackbits(alive[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, bit = np.nonzero(bits)
                yield rows[at], bit + g * GROUP

    def matched(self, values: np.ndarray, missing: np.ndarray, classes: np.ndarray | None, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per row and rule places in order; with ``classes`` only rules of the row's wanted class."""
        found = list(self.hits(values, missing))
        rows = np.concatenate([r for r, _ in found] or [np.zeros(0, np.int64)])
        rules = np.concatenate([r for _, r in found] or [np.zeros(0, np.int64)])
        if classes is not None:
            same = classes[rules] == wanted[rows]
            rows, rules = rows[same], rules[same]
        order = np.argsort(rows, kind="stable")  # groups came in order
        return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(values)))]), rules[order]


def as_matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of equally long lists, and where they are null."""
    flat = lists.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return values, missing
