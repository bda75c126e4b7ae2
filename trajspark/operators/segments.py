"""Line segments in a grid, in numpy: for workers that hold a road network and look at points in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of points and segments that a worker holds at a time.
PAIRS = 1 << 20
#: Shares of the reach at which the nearest segment is looked for, in turn; the last is the whole reach.
SHARES = (1 / 16, 1 / 4, 1.0)


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row], first[row] + 1, ...), count[row] of them."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + first[rows]


class SegmentGrid:
    """Segments (x1, y1, x2, y2) whose grown boxes are dealt to grid cells, once for each reach."""

    def __init__(self, ends: np.ndarray) -> None:
        self.x1, self.y1, self.x2, self.y2 = (np.ascontiguousarray(c) for c in np.asarray(ends, float).reshape(-1, 4).T)
        sides = (np.abs(self.x2 - self.x1) + np.abs(self.y2 - self.y1)) / 2
        self.side = float(sides[np.isfinite(sides)].mean()) if np.isfinite(sides).any() else 0.0
        self.cells: dict[tuple[float, float], tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cells": {}}

    def _dealt(self, reach: float, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell keys in order, first and number of each cell's segments, segments)"""
        if (reach, size) not in self.cells:
            at = lambda v: np.floor(v / size).astype(np.int64)
            fits = np.flatnonzero(np.isfinite(self.x1 + self.y1 + self.x2 + self.y2))
            x1, y1, x2, y2 = (c[fits] for c in (self.x1, self.y1, self.x2, self.y2))
            left, low = at(np.minimum(x1, x2) - reach), at(np.minimum(y1, y2) - reach)
            wide, high = at(np.maximum(x1, x2) + reach) - left + 1, at(np.maximum(y1, y2) + reach) - low + 1
            rows, place = ranges(np.zeros(len(fits), np.int64), wide * high)
            key = ((left[rows] + place // high[rows]) << 32) + low[rows] + place % high[rows]
            order = np.argsort(key, kind="stable")
            keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
            self.cells[reach, size] = keys, first, count, fits[rows[order]]
        return self.cells[reach, size]

    def pairs(self, x: np.ndarray, y: np.ndarray, reach: float, size: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, segments) whose box, grown by reach, holds the point: by point, then segment, a point's pairs together."""
        size = size or reach
        keys, first, count, segments = self._dealt(reach, size)
        known = np.flatnonzero(np.isfinite(x + y))
        if not len(keys) or not len(known):
            return
        key = (np.floor(x[known] / size).astype(np.int64) << 32) + np.floor(y[known] / size).astype(np.int64)
        cell = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        n = np.where(keys[cell] == key, count[cell], 0)
        slices = (np.cumsum(n) - n) // PAIRS
        starts = np.flatnonzero(np.diff(slices, prepend=-1))
        for a, z in zip(starts, [*starts[1:], len(known)], strict=True):
            rows, at = ranges(first[cell[a:z]], n[a:z])
            p, s = known[a:z][rows], segments[at]
            px, py = x[p], y[p]
            x1, x2, y1, y2 = self.x1[s], self.x2[s], self.y1[s], self.y2[s]
            inside = (px >= np.minimum(x1, x2) - reach) & (px <= np.maximum(x1, x2) + reach) & (py >= np.minimum(y1, y2) - reach) & (py <= np.maximum(y1, y2) + reach)
            yield p[inside], s[inside]

    def nearest(self, x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(segment, or -1, and its distance) of the segments in reach that hold a point's foot; the first of equally near ones.

        A foot at a distance lies in the segment's box, so a segment found within a share of the reach is nearer than all whose
        box doesn't come that near. Only the points without one are looked at again.
        """
        best, least = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
        left = np.arange(len(x))
        for share in SHARES:
            near = reach * share
            for p, s in self.pairs(x[left], y[left], near, max(near, min(reach, self.side))):
                at = left[p]
                dx, dy = self.x2[s] - self.x1[s], self.y2[s] - self.y1[s]
                ox, oy = x[at] - self.x1[s], y[at] - self.y1[s]
                along, length = ox * dx + oy * dy, dx * dx + dy * dy
                holds = np.flatnonzero((length > 0) & (along >= 0) & (along <= length))
                distance = np.abs(ox * dy - oy * dx)[holds] / np.sqrt(length[holds])
                at, s = at[holds], s[holds]
                order = np.lexsort((s, distance, at))
                first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
                best[at[first]], least[at[first]] = s[first], distance[first]
            left = left[least[left] > near * (1 - 1e-6)]
        return best, least
