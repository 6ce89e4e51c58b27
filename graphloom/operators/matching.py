"""The bottleneck distance of two persistence diagrams, by matchings over a grid.

At a radius, points nearer than it to the diagonal may stay alone; all others of both diagrams need partners.
Matchings that cover the others of each side can be joined to one that covers both, so each side is asked on
its own. A side's matching grows by shortest augmenting paths, all of a length at once; points are found by
the cells of a grid as wide as the radius and leave it once they are reached.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Distances that are held at once while the radius is searched.
HELD = 1 << 22


class _Grid:
    """Numbered points by cell; ``near`` lists and removes those within the radius of a point."""

    def __init__(self, points: list[tuple[float, float]], radius: float, among: list[int] | None = None) -> None:
        # a little wider than the radius, so that a rounded distance never skips a cell
        self.points, self.radius, self.width, self.cells = points, radius, radius * (1 + 1e-9), defaultdict(list)
        for k in range(len(points)) if among is None else among:
            self.cells[self._cell(points[k])].append(k)

    def _cell(self, point: tuple[float, float]) -> tuple[float, float]:
        return (point[0] // self.width, point[1] // self.width) if self.width else point

    def near(self, point: tuple[float, float]) -> Iterator[int]:
        (x, y), (i, j), radius, cells, points = point, self._cell(point), self.radius, self.cells, self.points
        for cell in [(i + a, j + b) for a in (-1.0, 0.0, 1.0) for b in (-1.0, 0.0, 1.0)] if self.width else [point]:
            held = cells.get(cell)
            k = 0
            while held and k < len(held):
                u, v = points[held[k]]
                if abs(x - u) <= radius and abs(y - v) <= radius:
                    found = held[k]
                    held[k] = held[-1]
                    held.pop()
                    yield found
                else:
                    k += 1


def covers(a: list[tuple[float, float]], b: list[tuple[float, float]], radius: float) -> bool:
    """Whether all points of ``a`` can have partners of their own in ``b`` within ``radius`` (by the larger
    coordinate difference)."""
    if len(a) > len(b):
        return False
    partner, mate, free = [-1] * len(a), [-1] * len(b), _Grid(b, radius)
    for i, point in enumerate(a):
        for k in free.near(point):
            partner[i], mate[k] = k, i
            break
    while True:
        roots = [i for i, k in enumerate(partner) if k < 0]
        if not roots:
            return True
        unseen, layer, layers, ends = _Grid(b, radius), roots, [], False
        while layer and not ends:
            reached = [k for i in layer for k in unseen.near(a[i])]
            ends = any(mate[k] < 0 for k in reached)
            layers.append(_Grid(b, radius, reached))
            layer = [mate[k] for k in reached if mate[k] >= 0]
        if not ends:
            return False
        for root in roots:
            path = [(root, layers[0].near(a[root]))]
            taken: list[int] = []
            while path:
                k = next(path[-1][1], None)
                if k is None:
                    path.pop()
                    if taken:
                        taken.pop()
                elif mate[k] < 0:
                    taken.append(k)
                    for (i, _), t in zip(path, taken):
                        partner[i], mate[t] = t, i
                    break
                elif len(path) < len(layers):
                    taken.append(k)
                    path.append((mate[k], layers[len(path)].near(a[mate[k]])))


def _distances(a: np.ndarray, b: np.ndarray, low: float, high: float) -> Iterator[np.ndarray]:
    """The distances in (low, high) between points of both, in blocks of rows."""
    rows = max(1, HELD // max(1, len(b)))
    for start in range(0, len(a), rows):
        d = np.abs(a[start : start + rows, None, :] - b[None, :, :]).max(2).ravel()
        yield d[(d > low) & (d < high)]


def bottleneck(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """The bottleneck distance of two finite diagrams: the least radius at which all points have partners, or the
    diagonal, within it.

    The radius is a distance of two points or of a point and the diagonal. Those that are still possible are
    halved by their median, or, while they are too many to hold, by the median of a sample.
    """
    a, b = ([(float(x), float(y)) for x, y in d] for d in (a, b))
    alone = [[abs(y - x) / 2 for x, y in d] for d in (a, b)]
    high = max([0.0, *alone[0], *alone[1]])
    others = lambda d, half, r: [point for point, h in zip(d, half) if h > r]
    fits = lambda r: covers(others(a, alone[0], r), b, r) and covers(others(b, alone[1], r), a, r)
    rows = [np.array(d, float).reshape(-1, 2) for d in (a, b)]
    if not high or fits(0.0):
        return 0.0
    low, rng = 0.0, np.random.default_rng(0)
    while True:  # fits(high), not fits(low)
        parts, n = [np.concatenate(alone)], 0
        parts[0] = parts[0][(parts[0] > low) & (parts[0] < high)]
        for d in _distances(*rows, low, high):
            n += len(d)
            parts.append(d if n <= HELD else d[rng.integers(0, len(d), min(len(d), HELD // 64))] if len(d) else d)
        between = np.unique(np.concatenate(parts))
        if not len(between):
            return float(high)
        start, stop = 0, len(between)
        while start < stop:
            mid = (start + stop) // 2
            start, stop = (start, mid) if fits(float(between[mid])) else (mid + 1, stop)
        high = between[start] if start < len(between) else high
        low = between[start - 1] if start else low
        if n <= HELD:
            return float(high)
