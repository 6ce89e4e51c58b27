"""The bottleneck distance against matchings of a whole cost matrix, and on large diagrams."""

import random
import time

import numpy as np
import pytest

from graphloom.operators import matching
from graphloom.operators.matching import bottleneck, covers


def by_matrix(a, b):
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    for i, (x, y) in enumerate(a):
        cost[i, :m] = [max(abs(x - u), abs(y - v)) for u, v in b]
        cost[i, m:] = abs(y - x) / 2
    for j, (u, v) in enumerate(b):
        cost[n:, j] = abs(v - u) / 2

    def fits(radius):
        mate = {}

        def place(i, seen):
            for j in np.flatnonzero(cost[i] <= radius).tolist():
                if j not in seen:
                    seen.add(j)
                    if j not in mate or place(mate[j], seen):
                        mate[j] = i
                        return True
            return False

        return all(place(i, set()) for i in range(n + m))

    return float(min((r for r in np.unique(cost) if fits(r)), default=0.0))


def diagram(rng, n, grid=None):
    at = (lambda: rng.randint(0, grid)) if grid else rng.random
    return [tuple(map(float, sorted((at(), at())))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_small_diagrams(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(matching, "HELD", 16)
    rng = random.Random(seed)
    a, b = (diagram(rng, rng.randint(0, 14), rng.choice([None, 3, 8])) for _ in range(2))
    assert bottleneck(a, b) == by_matrix(a, b) == bottleneck(b, a)


def test_large_diagrams():
    rng = random.Random(1)
    a, b = diagram(rng, 2000), diagram(rng, 2000)
    began = time.time()
    r = bottleneck(a, b)
    assert time.time() - began < 30  # about three seconds on a free machine
    others = lambda d, t: [p for p in d if (p[1] - p[0]) / 2 > t]
    fits = lambda t: covers(others(a, t), b, t) and covers(others(b, t), a, t)
    assert fits(r) and not fits(float(np.nextafter(r, 0)))


def test_equal_and_shifted():
    rng = random.Random(2)
    a = diagram(rng, 300, 40)
    assert bottleneck(a, a[::-1]) == 0.0 and bottleneck([], []) == 0.0
    assert bottleneck(a, []) == max((y - x) / 2 for x, y in a)
    far = [(x, y + 100) for x, y in a]
    assert bottleneck(far, [(x + 1, y) for x, y in far]) == 1.0
