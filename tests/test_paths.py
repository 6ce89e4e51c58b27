"""Path queries, cycle pairs and Rips pairs against plain reductions; distances by bits against a search."""

import random
import time
from collections import Counter
from itertools import combinations

from graphloom.functions import signatures
from graphloom.operators import kernels, persistence
from graphloom.operators.paths import PathForest
from graphloom.plans import catalog
from graphloom.sources.collections import co_purchase_graphs
from tests.test_graphs import graph_set, random_graphs

SMALL = "/root/testdata/sf0.001"


def test_paths_of_a_changing_forest():
    rng = random.Random(1)
    value = [rng.randint(0, 50) for _ in range(30)]
    forest, edges = PathForest([*value]), set()

    def path(x, y):
        todo, seen = [(x, value[x])], {x}
        for at, most in todo:
            if at == y:
                return most
            for e in edges:
                for a, b in (e, e[::-1]):
                    if a == at and b not in seen:
                        seen.add(b)
                        todo.append((b, max(most, value[b])))
        return None

    for _ in range(3000):
        x, y = rng.sample(range(30), 2)
        if path(x, y) is None:
            forest.link(x, y)
            edges.add((x, y))
        elif rng.random() < 0.3:
            e = rng.choice(sorted(edges))
            forest.cut(*e)
            edges.remove(e)
        else:
            assert forest.largest(x, y) == path(x, y)


def reduced_cycle_pairs(weight, edges):
    """By column reduction over Z/2 of the triangles that a cone makes of the edges."""
    rising = sorted(edges, key=lambda e: (max(weight[e[0]], weight[e[1]]), e))
    up = {e: k for k, e in enumerate(rising)}
    down = {v: k for k, v in enumerate(sorted(weight, key=lambda v: (-weight[v], v)))}
    reduced, found = {}, []
    for e in sorted(edges, key=lambda e: (-min(weight[e[0]], weight[e[1]]), e)):
        column = frozenset([(0, up[e])]) ^ frozenset([(1, down[e[0]])]) ^ frozenset([(1, down[e[1]])])
        while column and max(column) in reduced:
            column = column ^ reduced[max(column)]
        if column:
            reduced[max(column)] = column
            if not max(column)[0]:
                found.append((max(weight[x] for x in rising[max(column)[1]]), min(weight[x] for x in e)))
    return sorted(found)


def reduced_rips_pairs(n, edges):
    """By reduction of all triangles' boundaries."""
    order = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    triangles = [tuple(order[p] for p in combinations(x, 2)) for x in combinations(range(n), 3) if all(p in order for p in combinations(x, 2))]
    pivots = {}
    for sides in sorted(triangles, key=max):
        column = frozenset(sides)
        while column and max(column) in pivots:
            column = column ^ pivots[max(column)][0]
        if column:
            pivots[max(column)] = (column, edges[max(sides)][0])
    sets, found = persistence.UnionFind(min), []
    for k, (w, i, j) in enumerate(edges):
        if sets.merge(i, j) is None:
            death = pivots[k][1] if k in pivots else None
            if death is None or death > w:
                found.append((w, death))
    return Counter(found)


def test_cycle_pairs_equal_the_reduction():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 14)
        weight = {3 * v: float(rng.randint(0, 6)) for v in range(n)}
        edges = [(u, v) for u in weight for v in weight if u <= v and rng.random() < 0.35]
        assert sorted(persistence.cycle_pairs(weight, edges)) == reduced_cycle_pairs(weight, edges)
    assert list(persistence.cycle_pairs({}, [])) == []


def test_rips_pairs_equal_the_reduction():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 14)
        edges = sorted((float(rng.randint(0, 8)), i, j) for i, j in combinations(range(n), 2) if rng.random() < 0.6)
        assert Counter(p[1:] for p in persistence.rips_pairs(n, edges) if p[0]) == reduced_rips_pairs(n, edges)


def test_cycles_of_a_large_graph():
    """A long ring with chords: the paths are long, so a walk along them would take n steps for each edge."""
    n, rng = 20_000, random.Random(4)
    edges = {(v, v + 1) for v in range(n - 1)} | {(0, n - 1)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n)}
    weight = {v: rng.random() for v in range(n)}
    began = time.time()
    assert sum(1 for _ in persistence.cycle_pairs(weight, sorted(edges))) == len(edges) - n + 1
    assert time.time() - began < 60


def by_graph(rows, key):
    found = {}
    for r in rows.collect():
        found.setdefault(r.graph_id, []).append(key(r))
    return found


def test_extended_cycles_of_the_table(spark):
    g = co_purchase_graphs(spark, SMALL)
    weights = by_graph(signatures.label(g), lambda r: (r.v, r.weight))
    edges = by_graph(g.edges, lambda r: (r.u, r.v))
    found = by_graph(catalog.extended_cycles(spark, SMALL), lambda r: (r.birth, r.death))
    want = {k: reduced_cycle_pairs(dict(w), edges.get(k, [])) for k, w in weights.items()}
    assert {k: sorted(x) for k, x in found.items()} == {k: x for k, x in want.items() if x}


def test_rips_h1_of_the_table(spark):
    from graphloom.operators import wl

    g = co_purchase_graphs(spark, SMALL)
    rows = by_graph(wl.edge_weights(g, wl.initial_labels(g), None), lambda r: (float(r.weight), r.u, r.v))
    want = {}
    for k, edges in rows.items():
        ids = {v: i for i, v in enumerate(sorted({x for _, u, v in edges for x in (u, v)}))}
        points = reduced_rips_pairs(len(ids), sorted((w, ids[u], ids[v]) for w, u, v in edges if u != v))
        want |= {(k, *point): m for point, m in points.items()}
    assert {(r.graph_id, r.birth, r.death): r.n for r in catalog.rips_h1(spark, SMALL).collect()} == want


def test_distances_by_bits(spark):
    """Against a search from each vertex: graphs of more than 64 vertices, null labels and self-loops too."""
    rng = random.Random(5)
    graphs = random_graphs(12, 5)
    for k, n in ((100, 150), (101, 64), (102, 9)):
        pairs = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(2 * n)}
        graphs[k] = ({v: rng.choice([None, 1, 2, 10]) for v in range(n)}, sorted(pairs))
    want = Counter()
    for k, (label, pairs) in graphs.items():
        near = {v: set() for v in label}
        for u, v in pairs:
            near[u].add(v)
            near[v].add(u)
        for s in label:
            d, todo = {s: 0}, [s]
            for x in todo:
                for y in near[x] - d.keys():
                    d[y] = d[x] + 1
                    todo.append(y)
            for t in d:
                if s < t:
                    ends = sorted(x for x in (label[s], label[t]) if x is not None)
                    ends = (ends * 2)[:2]  # the label there is stands for one that is null
                    want[k, "-".join(map(str, [*ends, d[t]]))] += 1
    found = {(r.graph_id, r.feature): r.n for r in kernels.shortest_path_features(graph_set(spark, graphs)).collect()}
    assert found == dict(want)
