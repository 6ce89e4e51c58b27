"""Micro-fixtures with hand-computed values, and independent plain-Python versions on random graphs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import signatures
from graphloom.model import build
from graphloom.operators import evaluate, gcn, kernels, persistence, vectorize, walks, wl


def graph_set(spark, graphs):
    """From {graph_id: (labels by vertex, pairs)}."""
    labels = [(g, v, x) for g, (lab, _) in graphs.items() for v, x in lab.items()]
    pairs = [(g, u, v) for g, (_, ps) in graphs.items() for u, v in ps]
    return build(spark.createDataFrame(pairs, "graph_id long, u long, v long"), spark.createDataFrame(labels, "graph_id long, v long, raw_label long"))


STAR_AND_TRIANGLE = {1: ({1: 0, 2: 1, 3: 1}, [(1, 2), (1, 3)]), 2: ({1: 0, 2: 1, 3: 2}, [(1, 2), (1, 3), (2, 3)])}


def block(df):
    return {(r.it, r.graph_id, r.label): r.value for r in df.collect()}


def test_star_and_triangle(spark):
    g = graph_set(spark, STAR_AND_TRIANGLE)
    labels, rows = persistence.persistent_wl(g, 2)
    rows = rows.cache()
    for it, want in enumerate(([[0, 1, 1], [0, 1, 2]], [[0, 1, 1], [2, 3, 4]], [[0, 1, 1], [2, 3, 4]])):
        got = {(r.graph_id, r.v): r.label for r in labels[it].collect()}
        assert [[got[k, v] for v in (1, 2, 3)] for k in (1, 2)] == want
    weights = {(r.it, r.graph_id, r.u, r.v): r.weight for r in wl.weight_history(g, labels).collect()}
    assert weights[0, 1, 1, 2] == 2 and weights[1, 1, 1, 2] == pytest.approx(4.236068) and weights[2, 2, 2, 3] == pytest.approx(3.414214)
    pers = block(persistence.label_persistence(labels, rows))
    assert {k: round(v, 6) for k, v in pers.items() if k[:2] == (0, 1)} == {(0, 1, 0): 4, (0, 1, 1): 8}
    assert {k: round(v, 6) for k, v in pers.items() if k[:2] == (0, 2)} == {(0, 2, 0): 4, (0, 2, 1): 4, (0, 2, 2): 4}
    assert pers[1, 1, 1] == pytest.approx(35.888544) and pers[2, 2, 3] == pytest.approx(11.656854)
    cycles = block(persistence.cycle_persistence(labels, rows))
    assert {k: round(v, 6) for k, v in cycles.items() if k[0] == 0} == {(0, 2, 1): 4, (0, 2, 2): 4}
    assert cycles[1, 2, 3] == cycles[1, 2, 4] == pytest.approx(11.656854)
    assert [(r.a, r.b) for r in rows.where("kind = 'cycle'").collect()] == [(2, 3)] * 3
    assert {r.betti0 for r in persistence.betti0(rows).collect()} == {1}
    hist = {(r.it, r.graph_id, r.label): r.n for r in wl.histogram(labels).collect()}
    assert hist == {**{(i, 1, 0): 1 for i in range(3)}, **{(i, 1, 1): 2 for i in range(3)}, **{(0, 2, x): 1 for x in range(3)}, **{(i, 2, x): 1 for i in (1, 2) for x in (2, 3, 4)}}
    for name in (signatures.heat_kernel, signatures.heat_kernel_exact):
        hks = {(r.graph_id, r.v): r.weight for r in name(g).collect()}
        assert [hks[1, v] for v in (1, 2, 3)] == pytest.approx([0.909365, 0.907101, 0.907101], abs=1e-6)
        assert hks[2, 1] == pytest.approx(0.907139, abs=1e-6)
    degree = {(r.graph_id, r.v): r.weight for r in signatures.degree(g).collect()}
    assert [degree[1, v] for v in (1, 2, 3)] == [2, 1, 1] and degree[2, 3] == 2


def random_graphs(n, seed):
    rng = random.Random(seed)
    graphs = {}
    for g in range(n):
        size = rng.randint(1, 8)
        vs = rng.sample(range(50), size)
        pairs = [p for p in combinations(sorted(vs), 2) if rng.random() < rng.choice((0.1, 0.4, 0.8))]
        graphs[g] = ({v: rng.randint(0, 2) for v in vs}, pairs)
    graphs[n] = ({1: 0, 2: 0, 5: 1}, [(1, 1), (1, 2)])  # a self-loop and an isolated vertex
    graphs[n + 1] = ({7: 1, 9: 1}, [])  # no edge
    return graphs


def component(vs, pairs, v):
    seen, todo = {v}, [v]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for s, t in ((a, b), (b, a)):
                if s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
    return seen


@pytest.mark.parametrize("order", ["sublevel", "superlevel"])
def test_h0_by_definition(spark, order):
    rng, graphs = random.Random(3), random_graphs(60, 3)
    g = graph_set(spark, graphs)
    weight = {(k, *p): float(rng.randint(1, 4)) for k, (_, ps) in graphs.items() for p in ps}
    w = spark.createDataFrame([(*k, x) for k, x in weight.items()], "graph_id long, u long, v long, weight double")
    weighted = g.edges.join(w, ["graph_id", "u", "v"]).withColumn("it", F.lit(0))
    rows = persistence.kruskal(g.vertices.withColumn("it", F.lit(0)), weighted, order).collect()
    found = {(r.graph_id, r.a): (r.value, r.kind == "essential") for r in rows if r.kind != "cycle"}
    inside = (lambda x, t: x <= t) if order == "sublevel" else (lambda x, t: x >= t)
    want, cycles = {}, Counter()
    for k, (lab, pairs) in graphs.items():
        steps = sorted({weight[k, *p] for p in pairs}, reverse=order == "superlevel")
        for v in lab:
            for t in steps:
                if max(component(lab, [p for p in pairs if inside(weight[k, *p], t)], v)) > v:
                    want[k, v] = (t, False)
                    break
            else:
                want[k, v] = (steps[-1] if steps else 0.0, True)
        roots = len({max(component(lab, pairs, v)) for v in lab})
        cycles[k] = len(pairs) - len(lab) + roots
    assert found == want
    assert Counter(r.graph_id for r in rows if r.kind == "cycle") == +cycles
    with pytest.raises(ValueError):
        persistence.kruskal(g.vertices, weighted, "sideways")


def test_vertex_filtration_by_definition(spark):
    graphs = random_graphs(60, 4)
    g = graph_set(spark, graphs)
    rows = persistence.vertex_diagram(g, signatures.degree(g)).collect()
    deg = {(r.graph_id, r.v): r.weight for r in signatures.degree(g).collect()}
    found = {(r.graph_id, r.creator): (r.birth, r.death) for r in rows if r.dim == 0}
    for k, (lab, pairs) in graphs.items():
        f = {v: deg[k, v] for v in lab}
        for v in lab:
            death = None
            for t in sorted({*f.values()}):
                if t >= f[v]:
                    comp = component(lab, [p for p in pairs if max(f[p[0]], f[p[1]]) <= t], v)
                    if min((f[x], x) for x in comp) < (f[v], v):
                        death = t
                        break
            assert found[k, v] == (f[v], death)
    assert sum(r.dim == 1 for r in rows) == sum(r.kind == "cycle" for r in persistence.kruskal(g.vertices.withColumn("it", F.lit(0)), g.edges.select(F.lit(0).alias("it"), "*", F.lit(1.0).alias("weight"))).collect())
    ext = persistence.extended_diagram(g, signatures.degree(g)).collect()
    assert sum(r.kind == "extended" for r in ext) == len({(k, max(component(lab, ps, v))) for k, (lab, ps) in graphs.items() for v in lab})


def test_wl_and_kernels_by_definition(spark):
    graphs = random_graphs(25, 5)
    g = graph_set(spark, graphs)
    near = {k: defaultdict(list) for k in graphs}
    for k, (_, pairs) in graphs.items():
        for u, v in pairs:
            near[k][u].append(v)
            if u != v:
                near[k][v].append(u)

    def number(sig):
        ids = {}
        for key in sorted(sig):
            ids.setdefault(sig[key], len(ids))
        return {key: ids[s] for key, s in sig.items()}

    label = number({(k, v): x for k, (lab, _) in graphs.items() for v, x in lab.items()})
    for it, found in enumerate(wl.history(g, 3)):
        if it:
            label = number({(k, v): (label[k, v], *sorted(label[k, u] for u in near[k][v])) for k, v in label})
        assert {(r.graph_id, r.v): r.label for r in found.collect()} == label
    dist = {(r.graph_id, r.s, r.t): r.d for r in kernels.distances(g).collect()}
    for k, (lab, _) in graphs.items():
        for s in lab:
            d, todo = {s: 0}, [s]
            for x in todo:
                for y in near[k][x]:
                    if y not in d:
                        d[y] = d[x] + 1
                        todo.append(y)
            assert {t: dist[k, s, t] for t in lab if (k, s, t) in dist} == d
    count = {r.graph_id: (r.empty, r.edge, r.path, r.triangle) for r in kernels.graphlets3(g).collect()}
    for k, (lab, pairs) in graphs.items():
        ps, c = {p for p in pairs if p[0] != p[1]}, [0, 0, 0, 0]
        for three in combinations(sorted(lab), 3):
            c[sum(p in ps for p in combinations(three, 2))] += 1
        assert count[k] == tuple(c)
    gram = {(r.g1, r.g2): r.k for r in kernels.gram(kernels.wl_features(g, 2), g.graphs).collect()}
    assert all(gram[k, k] == pytest.approx(1) for k in graphs) and all(gram[a, b] == pytest.approx(gram[b, a]) for a, b in gram)
    sampled = kernels.sampled_graphlets(g, 300).groupBy("graph_id").agg(F.sum("n").alias("n")).collect()
    assert all(0 < r.n <= 300 for r in sampled)


def test_rips_by_definition():
    """Betti numbers of the clique complex at each threshold, by ranks over Z/2."""

    def rank(columns):
        pivots = {}
        for c in columns:
            while c and max(c) in pivots:
                c = c ^ pivots[max(c)]
            if c:
                pivots[max(c)] = c
        return len(pivots)

    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        edges = sorted((float(rng.randint(1, 5)), i, j) for i, j in combinations(range(n), 2) if rng.random() < 0.7)
        points = list(persistence.rips_pairs(n, edges))
        for t in range(0, 7):
            es = [(i, j) for w, i, j in edges if w <= t]
            at = {e: k for k, e in enumerate(es)}
            tri = [x for x in combinations(range(n), 3) if all(p in at for p in combinations(x, 2))]
            r1 = rank([frozenset(e) for e in es])
            r2 = rank([frozenset(at[p] for p in combinations(x, 2)) for x in tri])
            alive = lambda d: sum(dim == d and b <= t and (x is None or x > t) for dim, b, x in points)  # noqa: E731, B023
            assert alive(0) == n - r1 and alive(1) == len(es) - r1 - r2


def test_bottleneck():
    assert persistence.bottleneck([(0, 4)], [(0, 5)]) == 1
    assert persistence.bottleneck([(0, 4)], []) == 2 and persistence.bottleneck([], []) == 0
    assert persistence.bottleneck([(0, 4), (1, 2)], [(0.5, 4)]) == 0.5


def test_walks_follow_arcs_and_probabilities(spark):
    graphs = random_graphs(20, 7)
    g = graph_set(spark, graphs)
    arcs = walks.directed(g.edges.withColumn("weight", F.lit(1.0)))
    second = walks.second_order(arcs, 0.5, 4.0)
    for df, keys in ((walks.first_order(arcs), ["graph_id", "src"]), (second, ["graph_id", "src", "dst"])):
        assert all(r.s == pytest.approx(1) for r in df.groupBy(*keys).agg(F.sum("prob").alias("s")).collect())
    steps = walks.walks(g.vertices, arcs, 5, 2, 0.5, 4.0).collect()
    there = {(r.graph_id, r.src, r.dst) for r in arcs.collect()}
    by = defaultdict(dict)
    for r in steps:
        by[r.graph_id, r.walk, r.start][r.step] = r.v
    assert len(by) == 2 * g.vertices.count()
    for (k, _, start), w in by.items():
        assert w[0] == start and sorted(w) == list(range(len(w)))
        assert all((k, w[i], w[i + 1]) in there for i in range(len(w) - 1))
        assert len(w) == 5 or not any(a == (k, w[len(w) - 1]) for a in ((x[0], x[1]) for x in there))


def test_convolution_and_metrics(spark):
    g = graph_set(spark, STAR_AND_TRIANGLE)
    one = g.edges.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("a"))
    adj = gcn.normalised_adjacency(one, g.vertices)
    assert all(r.s == pytest.approx(1) for r in adj.groupBy("graph_id", "i").agg(F.sum("a").alias("s")).collect())
    x = g.vertices.select("graph_id", "v", F.lit(0).cast("long").alias("f"), F.col("v").cast("double").alias("value"))
    w = spark.createDataFrame([(0, 0, 2.0), (0, 1, -1.0)], "f long, h long, w double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.0)], "h long, b double")
    out = {(r.graph_id, r.v, r.f): r.value for r in gcn.convolution(x, adj, w, b).collect()}
    assert out[1, 2, 0] == pytest.approx(0.5 + 2 * 1.5) and out[2, 1, 1] == pytest.approx(-2)
    assert {r.f for r in gcn.predict(gcn.log_softmax(gcn.convolution(x, adj, w, b))).collect()} == {0}
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id long, cls string")
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (1, "c", 0.5), (2, "a", 0.4), (2, "b", 0.4)], "id long, cls string, score double")
    found = evaluate.top_k(scores, truth)
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "c"), (2, "a")]
    f1 = evaluate.f1(found, truth).first()
    assert (f1.macro, f1.micro) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert evaluate.subset_accuracy(found, truth).first().accuracy == 0.5


def test_vectors(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 0.5), (1, 0.2, None)], "graph_id long, birth double, death double")
    up = vectorize.upper_diagonal(points).orderBy("x").collect()
    assert up[0].y == pytest.approx(0.707107, abs=1e-6) and up[1].y is None
    assert len({tuple(r) for r in vectorize.centres(spark, 5).collect()}) == 5
    births = vectorize.slayer_births(points, spark.createDataFrame([(0, 0.2)], "e int, cx double")).first()
    assert births.value == pytest.approx(1)
    top = vectorize.persistence_landscape(points, 1.0, steps=2).collect()
    assert [(r.k, r.i, r.value) for r in top] == [(1, 0, 0.25), (1, 1, 0.25)]
    norm = persistence.normalise(points).orderBy("birth", "death").collect()
    assert [(r.birth, r.death) for r in norm] == [(0, 1), (0.2, None), (0.5, 0.5)]
    assert persistence.threshold(points).count() == 2
