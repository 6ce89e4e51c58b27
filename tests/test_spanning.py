"""One large graph against the kernel that holds a graph in a task."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import persistence, spanning

SCHEMA = "u long, v long, weight double, e_ord long"


def random_edges(seed, n=60, m=90):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)})
    return [(u, v, float(rng.randint(-2, 3)), k) for k, (u, v) in enumerate(pairs)]


#: A star whose leaves rise with their weights, where each edge ends the vertex before, and a loop.
STAR = [(0, v, float(v), v) for v in range(1, 40)] + [(7, 7, 2.0, 0)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("kind", "a", F.coalesce("b", F.lit(-9)), F.coalesce("e_ord", F.lit(-9)), "value").collect())


@pytest.mark.parametrize("edges, order, task_edges", [(random_edges(1), "sublevel", 20), (random_edges(2), "superlevel", 1 << 20), (STAR, "sublevel", 10), ([], "sublevel", 10)])
def test_like_the_kernel(spark, edges, order, task_edges):
    e = spark.createDataFrame(edges, SCHEMA)
    v = spark.range(70).withColumnRenamed("id", "v")
    every = v.union(e.select(F.explode(F.array("u", "v")))).distinct()
    one = lambda df: df.select(F.lit(0).alias("it"), F.lit(0).cast("long").alias("graph_id"), *df.columns)
    want = rows_of(persistence.kruskal(one(every), one(e), order))
    assert rows_of(spanning.large_h0(v, e, order, task_edges)) == want


def test_parts_stay_apart(spark):
    rows = [(p, *x) for p in range(2) for x in random_edges(p, 30, 25)]
    edges = spark.createDataFrame(rows, "part long, " + SCHEMA)
    forest, labels = spanning.boruvka(edges)
    found = {(r.part, r.e_ord) for r in forest.collect()}
    for p in range(2):
        sets = persistence.UnionFind(max)
        want = {k for u, v, w, k in sorted(random_edges(p, 30, 25), key=lambda e: (e[2], e[3])) if sets.merge(u, v) is not None}
        assert {k for q, k in found if q == p} == want
        groups = {}
        for r in labels.where(F.col("part") == p).collect():
            groups.setdefault(r.component, set()).add(sets.find(r.node))
        assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)
