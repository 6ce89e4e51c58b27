"""Packed collections against the operators over long tables, with odd tables: ends that are no suppliers, empty
graphs, one large graph beside small ones."""

import random

import numpy as np
import pytest

from graphloom.operators import packed, persistence, wl
from graphloom.plans import catalog, experiment
from graphloom.sources.collections import co_purchase_graphs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of star-schema tables: 30 customers, the last with a large graph; suppliers 40 to 43 are missing."""
    rng, d = random.Random(5), str(tmp_path_factory.mktemp("star"))
    orders = [(k, k % 29 if k < 150 else 29) for k in range(230)]
    items = [(o, rng.randrange(6 if c % 3 else 44)) for o, c in orders for _ in range(rng.randrange(1, 7))]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write([(c, "ABC"[c % 3]) for c in range(31)], "c_custkey long, c_mktsegment string", "customer")
    write([(s, s * 7 % 25) for s in range(40)], "s_suppkey long, s_nationkey long", "supplier")
    write(orders, "o_orderkey long, o_custkey long", "orders")
    write(items, "l_orderkey long, l_suppkey long", "lineitem")
    return d


def rows(df, *columns):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def both(spark, tables):
    """The packed collection, and its graphs as long tables only."""
    g = co_purchase_graphs(spark, tables).written()
    long_ = co_purchase_graphs(spark, tables)
    return g, type(g)(long_.vertices.cache(), long_.edges.cache(), g.graphs)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_same_graphs(both):
    g, long_ = both
    assert rows(g.vertices, "graph_id", "v", "raw_label") == rows(long_.vertices, "graph_id", "v", "raw_label")
    assert rows(g.edges, "graph_id", "u", "v", "e_ord") == rows(long_.edges, "graph_id", "u", "v", "e_ord")


@pytest.mark.parametrize("smooth", [False, True])
@pytest.mark.parametrize("p", [2.0, 3.0])
def test_edge_weights(both, smooth, p):
    g, long_ = both
    want = wl.weight_history(long_, wl.history(long_, 2), p=p, smooth=smooth)
    found = packed.edge_weights(g.packed, [0, 1, 2], p=p, smooth=smooth)
    names = "it", "graph_id", "u", "v", "e_ord", "weight"
    assert rows(found, *names) == rows(want, *names)


def test_filtrations(both):
    g, long_ = both
    labels, want = persistence.persistent_wl(long_, 2)
    assert rows(packed.cycle_edges(g.packed), "it", "graph_id", "u", "v", "e_ord", "weight") == rows(want.where("kind = 'cycle'"), "it", "graph_id", "a", "b", "e_ord", "value")
    names = "it", "graph_id", "block", "label", "value"
    flags = {"cycle": True, "total": True, "infinity": True}
    assert rows(experiment.persistent_features(g, **flags), *names) == rows(experiment.persistent_features(long_, **flags), *names)


@pytest.mark.parametrize("few", [1, 3, 10**6])
def test_merges_equal_a_plain_union_find(few):
    rng = np.random.default_rng(few)
    a, b, first, n = [], [], [0], 0
    for size in (0, 1, 60, 5, 30):
        for _ in range(size * 2):
            a.append(n + rng.integers(size)), b.append(n + rng.integers(size))
        n, first = n + size, [*first, len(a)]
    sets = persistence.UnionFind(max)
    want = [-1 if (x := sets.merge(int(i), int(j))) is None else x for i, j in zip(a, b)]
    assert packed.merges(n, np.array(a), np.array(b), np.array(first), few).tolist() == want


@pytest.mark.parametrize("name", ["wl_edge_weight_it1", "wl_edge_weight_smooth", "cycle_edges", "pwl_total_persistence", "pwl_infinity_norm"])
def test_one_pass_behind_the_joins_that_make_the_graphs(spark, tables, name):
    """Disk: each of these shuffled edges or vertices a dozen times."""
    assert shuffles(catalog.QUERIES[name](spark, tables)) <= 3


@pytest.mark.parametrize("name", ["pwl_label_persistence", "pwlc_cycle_persistence", "pwl_feature_blocks"])
def test_only_signatures_are_shuffled(spark, tables, name):
    assert shuffles(catalog.QUERIES[name](spark, tables)) <= 2
