"""Packed kernels against the operators over long tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import signatures
from graphloom.operators import gcn, gcn_training, kernels, packed, packed_gcn, persistence
from graphloom.plans import catalog, experiment
from tests.test_packed import both, rows, shuffles, tables  # noqa: F401


def without_strangers(g):
    """Edges between vertices only, as the long operators of these tests take them."""
    ends = g.vertices.select("graph_id", "v")
    for c in "uv":
        g = type(g)(g.vertices, g.edges.join(ends.withColumnRenamed("v", c), ["graph_id", c]), g.graphs)
    return type(g)(g.vertices, g.edges.cache(), g.graphs)


def test_heat_kernels(both):  # noqa: F811
    g, long_ = both
    names = "graph_id", "v", "weight"
    want = rows(signatures.heat_kernel(long_), *names)
    assert rows(packed.heat_kernel(g.packed), *names) == want
    assert np.allclose([r[2] for r in rows(packed.heat_kernel_exact(g.packed), *names)], [r[2] for r in want], atol=1e-4)


def test_vertex_diagrams(both):  # noqa: F811
    g, long_ = both
    names = "graph_id", "dim", "birth", "death", "creator"
    known = without_strangers(long_)
    assert rows(packed.vertex_diagram(g.packed, packed.label), *names) == rows(persistence.vertex_diagram(known, signatures.label(known)), *names)
    names = "graph_id", "kind", "birth", "death"
    want = rows(persistence.extended_diagram(known, signatures.label(known)), *names)
    assert rows(packed.extended_diagram(g.packed, packed.label), *names) == want


def test_path_features_and_samples(both):  # noqa: F811
    g, long_ = both
    names = "graph_id", "feature", "n"
    assert rows(packed.shortest_path_features(g.packed), *names) == rows(kernels.shortest_path_features(long_), *names)
    for most in (2, 1024):
        found = packed.sampled_graphlets(g.packed, most=most)
        assert rows(found, *names) == rows(kernels.sampled_graphlets(without_strangers(long_)), *names)


def test_network(both):  # noqa: F811
    g, long_ = both
    known = without_strangers(long_)
    whole = g.packed.where("not array_contains(known, false)")
    ids = whole.select("graph_id")
    x = known.vertices.join(ids, "graph_id").select("graph_id", "v", F.col("raw_label").alias("f"), F.lit(1.0).alias("value"))
    one = known.edges.join(ids, "graph_id").select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("a"))
    adj = gcn.normalised_adjacency(one, x).cache()
    start = lambda: [catalog._weight(5, 4, 1), np.zeros(4), catalog._weight(4, 5, 2), np.zeros(5)]
    schedule, truth = gcn_training.Schedule("adam", 0.01, 5e-4), x.select("graph_id", "v", (F.col("v") % 5).alias("y"))
    want = gcn_training.Training(x, adj, start()).fit(truth, 2, schedule)
    found = packed_gcn.Training(whole, lambda p: p.v % 5, start()).fit(2, schedule)
    assert np.allclose(found.losses, want.losses)
    assert all(np.allclose(a, b) for a, b in zip(found.params, want.params))
    assert rows(found.predict(), "graph_id", "v", "f") == rows(gcn.predict(want.scores()), "graph_id", "v", "f")


def test_degree_diagrams(both):  # noqa: F811
    g, long_ = both
    names = "graph_id", "dim", "birth", "death"
    whole = g.packed.where("not array_contains(known, false)")
    ids = [r.graph_id for r in whole.select("graph_id").collect()]
    only = type(long_)(long_.vertices.where(F.col("graph_id").isin(ids)), long_.edges.where(F.col("graph_id").isin(ids)), long_.graphs)
    found = experiment._degree_diagram(type(g)(only.vertices, only.edges, g.graphs, True, whole))
    assert rows(found, *names) == rows(experiment._degree_diagram(only), *names)


@pytest.mark.parametrize("name", ["gcn_layer", "gcn_forward", "hks_taylor", "hks_exact", "extended_diagram", "sp_features", "graphlet_sampling"])
def test_one_pass_behind_the_joins_that_make_the_graphs(spark, tables, name):  # noqa: F811
    """Disk and time: each of these shuffled edges or vertices several times."""
    assert shuffles(catalog.QUERIES[name](spark, tables)) <= 3


@pytest.mark.parametrize("name", ["gcn_training", "gcn_gradient"])
def test_training_reads_what_is_written_once(spark, tables, name):  # noqa: F811
    assert shuffles(catalog.QUERIES[name](spark, tables)) == 0
