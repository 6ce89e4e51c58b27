"""Gram matrices by cross joins of blocks."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import kernels, packed
from graphloom.plans import catalog
from tests.test_packed import both, rows, shuffles, tables  # noqa: F401


@pytest.mark.parametrize("size", [1, 4, 512])
def test_features_and_products(both, size):  # noqa: F811
    g, long_ = both
    want = kernels.wl_features(long_, 3)
    found = packed.wl_rows(g.packed, 3)
    names = "g1", "g2", "k"
    assert rows(kernels.gram_rows(found, size), *names) == rows(kernels.gram(want, long_.graphs), *names)
    asked = F.expr("graph_id % 5 = 0")
    assert rows(kernels.gram_rows(found, size, asked), *names) == rows(kernels.gram(want, long_.graphs.where(asked)), *names)


def test_graphlets(both):  # noqa: F811
    g, long_ = both
    names = "graph_id", "empty", "edge", "path", "triangle"
    assert rows(packed.graphlets3(g.packed), *names) == rows(kernels.graphlets3(long_), *names)


@pytest.mark.parametrize("name", ["graphlet_kernel", "wl_kernel", "graphlet_gram", "wl_gram", "sp_kernel"])
def test_no_pair_is_shuffled(spark, tables, name):  # noqa: F811
    """Disk: the matrices sent each graph once to each pair of blocks, the searches summed up pairs."""
    assert shuffles(catalog.QUERIES[name](spark, tables)) == 0


def test_largest_degree(both):  # noqa: F811
    g, _ = both
    top = packed.largest(g.packed, packed.degree)
    ends = packed.edges(g.packed).select("graph_id", F.explode(F.array("u", "v")).alias("v")).groupBy("graph_id", "v").count()
    want = packed.vertices(g.packed).join(ends, ["graph_id", "v"], "left").groupBy("graph_id").agg(F.coalesce(F.max("count"), F.lit(0)).cast("double").alias("weight"))
    assert rows(top, "graph_id", "weight") == rows(want, "graph_id", "weight")
