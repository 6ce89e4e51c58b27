"""Feature vectors and cross-validated scores of the experiments."""

from dataclasses import replace

import pytest

from graphloom.operators import evaluate, kernels
from graphloom.plans import experiment
from tests.test_graphs import graph_set


def test_vectors_are_the_cosine_kernel(spark):
    rows = [(g, f"f{k}", 0.25 * (g + 1) + k % 7) for g in range(4) for k in range(g, 3000, g + 1)]
    features = spark.createDataFrame(rows, "graph_id long, feature string, n double")
    graphs = spark.range(5).withColumnRenamed("id", "graph_id")
    got = {r.graph_id: r.features for r in experiment.vectors(features, graphs).collect()}
    assert {len(x) for x in got.values()} == {3000} and got[4].numNonzeros() == 0
    for r in kernels.gram(features, graphs).collect():
        assert got[r.g1].dot(got[r.g2]) == pytest.approx(r.k)


def test_scores_average_the_folds(spark, monkeypatch):
    # seven classes, told apart by how many vertices have the label
    labels = {g: ({v: int(v <= g % 7) for v in range(8)}, [(v, v + 1) for v in range(7)]) for g in range(70)}
    g = graph_set(spark, labels)
    g = replace(g, graphs=spark.createDataFrame([(k, f"c{k % 7}") for k in labels], "graph_id long, y string"))
    fits = []

    def spy(*args, _of=evaluate.classifier):
        fits.append(args)
        return _of(*args)

    monkeypatch.setattr(evaluate, "classifier", spy)
    found = experiment.run(g, {"graph_vector": "wl-subtree", "classifier": "logistic", "folds": 3}).collect()
    assert len(fits) == 3 and {x[2] for x in fits} == {7} and len(found) == 1 and found[0].accuracy > 0.9
