"""The signature classifier's features, the convolution's loss and padded labels."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, gcn
from graphloom.plans import experiment
from tests.test_graphs import graph_set, random_graphs


def test_signature_layers_feed_the_network(spark):
    g = graph_set(spark, random_graphs(20, 5))
    g = replace(g, graphs=g.graphs.select("graph_id", (F.col("graph_id") % 2).cast("string").alias("y")))
    rows = experiment.signature_layers(g).cache()
    n = {r["layer"]: r["n"] for r in rows.selectExpr("split(feature, ':')[0] layer", "feature").distinct().groupBy("layer").count().withColumnRenamed("count", "n").collect()}
    assert n == {"finite0": 150, "never0": 50, "never1": 50}
    assert rows.where("n is null or n < 0").count() == 0
    score = experiment.run(g, {"graph_vector": "signature-layers", "classifier": "dnn", "folds": 2}).first()
    assert 0 <= score.accuracy <= 1


@pytest.mark.parametrize("name", ["persistence-image", "persistence-landscape"])
def test_image_and_landscape_are_registered(spark, name):
    found = experiment.features_of(graph_set(spark, random_graphs(20, 5)), vector=name)
    assert found.columns == ["graph_id", "feature", "n"] and found.count() > 0


def test_loss_over_a_batch(spark):
    scores = spark.createDataFrame([(1, v, f, math.log(p)) for v, f, p in ((1, 0, 0.25), (1, 1, 0.75), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 1.0))], "graph_id long, v long, f int, value double")
    batch = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "graph_id long, v long, f int")
    assert gcn.loss(scores, batch).first().loss == pytest.approx(-(math.log(0.75) + math.log(0.5)) / 2)


def test_padded_labels(spark):
    labels = spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "id long, cls int")
    assert sorted(map(tuple, evaluate.padded_labels(labels, 3).collect())) == [(1, [0, 2, -1]), (2, [1, -1, -1])]
