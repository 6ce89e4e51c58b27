"""Parts that no query reaches."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from graphloom.functions import signatures
from graphloom.functions.tables import materialise, scratch, shared_dir
from graphloom.model import build
from graphloom.operators import evaluate, persistence, vectorize, walks, wl
from graphloom.sources import files


def graph(spark, pairs, edge_labels=None):
    pairs = spark.createDataFrame(pairs, "graph_id long, u long, v long")
    labels = None if edge_labels is None else spark.createDataFrame(edge_labels, "graph_id long, u long, v long, label string")
    return build(pairs, edge_labels=labels)


def test_edge_labels_only_where_their_number_is_right(spark):
    g = graph(spark, [(1, 2, 1), (1, 2, 3), (2, 5, 6), (2, 6, 7)], [(1, 1, 2, "a"), (1, 3, 2, "b"), (2, 5, 6, "c")])
    assert sorted(tuple(r) for r in g.edges.select("graph_id", "u", "v", "label").collect()) == [(1, 1, 2, "a"), (1, 2, 3, "b"), (2, 5, 6, None), (2, 6, 7, None)]


def test_written_collections_are_the_same(spark):
    g = graph(spark, [(1, 2, 1), (1, 2, 3)])
    kept = g.written()
    assert kept.written() is kept
    assert sorted(map(tuple, kept.neighbours().collect())) == sorted(map(tuple, g.neighbours().collect()))


def test_unknown_signature(spark):
    g = graph(spark, [(1, 1, 2)])
    assert {r.weight for r in signatures.signature(g, "vertex_degree").collect()} == {1.0}
    with pytest.raises(ValueError):
        signatures.signature(g, "no such")


def test_head_split(spark):
    rows = evaluate.head_split(spark.range(25).withColumnRenamed("id", "at"), "at")
    assert sorted(r["at"] for r in rows.where("part = 'test'").collect()) == [0, 1]


def test_remove_diagonal(spark):
    points = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (3.0, None)], "birth double, death double")
    assert sorted(r.birth for r in persistence.remove_diagonal(points).collect()) == [1.0, 3.0]


def test_scratch_deletes_what_it_wrote(spark):
    with scratch(spark):
        inside = materialise(spark.range(3))
        assert inside.count() == 3
    outside = materialise(spark.range(3))
    assert outside.agg(F.sum("id")).first()[0] == 3
    with pytest.raises(Exception):
        inside.count()
    assert shared_dir(spark)


def test_seed_dictionary(spark):
    labels = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 9)], "graph_id long, v long, raw_label long")
    g = build(spark.createDataFrame([(1, 1, 2)], "graph_id long, u long, v long"), labels)
    known = spark.createDataFrame([(9, 4)], "raw_label long, label long")
    got = {(r.graph_id, r.v): r.label for r in wl.initial_labels(g, known).collect()}
    assert got == {(1, 1): 5, (1, 2): 6, (1, 3): 4, (2, 1): 4}
    assert {r.label for r in wl.initial_labels(g, known.limit(0)).collect()} == {0, 1, 2}


def test_cycle_pairs():
    square = [(0, 1), (1, 2), (2, 3), (0, 3)]
    assert list(persistence.cycle_pairs({0: 1.0, 1: 5.0, 2: 2.0, 3: 3.0}, square)) == [(5.0, 1.0)]
    both = square + [(0, 2)]  # two cycles that share the edge 0-2
    assert sorted(persistence.cycle_pairs({0: 1.0, 1: 5.0, 2: 2.0, 3: 3.0}, both)) == [(3.0, 1.0), (5.0, 1.0)]
    assert list(persistence.cycle_pairs({0: 1.0, 1: 2.0}, [(0, 1)])) == []
    apart = square + [(a + 9, b + 9) for a, b in square]
    weight = {v: float(v) for v in (0, 1, 2, 3, 9, 10, 11, 12)}
    assert sorted(persistence.cycle_pairs(weight, apart)) == [(3.0, 0.0), (12.0, 9.0)]


def test_number_of_extended_cycles(spark):
    g = graph(spark, [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4), (2, 1, 2), (2, 2, 2)])
    found = persistence.extended_cycles(g, signatures.degree(g)).collect()
    assert sorted((r.graph_id, r.birth, r.death) for r in found) == [(1, 3.0, 2.0), (2, 3.0, 3.0)]


def test_projection_and_groups(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 0, 0.0, None), (1, 1, 2.0, None), (1, 1, 2.0, 3.0)], "graph_id long, dim int, birth double, death double")
    assert sorted(r.part for r in vectorize.diagram_groups(points).collect()) == ["finite0", "never0", "never1"]
    pooled = vectorize.deep_set(points.where("dim = 0"), [[1.0, 2.0], [0.0, 1.0]], [0.5, 0.0])
    scores = vectorize.project(pooled, [[1.0, 0.0], [2.0, 3.0]], [0.0, 1.0])
    assert {r.cls: r.score for r in scores.collect()} == {0: 4.5, 1: 4.0}


def test_caches_and_names(spark, tmp_path):
    path = files.named_path(str(tmp_path), "gc", q=2.0, p=1)
    assert path == f"{tmp_path}/gc/p=1,q=2.0"
    made = []
    for _ in range(2):
        assert files.cached(spark, path, lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    members = spark.createDataFrame([(1, 3), (1, 0), (2, 5)], "v long, group_idx long")
    assert sorted(map(tuple, files.first_labels(members).collect())) == [(1, 0), (2, 5)]


def test_walk_estimator_keeps_its_result(spark, tmp_path):
    g = files.karate_club(spark)
    arcs = walks.directed(g.edges.withColumn("weight", F.lit(1.0)))
    model = walks.Node2Vec(length=5, n=2, size=4, window=2)
    first = {r.v: r.embedding for r in model.fit_or_load(g.vertices, arcs, str(tmp_path), "karate").collect()}
    assert len(first) == 34 and {len(x) for x in first.values()} == {4}
    assert {r.v: r.embedding for r in model.fit_or_load(g.vertices.limit(0), arcs, str(tmp_path), "karate").collect()} == first


def test_one_vs_rest_probabilities(spark):
    rows = [(i, Vectors.dense([float(i % 2), 1.0]), [i % 2]) for i in range(20)]
    rows = spark.createDataFrame(rows, ["id", "features", "classes"])
    found = {(r.id, r.cls): r.score for r in evaluate.one_vs_rest_probabilities(rows, rows, 2).collect()}
    assert all((found[i, i % 2] > 0.5) and (found[i, 1 - i % 2] < 0.5) for i in range(20))
