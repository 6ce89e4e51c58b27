from dataclasses import replace

import pytest

from graphloom.functions import signatures
from graphloom.operators import persistence
from graphloom.plans import configs
from tests.test_graphs import graph_set, random_graphs

TEXT = """
env:
  small:
    variables:
      dataset_name: [a, b]
      graph_vector: [wl-subtree, persistent-wl]
    report: {type: table, row: graph_vector, col: dataset_name}
  other:
    variables:
      dataset_name: [c]
      graph_vector: [nothing]
model:
  name: any.models.Logistic
dataset:
  dataset_name: ~dataset_name
  graph_vector: ~graph_vector
train:
  cross_validation: 0.5
"""


def test_plans_of_a_file():
    config = configs.read(TEXT)
    each, report = configs.plans(config, "small")
    assert [(p["dataset_name"], p["graph_vector"], p["classifier"], p["folds"]) for p in each] == [
        (d, v, "logistic", 2) for d in "ab" for v in ("wl-subtree", "persistent-wl")
    ]
    assert (report["row"], report["col"]) == ("graph_vector", "dataset_name")
    for bad in (lambda: configs.plans(config), lambda: configs.plans(config, "none"), lambda: configs.plans({"train": {"cross_validation": 0}}), lambda: configs.read("- 1")):
        with pytest.raises(ValueError):
            bad()


def test_run_of_a_file(spark):
    labels = {g: ({v: int(v <= g % 2) for v in range(4)}, [(v, v + 1) for v in range(3)]) for g in range(16)}
    g = graph_set(spark, labels)
    g = replace(g, graphs=spark.createDataFrame([(k, f"c{k % 2}") for k in labels], "graph_id long, y string"))
    config = configs.read(TEXT.replace("[a, b]", "[a]").replace("[wl-subtree, persistent-wl]", "[wl-subtree]"))
    rows = configs.run(config, {"a": g}, "small").collect()
    assert len(rows) == 1 and rows[0].graph_vector == "wl-subtree" and rows[0].a > 0.9
    with pytest.raises(ValueError, match="datasets"):
        configs.run(config, {"z": g}, "small")
    with pytest.raises(ValueError, match="unknown name"):
        configs.run(config, {"c": g}, "other")


def test_diagrams_and_distances_by_name(spark):
    g = graph_set(spark, random_graphs(6, 2))
    plain = persistence.vertex_diagram(g, signatures.degree(g))
    key = lambda df: sorted(map(repr, df.select("graph_id", "dim", "birth", "death").collect()))
    assert key(configs.diagrams(g, {})) == key(plain)
    assert key(configs.diagrams(g, {"normalize": True, "threshold": 0.2})) == key(persistence.threshold(persistence.normalise(plain), 0.2))
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 4)], "g1 long, g2 long")
    found = {(r.g1, r.g2): r.distance for r in configs.distances(g, pairs, {"graph_kernel": "bottleneck_distance"}).collect()}
    points = {}
    for r in plain.where("dim = 0 and death is not null").collect():
        points.setdefault(r.graph_id, []).append((r.birth, r.death))
    assert found == {(a, b): persistence.bottleneck(points.get(a, []), points.get(b, [])) for a, b in [(0, 1), (2, 3), (4, 4)]}
    with pytest.raises(ValueError):
        configs.distances(g, pairs, {"graph_kernel": "wasserstein"})
    with pytest.raises(ValueError):
        configs.diagrams(g, {"graph_filtration": "none"})


def test_network_from_a_config(spark):
    text = """
model: {name: any.models.Signature-Network}
dataset: {dataset_name: a, graph_vector: none}
train: {cross_validation: 0.5, num_epochs: 2, batch_size: 16, optimizer: {name: sgd, lr: 0.2, weight_decay: 0.001}, lr_scheduler: {milestones: [1], gamma: 0.5}}
"""
    (one,), _ = configs.plans(configs.read(text))
    assert (one["classifier"], one["epochs"], one["batch_size"], one["folds"]) == ("signature-network", 2, 16, 2)
    assert [one["schedule"].rate_at(e) for e in (0, 1)] == [0.2, 0.1] and one["schedule"].weight_decay == 0.001
    g = graph_set(spark, random_graphs(20, 5))
    g = replace(g, graphs=g.graphs.selectExpr("graph_id", "cast(graph_id % 2 as string) y"))
    assert 0 <= configs.run(configs.read(text), {"a": g}).first().accuracy <= 1


def test_signature_points_are_parts_of_the_degree_diagram(spark):
    g = graph_set(spark, random_graphs(8, 3))
    points = configs.experiment.signature_points(g)
    found = {r["part"]: r["count"] for r in points.groupBy("part").count().collect()}
    plain = configs.experiment._degree_diagram(g)
    assert found["finite0"] == plain.where("dim = 0 and death > birth").count()
    assert [found[f"never{d}"] for d in (0, 1)] == [plain.where(f"dim = {d} and death is null").count() for d in (0, 1)]
    assert points.where("(part = 'finite0') = (y is null)").count() == 0
