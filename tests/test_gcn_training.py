import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import gcn
from graphloom.operators.gcn_training import Schedule, Training, initial


@pytest.fixture(scope="module")
def problem(spark):
    """Two graphs of seven and four vertices; classes follow the neighbours' features."""
    rng = np.random.default_rng(5)
    arcs = [(0, i, j) for i in range(7) for j in range(i) if rng.random() < 0.4] + [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    vertices = [(0, v) for v in range(7)] + [(1, v) for v in range(4)]
    v = spark.createDataFrame(vertices, "graph_id long, v long")
    a = spark.createDataFrame([(*x, 1.0) for x in arcs], "graph_id long, i long, j long, a double")
    adj = gcn.normalised_adjacency(a, v).cache()
    x = [(g, k, f, float(rng.integers(1, 4))) for g, k in vertices for f in range(4) if rng.random() < 0.6]
    truth = [(g, k, k % 3) for g, k in vertices if k != 2]
    return (
        spark.createDataFrame(x, "graph_id long, v long, f long, value double").cache(),
        adj,
        spark.createDataFrame(truth, "graph_id long, v long, y long").cache(),
        vertices,
    )


def dense(problem):
    x, adj, truth, vertices = problem
    at = {k: i for i, k in enumerate(vertices)}
    big, feats = np.zeros((len(vertices),) * 2), np.zeros((len(vertices), 4))
    for r in adj.collect():
        big[at[r.graph_id, r.i], at[r.graph_id, r.j]] = r.a
    for r in x.collect():
        feats[at[r.graph_id, r.v], r.f] = r.value
    return big, feats, [(at[r.graph_id, r.v], r.y) for r in truth.collect()]


def loss_of(params, big, feats, truth):
    w1, b1, w2, b2 = params
    out = big @ (np.maximum(big @ (feats @ w1) + b1, 0) @ w2) + b2
    log = out - np.log(np.exp(out).sum(1, keepdims=True))
    return -np.mean([log[i, y] for i, y in truth]), log


def test_gradients_are_finite_differences(problem):
    params = initial(4, 5, 3)
    loss, slopes = Training(*problem[:2], params).gradients(problem[2])
    at = dense(problem)
    assert loss == pytest.approx(loss_of(params, *at)[0])
    for p, g in zip(params, slopes):
        for i in np.ndindex(p.shape):
            was = p[i]
            p[i] = was + 1e-6
            up = loss_of(params, *at)[0]
            p[i] = was - 1e-6
            assert (up - loss_of(params, *at)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-6)
            p[i] = was


def test_loss_falls_and_scores_are_those_of_the_forward_pass(spark, problem):
    x, adj, truth, vertices = problem
    model = Training(x, adj, initial(4, 5, 3)).fit(truth, 6, Schedule(rate=0.1))
    assert len(model.losses) == 6 and model.losses[-1] < model.losses[0] - 0.05
    log = loss_of(model.params, *dense(problem))[1]
    for r in model.scores().collect():
        assert r.value == pytest.approx(log[vertices.index((r.graph_id, r.v)), r.f])
    found = gcn.loss(model.scores(), truth.select("graph_id", "v", F.col("y").alias("f"))).first()["loss"]
    assert found < model.losses[-1]


def test_dropout_masks_both_ways(problem):
    """With a mask fixed by the epoch the slopes are those of the masked loss."""
    params = initial(4, 5, 3)
    model = Training(*problem[:2], params, dropout=0.5)
    _, slopes = model.gradients(problem[2], 3)
    for k, i in ((0, (1, 2)), (2, (2, 1))):
        was = params[k][i]
        params[k][i] = was + 1e-5
        up = model.gradients(problem[2], 3)[0]
        params[k][i] = was - 1e-5
        down = model.gradients(problem[2], 3)[0]
        params[k][i] = was
        assert (up - down) / 2e-5 == pytest.approx(slopes[k][i], abs=1e-5)


def test_schedule():
    s = Schedule("sgd", 1.0, momentum=0.5, milestones=(2, 4), gamma=0.1)
    assert [round(s.rate_at(e), 6) for e in range(5)] == [1.0, 1.0, 0.1, 0.1, 0.01]
    p, state = [np.array([1.0])], []
    s.step(0, p, [np.array([0.2])], state)
    s.step(1, p, [np.array([0.2])], state)
    assert p[0][0] == pytest.approx(1 - 0.2 - 0.3)
    p, state = [np.array([1.0])], []
    Schedule("adam", 0.1).step(0, p, [np.array([5.0])], state)
    assert p[0][0] == pytest.approx(0.9)
    p = [np.array([2.0])]
    Schedule("sgd", 0.1, weight_decay=0.5).step(0, p, [np.array([0.0])], [])
    assert p[0][0] == pytest.approx(1.9)
    with pytest.raises(ValueError):
        Schedule("newton")
