"""Learned structure elements: slopes against finite differences and the pass against a plain second version."""

import numpy as np
import pytest

from graphloom.operators import signature_training as st
from graphloom.operators.gcn_training import Schedule

SHAPE = st.Shape((("finite0", 2, 4, 3), ("never0", 1, 3, 2)), (4, 3), 0.0)


def points_of(spark, rows):
    return st.chunks(spark.createDataFrame(rows, "graph_id long, part string, x double, y double")).cache()


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(2)
    rows = [(g, "finite0", *map(float, rng.random(2).round(2))) for g in range(9) for _ in range(rng.integers(1, 6))]
    rows += [(g, "never0", round(rng.random(), 2), None) for g in range(0, 8) for _ in range(2)]
    rows += rows[:3] + [(3, "other", 0.5, None), (77, "never0", 0.1, None)]
    truth = [(g, g % 3) for g in range(10)]  # graph 9 has no point, graph 77 no class
    return rows, truth, points_of(spark, rows), spark.createDataFrame(truth, "graph_id long, y long").cache()


def plain_loss(model, rows, truth):
    """Minus the mean log-probability with all graphs as one group, by definition."""
    ins = []
    for name, axes, n, _ in SHAPE.parts:
        c, s = model.elements[name]
        x = np.zeros((len(truth), n))
        for g, part, *at in rows:
            for e in range(n):
                if part == name and g < len(truth):
                    x[g, e] += np.exp(-sum(s[e, a] * (at[a] - c[e, a]) ** 2 for a in range(axes)))
        ins.append(x)
    p = iter(model.params)
    norm = lambda x, g, b: (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5) * g + b
    first = []
    for x in ins:
        x = norm(x @ next(p) + next(p), next(p), next(p))
        first.append(np.maximum(x @ next(p) + next(p), 0))
    x = np.hstack(first)
    for k in range(3):
        x = norm(x @ next(p) + next(p), next(p), next(p))
        x = np.maximum(x, 0) if k < 2 else x
    share = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    return -np.mean([np.log(share[g, y]) for g, y in truth])


def test_gradients_are_finite_differences(problem):
    rows, truth, points, table = problem
    model = st.SignatureNetwork(3, SHAPE)
    loss, slopes = model.gradients(points, table)
    assert loss == pytest.approx(plain_loss(model, rows, truth))
    for p, g in zip(model.everything(), slopes):
        for i in np.ndindex(p.shape):
            was = p[i]
            p[i] = was + 1e-6
            up = plain_loss(model, rows, truth)
            p[i] = was - 1e-6
            down = plain_loss(model, rows, truth)
            p[i] = was
            assert (up - down) / 2e-6 == pytest.approx(g[i], abs=2e-6)


def test_dropout_and_groups_go_both_ways(problem):
    """With masks fixed by epoch and group the slopes are those of the masked loss."""
    *_, points, table = problem
    model = st.SignatureNetwork(3, st.Shape(SHAPE.parts, SHAPE.trunk, 0.3))
    _, slopes = model.gradients(points, table, 4, groups=2)
    for k, i in ((0, (1, 1)), (3, (2, 0)), (4, (1, 2))):
        p, was = model.everything()[k], model.everything()[k][i]
        p[i] = was + 1e-5
        up = model.gradients(points, table, 4, groups=2)[0]
        p[i] = was - 1e-5
        down = model.gradients(points, table, 4, groups=2)[0]
        p[i] = was
        assert (up - down) / 2e-5 == pytest.approx(slopes[k][i], abs=2e-5)


def test_large_diagram_is_many_chunks(spark):
    """A graph of many points is several rows; values and slopes are those of one."""
    rng = np.random.default_rng(3)
    rows = [(1, "never0", float(x), None) for x in rng.random(5_000)]
    points = points_of(spark, rows + rows[:7])
    assert points.count() >= 4 and max(len(r.xs) for r in points.collect()) < 2 * st.CHUNK
    c, s = np.array([[0.2], [0.7]]), np.array([[3.0], [5.0]])
    found = sum(np.array(r["values"]) for r in st.element_values(points, {"never0": (c, s)}).collect())
    x = np.array([r[2] for r in rows + rows[:7]])[:, None]
    assert found == pytest.approx(np.exp(-s[:, 0] * (x - c[:, 0]) ** 2).sum(0))
    slope = spark.createDataFrame([(1, "never0", [1.0, -2.0])], "graph_id long, part string, slope array<double>")
    by_c, by_s = st.element_slopes(points, slope, {"never0": (c, s)})["never0"]
    w = np.exp(-s[:, 0] * (x - c[:, 0]) ** 2) * [1.0, -2.0]
    assert by_c[:, 0] == pytest.approx((w * 2 * s[:, 0] * (x - c[:, 0])).sum(0))
    assert by_s[:, 0] == pytest.approx((-w * (x - c[:, 0]) ** 2).sum(0))


def test_training_and_prediction(spark):
    """Classes differ by where two of three births lie. The loss falls; told classes are those of a plain pass."""
    rng = np.random.default_rng(4)
    births = [[*(np.array([0.3, 0.7] if g % 2 else [0.5, 0.5]) + rng.normal(0, 0.02, 2)), rng.random()] for g in range(60)]
    points = points_of(spark, [(g, "never0", float(x), None) for g, xs in enumerate(births) for x in xs])
    table = spark.createDataFrame([(g, g % 2) for g in range(60)], "graph_id long, y long").cache()
    shape = st.Shape((("never0", 1, 4, 4),), (4,), 0.0)
    model = st.SignatureNetwork(2, shape, group=60)
    before = [x.copy() for x in model.everything()]
    model.fit(points, table, 3, Schedule("adam", 0.05)).fit(points, table, 3, Schedule("adam", 0.05))
    assert len(model.losses) == 6 and model.losses[-1] < model.losses[0] - 0.05
    assert all((a != b).any() for a, b in zip(before[:2], model.everything()))
    c, s = model.elements["never0"]
    x = np.array([np.exp(-s[:, 0] * (np.array(b)[:, None] - c[:, 0]) ** 2).sum(0) for b in births])
    net = st._Pass(shape, 2, model.params, model.means, np.random.default_rng(0))
    net.forward([x])
    assert all(a == pytest.approx(b) for a, b in zip(model.means, net.seen))
    log = st._log_shares(st._Pass(shape, 2, model.params, model.means, None).forward([x]))
    found = {r.graph_id: (r.prediction, r.score) for r in model.predict(points, table).collect()}
    assert {g: p for g, (p, _) in found.items()} == {g: int(log[g].argmax()) for g in range(60)}
    assert [found[g][1] for g in range(60)] == pytest.approx(list(np.exp(log.max(1))))


def test_fixed_elements_stay(problem):
    *_, points, table = problem
    model = st.SignatureNetwork(3, SHAPE, fixed=True)
    before = [x.copy() for x in model.everything()]
    model.fit(points, table, 1)
    same = [(a == b).all() for a, b in zip(before, model.everything())]
    assert all(same[:4]) and not any(same[4::6])


def test_empty_tables(spark):
    points = points_of(spark, [])
    truth = spark.createDataFrame([], "graph_id long, y long")
    model = st.SignatureNetwork(2, SHAPE).fit(points, truth, 1)
    assert model.losses == [0.0] and model.predict(points, truth).count() == 0
