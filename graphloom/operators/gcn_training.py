"""Training of a two-layer graph convolution.

Vertices have rows with a column for each hidden unit or class; the adjacency is a table of arcs. A layer is
a join along the arcs, and its backward pass a join along the same arcs turned round. Weights and the
optimiser's state have the size of the model, whatever the graph's; only they are on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tables import materialise, portable_hash

_ID = ["graph_id", "v"]


@dataclass(frozen=True)
class Schedule:
    """``sgd`` or ``adam``; the rate is multiplied by ``gamma`` at each of the milestones (epochs, from 0)."""

    name: str = "adam"
    rate: float = 0.01
    weight_decay: float = 0.0
    momentum: float = 0.0
    milestones: tuple[int, ...] = ()
    gamma: float = 0.1

    def __post_init__(self) -> None:
        if self.name not in ("sgd", "adam"):
            raise ValueError(f"unknown optimiser {self.name!r}")

    def rate_at(self, epoch: int) -> float:
        return self.rate * self.gamma ** sum(epoch >= m for m in self.milestones)

    def step(self, epoch: int, params: list[np.ndarray], slopes: list[np.ndarray], state: list[list[np.ndarray]]) -> None:
        """Moves the parameters; ``state`` (empty at first) keeps the running means from step to step."""
        rate = self.rate_at(epoch)
        if not state:
            state += [[np.zeros_like(p), np.zeros_like(p), np.zeros(())] for p in params]
        for p, g, (m, s, n) in zip(params, slopes, state):
            g = g + self.weight_decay * p
            n += 1
            if self.name == "sgd":
                m[...] = self.momentum * m + g
                p -= rate * m
            else:
                m[...] = 0.9 * m + 0.1 * g
                s[...] = 0.999 * s + 0.001 * g * g
                p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.999**n)) + 1e-8)


def initial(features: int, hidden: int, classes: int, seed: int = 1) -> list[np.ndarray]:
    """Weights and biases of both layers, uniform within 1 / sqrt(a layer's width)."""
    rng = np.random.default_rng(seed)
    draw = lambda width, *shape: rng.uniform(-1, 1, shape) / np.sqrt(width)
    return [draw(hidden, features, hidden), draw(hidden, hidden), draw(classes, hidden, classes), draw(classes, classes)]


def _columns(n: int, name: str) -> list[str]:
    return [f"{name}{k}" for k in range(n)]


def _dot(values: list[Column], weights: np.ndarray) -> Column:
    return sum((v * F.lit(float(w)) for v, w in zip(values, weights)), F.lit(0.0))


def _spread(rows: DataFrame, adj: DataFrame, columns: list[str], turned: bool = False) -> DataFrame:
    """graph_id, v and the columns of A times the rows, or of A turned round."""
    come, go = ("i", "j") if turned else ("j", "i")
    near = adj.join(rows.withColumnRenamed("v", come), ["graph_id", come])
    return near.groupBy("graph_id", F.col(go).alias("v")).agg(*[F.sum(F.col("a") * F.col(c)).alias(c) for c in columns])


@dataclass
class Training:
    """Vertices' sparse features x(graph_id, v, f, value) with f from 0, the normalised adjacency (graph_id, i, j, a)
    with all vertices on its diagonal, and the model's weights."""

    x: DataFrame
    adj: DataFrame
    params: list[np.ndarray]
    dropout: float = 0.0
    seed: int = 1
    losses: list[float] = field(default_factory=list)
    state: list = field(default_factory=list)

    def _mask(self, epoch: int, k: int) -> Column:
        """What a hidden unit is multiplied by in training."""
        if not self.dropout:
            return F.lit(1.0)
        kept = portable_hash(self.seed, epoch, k, F.col("graph_id"), F.col("v")) >= self.dropout
        return F.when(kept, 1 / (1 - self.dropout)).otherwise(0.0)

    def _layers(self, epoch: int | None) -> tuple[DataFrame, DataFrame]:
        """Both layers' sums (z..., before the hidden units' cut at 0) and (o...); without an epoch nothing is
        dropped out."""
        w1, b1, w2, b2 = self.params
        z, o = _columns(w1.shape[1], "z"), _columns(w2.shape[1], "o")
        spark = self.x.sparkSession
        weights = spark.createDataFrame([(f, *map(float, row)) for f, row in enumerate(w1)], "f long, " + ", ".join(f"{c} double" for c in z))
        rows = self.x.join(F.broadcast(weights), "f").groupBy(*_ID).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in z])
        first = _spread(rows, self.adj, z)
        every = self.adj.where("i = j").select("graph_id", F.col("i").alias("v"))
        first = every.join(first, _ID, "left").select(*_ID, *[(F.coalesce(c, F.lit(0.0)) + F.lit(float(b))).alias(c) for c, b in zip(z, b1)])
        first = materialise(first)
        hidden = self._hidden(first, epoch)
        second = _spread(hidden.select(*_ID, *[_dot([F.col(c) for c in z], w2[:, k]).alias(c2) for k, c2 in enumerate(o)]), self.adj, o)
        return first, materialise(second.select(*_ID, *[(F.col(c) + F.lit(float(b))).alias(c) for c, b in zip(o, b2)]))

    def _hidden(self, first: DataFrame, epoch: int | None) -> DataFrame:
        z = [c for c in first.columns if c not in _ID]
        mask = (lambda k: F.lit(1.0)) if epoch is None else (lambda k: self._mask(epoch, k))
        return first.select(*_ID, *[(F.greatest(F.col(c), F.lit(0.0)) * mask(k)).alias(c) for k, c in enumerate(z)])

    def gradients(self, truth: DataFrame, epoch: int = 0) -> tuple[float, list[np.ndarray]]:
        """The mean of minus the log-probability of the true class over truth(graph_id, v, y), y from 0, and its
        slopes by the parameters."""
        w1, _, w2, _ = self.params
        z, o = _columns(w1.shape[1], "z"), _columns(w2.shape[1], "o")
        first, second = self._layers(epoch)
        n = truth.count()
        top = F.greatest(*o) if len(o) > 1 else F.col(o[0])
        total = sum((F.exp(F.col(c) - top) for c in o), F.lit(0.0))
        share = [F.exp(F.col(c) - top) / total for c in o]
        cost = F.log(total) + top - F.element_at(F.array(*o), F.col("y").cast("int") + 1)
        slope = second.join(truth, _ID).select(*_ID, cost.alias("cost"), *[((p - (F.col("y") == k).cast("double")) / n).alias(c) for k, (p, c) in enumerate(zip(share, o))])
        slope = materialise(slope)
        loss, *db2 = slope.agg(F.sum("cost"), *[F.sum(c) for c in o]).first()
        back = _spread(slope.drop("cost"), self.adj, o, turned=True)
        hidden = self._hidden(first, epoch).withColumnsRenamed({c: f"h_{c}" for c in z})
        both = materialise(first.join(hidden, _ID).join(back, _ID))
        dz = [F.when(F.col(c) > 0, _dot([F.col(x) for x in o], w2[k]) * self._mask(epoch, k)).otherwise(0.0).alias(c) for k, c in enumerate(z)]
        dw2 = both.agg(*[F.sum(F.col(f"h_{a}") * F.col(b)) for a in z for b in o]).first()
        dz1 = materialise(both.select(*_ID, *dz))
        db1 = dz1.agg(*[F.sum(c) for c in z]).first()
        by_f = self.x.join(_spread(dz1, self.adj, z, turned=True), _ID).groupBy("f").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in z])
        dw1 = np.zeros_like(w1)
        for row in by_f.collect():  # the size of the weights
            dw1[row[0]] = row[1:]
        number = lambda xs: np.array([x or 0.0 for x in xs])
        return (loss or 0.0) / max(1, n), [dw1, number(db1), number(dw2).reshape(w2.shape), number(db2)]

    def fit(self, truth: DataFrame, epochs: int, schedule: Schedule = Schedule()) -> Training:
        """Trains on; each epoch is one step down the whole of ``truth``. A trained model can be trained further."""
        for epoch in range(len(self.losses), len(self.losses) + epochs):
            loss, slopes = self.gradients(truth, epoch)
            self.losses.append(loss)
            schedule.step(epoch, self.params, slopes, self.state)
        return self

    def scores(self) -> DataFrame:
        """graph_id, v, f (a class), value: log-probabilities, as ``gcn.forward`` gives them."""
        second = self._layers(None)[1]
        o = [c for c in second.columns if c not in _ID]
        top = F.greatest(*o) if len(o) > 1 else F.col(o[0])
        total = F.log(sum((F.exp(F.col(c) - top) for c in o), F.lit(0.0))) + top
        each = F.array(*[F.struct(F.lit(k).cast("long").alias("f"), (F.col(c) - total).alias("value")) for k, c in enumerate(o)])
        return second.select(*_ID, F.explode(each).alias("s")).select(*_ID, "s.f", "s.value")
