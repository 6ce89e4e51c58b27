"""Training of structure elements over persistence diagrams together with the network behind them.

A graph's points are kept as bounded chunks, several rows for a large diagram. A structure element's value is a
sum over points, so both its value and its slopes are sums over chunks: the forward pass adds the chunks of a
graph, the backward pass joins the chunks with the graph's slopes. The network between sees one row of fixed
size for each graph. Batch normalisation takes its means over groups of about ``group`` graphs, dealt anew by
hash in each epoch; a step adds the slopes of all groups of its batch. Only parameters and sums of their size
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tables import materialise, portable_hash
from graphloom.operators.gcn_training import Schedule

CHUNK = 1_000
_EPS = 1e-5


def chunks(points: DataFrame) -> DataFrame:
    """graph_id, part, xs, ys, ns from points(graph_id, part, x, y), y null for points of one coordinate: each
    distinct point with its number, about ``CHUNK`` of them a row, spread by hash."""
    each = points.groupBy("graph_id", "part", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = materialise(each)
    sizes = each.groupBy("graph_id", "part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_k"))
    dealt = each.join(sizes, ["graph_id", "part"]).withColumn("_c", F.pmod(F.xxhash64("x", "y"), F.col("_k")))
    packed = dealt.groupBy("graph_id", "part", "_c").agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("p"))
    return packed.select("graph_id", "part", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.n").alias("ns"))


def _located(row, width: int) -> np.ndarray:
    """A chunk's points, one row each."""
    xs = np.asarray(row.xs, float)[:, None]
    return xs if width == 1 else np.column_stack([xs[:, 0], np.asarray(row.ys, float)])


def element_values(points: DataFrame, elements: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """graph_id, part, values of each chunk: for each element of its part, centres and sharpness [element, axis],
    the sum over points of exp(-sum over axes of sharpness x squared distance)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                c, s = elements[row.part]
                gap = _located(row, c.shape[1])[:, None, :] - c
                out.append(np.asarray(row.ns) @ np.exp(-(gap * gap * s).sum(2)))
            if out:  # an empty frame would have no lists to take the type from
                yield pd.DataFrame({"graph_id": frame["graph_id"], "part": frame["part"], "values": out})

    known = points.where(F.col("part").isin(*elements))
    return known.mapInPandas(run, "graph_id long, part string, values array<double>")


def element_slopes(points: DataFrame, slopes: DataFrame, elements: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The slopes by centres and sharpness of a loss whose slopes by the elements' values are
    slopes(graph_id, part, slope array), summed over all chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for row in frame.itertuples():
                c, s = elements[row.part]
                gap = _located(row, c.shape[1])[:, None, :] - c
                w = np.asarray(row.ns)[:, None] * np.exp(-(gap * gap * s).sum(2)) * np.asarray(row.slope)
                by = np.stack([2 * s * np.einsum("pe,pea->ea", w, gap), -np.einsum("pe,pea->ea", w, gap * gap)])
                total[row.part] = total.get(row.part, 0.0) + by
        if total:
            yield pd.DataFrame({"part": [*total], "values": [t.ravel() for t in total.values()]})

    rows = points.join(slopes, ["graph_id", "part"]).mapInPandas(run, "part string, values array<double>")
    found = {p: np.zeros((2, *c.shape)) for p, (c, _) in elements.items()}
    for part, values in _summed(materialise(rows)).items():
        found[part] = values.reshape(found[part].shape)
    return {p: (x[0], x[1]) for p, x in found.items()}


def _summed(rows: DataFrame) -> dict[str, np.ndarray]:
    """The sums of written rows(part, values) by part: added in each partition that is read, then here. A
    partition holds as many rows as fit spark.sql.files.maxPartitionBytes, so few come here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for part, values in zip(frame["part"], frame["values"]):
                total[part] = total.get(part, 0.0) + np.asarray(values)
        if total:
            yield pd.DataFrame({"part": [*total], "values": [*total.values()]})

    total: dict[str, np.ndarray] = {}
    for part, values in rows.mapInPandas(run, rows.schema).toLocalIterator():
        total[part] = total.get(part, 0.0) + np.asarray(values)
    return total


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """A flat sum as arrays of the sizes of ``like``."""
    cuts = np.cumsum([x.size for x in like])[:-1]
    return [x.reshape(y.shape) for x, y in zip(np.split(flat, cuts), like)]


def _layers(widths: list[int], dropped: set[int] = frozenset()) -> list[tuple]:
    """Linear, normalised and cut at 0 from width to width; the last without a cut."""
    found: list[tuple] = []
    for k, (a, b) in enumerate(zip(widths, widths[1:])):
        found += [("linear", a, b), ("norm", b)]
        found += [("drop",)] if k in dropped else []
        found += [("cut",)] if k < len(widths) - 2 else []
    return found


@dataclass(frozen=True)
class Shape:
    """Elements and first-stage units of each part (name, axes, elements, units) and the trunk's widths."""

    parts: tuple[tuple[str, int, int, int], ...] = (("finite0", 2, 150, 75), ("never0", 1, 50, 25), ("never1", 1, 50, 25))
    trunk: tuple[int, ...] = (200, 100, 50)
    dropout: float = 0.1

    def stacks(self, classes: int) -> list[list[tuple]]:
        """The layers of each part's first stage and of the trunk."""
        first = [[("linear", n, u), ("norm", u), ("drop",), ("linear", u, u), ("cut",), ("drop",)] for _, _, n, u in self.parts]
        return [*first, _layers([sum(u for *_, u in self.parts), *self.trunk, classes], {1})]


def initial(shape: Shape, classes: int, seed: int = 1) -> tuple[dict, list[np.ndarray], list[np.ndarray]]:
    """Elements by part, the network's weights, and the means and variances it divides by.

    Centres are uniform in the unit square (above its diagonal, then turned as the points are, for two axes),
    sharpness is 3; weights are uniform within 1 / sqrt(a layer's input)."""
    rng, elements = np.random.default_rng(seed), {}
    for name, axes, n, _ in shape.parts:
        c = rng.random((n, axes))
        if axes == 2:
            c.sort(axis=1)
            x, y = (c[:, 0] + c[:, 1]) / np.sqrt(2), np.maximum(c[:, 1] - c[:, 0], 1e-9) / np.sqrt(2)
            c = np.column_stack([x, np.where(y > 0.1, y, np.log(y / 0.1) + 0.1)])
        elements[name] = (c, np.full((n, axes), 3.0))
    params, means = [], []
    for layer in (x for stack in shape.stacks(classes) for x in stack):
        if layer[0] == "linear":
            bound = 1 / np.sqrt(layer[1])
            params += [rng.uniform(-bound, bound, layer[1:]), rng.uniform(-bound, bound, layer[2])]
        elif layer[0] == "norm":
            params += [np.ones(layer[1]), np.zeros(layer[1])]
            means += [np.zeros(layer[1]), np.ones(layer[1])]
    return elements, params, means


class _Pass:
    """One pass of a group of graphs through the stacks; ``rng`` None is the pass without training."""

    def __init__(self, shape: Shape, classes: int, params: list, means: list, rng: np.random.Generator | None):
        self.stacks, self.dropout, self.rng = shape.stacks(classes), shape.dropout, rng
        self.params, self.means = iter(params), iter(means)
        self.seen: list[np.ndarray] = []  # batch means and variances, in order

    def forward(self, inputs: list[np.ndarray]) -> np.ndarray:
        first, self.back = [], []
        for x, stack in zip(inputs, self.stacks):
            first.append(self._stack(x, stack))
        self.units = np.cumsum([x.shape[1] for x in first])[:-1]
        return self._stack(np.hstack(first), self.stacks[-1])

    def _stack(self, x: np.ndarray, stack: list[tuple]) -> np.ndarray:
        kept = []
        for kind, *_ in stack:
            if kind == "linear":
                w, b = next(self.params), next(self.params)
                kept.append((x, w))
                x = x @ w + b
            elif kind == "norm":
                g, b, mean, var = next(self.params), next(self.params), next(self.means), next(self.means)
                if self.rng is not None:
                    mean, var = x.mean(0), x.var(0)
                    self.seen += [mean, var * len(x) / max(1, len(x) - 1)]
                z, d = (x - mean) / np.sqrt(var + _EPS), np.sqrt(var + _EPS)
                kept.append((z, g, d))
                x = z * g + b
            elif kind == "drop":
                mask = np.ones(x.shape)
                if self.rng is not None and self.dropout:
                    mask = (self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
                kept.append((mask,))
                x = x * mask
            else:
                kept.append((x > 0,))
                x = np.maximum(x, 0)
        self.back.append(kept)
        return x

    def backward(self, slope: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The slopes by the inputs and by the parameters."""
        slope, trunk = self._back(slope, len(self.stacks) - 1)
        found, params = [], []
        for k, part in enumerate(np.split(slope, self.units, axis=1)):
            x, p = self._back(part, k)
            found.append(x)
            params += p
        return found, params + trunk

    def _back(self, slope: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        params: list[np.ndarray] = []
        for (kind, *_), kept in zip(reversed(self.stacks[k]), reversed(self.back[k])):
            if kind == "linear":
                x, w = kept
                params = [x.T @ slope, slope.sum(0)] + params
                slope = slope @ w.T
            elif kind == "norm":
                z, g, d = kept
                params = [(slope * z).sum(0), slope.sum(0)] + params
                dz = slope * g
                slope = (dz - dz.mean(0) - z * (dz * z).mean(0)) / d
            else:
                slope = slope * kept[0]
        return slope, params


def _log_shares(o: np.ndarray) -> np.ndarray:
    o = o - o.max(1, keepdims=True)
    return o - np.log(np.exp(o).sum(1, keepdims=True))


@dataclass
class SignatureNetwork:
    """Learned structure elements, a first stage for each part, and a trunk, over chunks of points.

    ``group`` is the number of graphs that batch normalisation looks at together, ``batches`` the number of
    steps of an epoch. With ``fixed`` the elements stay as they are at first and the network alone learns. A
    fitted network can be fitted further."""

    classes: int
    shape: Shape = Shape()
    group: int = 128
    batches: int = 1
    seed: int = 1
    fixed: bool = False
    losses: list[float] = field(default_factory=list)
    state: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.elements, self.params, self.means = initial(self.shape, self.classes, self.seed)

    def _sums(self, rows: DataFrame, points: DataFrame, deal: Column) -> DataFrame:
        """rows with their chunks' values beside them, those of a graph together and groups in order."""
        values = element_values(points, self.elements)
        every = rows.withColumn("grp", deal).join(values, "graph_id", "left")
        return every.repartition("grp").sortWithinPartitions("grp", "graph_id", "part")

    def _groups(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[int], list[int], list[np.ndarray]]]:
        """grp, graphs, classes and inputs of each group; chunks are added as they come."""
        names = [p[0] for p in self.shape.parts]
        empty = lambda: [np.zeros(n) for _, _, n, _ in self.shape.parts]
        grp, ids, ys, sums = None, [], [], []
        for frame in frames:
            for g, i, y, part, values in zip(frame["grp"], frame["graph_id"], frame["y"], frame["part"], frame["values"]):
                if g != grp:
                    if ids:
                        yield grp, ids, ys, [np.array(x) for x in zip(*sums)]
                    grp, ids, ys, sums = g, [], [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    ys.append(y)
                    sums.append(empty())
                if part in names:
                    sums[-1][names.index(part)] += np.asarray(values)
        if ids:
            yield grp, ids, ys, [np.array(x) for x in zip(*sums)]

    def gradients(self, points: DataFrame, truth: DataFrame, epoch: int = 0, groups: int = 1) -> tuple[float, list[np.ndarray]]:
        """The mean of minus the log-probability of truth(graph_id, y), y from 0, one row a graph; its slopes by
        elements and weights, as ``everything`` lists them. Graphs without a point count with zeros."""
        shape, classes, params, means, seed = self.shape, self.classes, self.params, self.means, self.seed

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for grp, ids, ys, inputs in self._groups(frames):
                net = _Pass(shape, classes, params, means, np.random.default_rng([seed, epoch, int(grp)]))
                log = _log_shares(net.forward(inputs))
                hit = np.eye(classes)[np.asarray(ys, int)]
                slopes, by = net.backward(np.exp(log) - hit)
                for (name, *_), slope in zip(shape.parts, slopes):
                    yield pd.DataFrame({"graph_id": ids, "part": name, "values": [*slope]})
                flat = np.concatenate([[-(log * hit).sum(), len(ids)], *[x.ravel() for x in by]])
                total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"graph_id": [None], "part": ["sums"], "values": [total]}).astype({"graph_id": "Int64"})

        deal = F.floor(portable_hash(self.seed, epoch, F.col("graph_id")) * groups).cast("int")
        there = points.join(truth.select("graph_id"), "graph_id", "left_semi")
        found = materialise(self._sums(truth.select("graph_id", "y"), there, deal).mapInPandas(run, "graph_id long, part string, values array<double>"))
        sums = _summed(found.where("graph_id is null").select("part", "values")).get("sums")
        if sums is None:
            return 0.0, [np.zeros_like(p) for p in self.everything()]
        (loss, n), flat = sums[:2], sums[2:]
        none = {p: (np.zeros_like(c), np.zeros_like(s)) for p, (c, s) in self.elements.items()}
        by_element = none if self.fixed else element_slopes(points, found.where("graph_id is not null").withColumnRenamed("values", "slope"), self.elements)
        slopes = [x / n for pair in by_element.values() for x in pair]
        return loss / n, slopes + _shaped(flat / n, params)

    def everything(self) -> list[np.ndarray]:
        """All that is learned: centres and sharpness of each part, then the weights."""
        return [x for pair in self.elements.values() for x in pair] + self.params

    def fit(self, points: DataFrame, truth: DataFrame, epochs: int, schedule: Schedule = Schedule("sgd", 0.1)) -> SignatureNetwork:
        """Trains on over chunks and truth(graph_id, y); the loss kept of an epoch is the mean of its steps'."""
        rows = materialise(truth.select("graph_id", "y"))
        groups = max(1, round(rows.count() / self.batches / self.group))
        for epoch in range(len(self.losses), len(self.losses) + epochs):
            each = []
            batch = F.floor(portable_hash(self.seed + 1, epoch, F.col("graph_id")) * self.batches)
            for step in range(self.batches):
                part = rows if self.batches == 1 else rows.where(batch == step)
                loss, slopes = self.gradients(points, part, epoch * self.batches + step, groups)
                each.append(loss)
                schedule.step(epoch, self.everything(), slopes, self.state)
            self.losses.append(float(np.mean(each)))
        self.means = self._means(points, rows, groups)
        return self

    def _means(self, points: DataFrame, rows: DataFrame, groups: int) -> list[np.ndarray]:
        """Means and variances that a pass without training divides by: the groups' averages under the weights as
        they are now. Averages kept while training lag behind weights that still move."""
        shape, classes, params, means = replace(self.shape, dropout=0.0), self.classes, self.params, self.means

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for _, _, _, inputs in self._groups(frames):
                net = _Pass(shape, classes, params, means, np.random.default_rng(0))
                net.forward(inputs)
                flat = np.concatenate([[1.0], *net.seen])
                total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"part": ["means"], "values": [total]})

        deal = F.floor(portable_hash(self.seed, F.col("graph_id")) * groups).cast("int")
        there = points.join(rows.select("graph_id"), "graph_id", "left_semi")
        flat = _summed(materialise(self._sums(rows, there, deal).mapInPandas(run, "part string, values array<double>"))).get("means")
        return means if flat is None else _shaped(flat[1:] / flat[0], means)

    def predict(self, points: DataFrame, graphs: DataFrame) -> DataFrame:
        """graph_id, prediction, score (its probability) of graphs(graph_id), those without a point too."""
        shape, classes, params, means = self.shape, self.classes, self.params, self.means

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, ids, _, inputs in self._groups(frames):
                log = _log_shares(_Pass(shape, classes, params, means, None).forward(inputs))
                yield pd.DataFrame({"graph_id": ids, "prediction": log.argmax(1), "score": np.exp(log.max(1))})

        rows = graphs.select("graph_id", F.lit(0).alias("y"))
        deal = F.pmod(F.xxhash64("graph_id"), F.lit(1 << 20)).cast("int")
        return self._sums(rows, points, deal).mapInPandas(run, "graph_id long, prediction int, score double")
