"""Persistent homology of graphs: edge-weight and vertex-weight filtrations, Rips complexes, features.

The kernels stream a partition's rows sorted by graph and filtration value through a union-find that
holds one graph at a time; a partition holds many graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import GraphSet
from graphloom.operators import wl
from graphloom.operators.matching import bottleneck
from graphloom.operators.paths import PathForest


class UnionFind:
    """Sets over any ids; ``keep(a, b)`` tells which of two roots stays the root."""

    def __init__(self, keep: Callable = max) -> None:
        self.up: dict = {}
        self.keep = keep

    def find(self, x):
        """The root of x, with path compression."""
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def merge(self, x, y):
        """Joins two sets; the root that gives way, or None if they were one."""
        a, b = self.find(x), self.find(y)
        if a == b:
            return None
        stay = self.keep(a, b)
        gone = b if stay == a else a
        self.up[gone] = stay
        return gone

    def roots(self) -> list:
        return [x for x, up in self.up.items() if x == up]


def _by_graph(batches, keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The key and rows of each run of equal keys."""
    key, held = None, []
    for batch in batches:
        data = [batch.column(c).to_pylist() for c in keys + columns]
        for row in zip(*data):
            if row[: len(keys)] != key:
                if held:
                    yield key, held
                key, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if held:
        yield key, held


def _tables(rows: Iterator[tuple], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def kruskal(vertices: DataFrame, weighted: DataFrame, order: str = "sublevel") -> DataFrame:
    """it, graph_id, kind, a, b, e_ord, value of the H0 filtration by edge weight.

    ``weighted`` has (it, graph_id, u, v, e_ord, weight), ``vertices`` (it, graph_id, v). Rows of kind
    ``point`` are vertices a that die at ``value`` because their component meets one with a larger id,
    ``essential`` the largest of each component, which die at the graph's last weight (0.0 without edges),
    ``cycle`` the edges (a, b) that join what is joined, with their weight; ties go by e_ord.
    """
    if order not in ("sublevel", "superlevel"):
        raise ValueError(f"unknown order {order!r}")
    sign = 1 if order == "sublevel" else -1
    none = F.lit(None).cast("long")
    rows = weighted.select("it", "graph_id", (sign * F.col("weight")).alias("w"), F.col("e_ord").cast("long").alias("e_ord"), "u", "v").union(
        vertices.select("it", "graph_id", F.lit(None).cast("double"), none, "v", none)
    )
    schema = pa.schema([("it", pa.int32()), ("graph_id", pa.int64()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("e_ord", pa.int64()), ("value", pa.float64())])

    def solve(batches):
        def rows():
            for key, edges in _by_graph(batches, ("it", "graph_id"), ("w", "e_ord", "u", "v")):
                sets, last = UnionFind(max), 0.0
                for w, e_ord, u, v in edges:
                    if w is None:
                        sets.find(u)
                        continue
                    last = sign * w
                    gone = sets.merge(u, v)
                    if gone is None:
                        yield (*key, "cycle", u, v, e_ord, last)
                    else:
                        yield (*key, "point", gone, None, None, last)
                for v in sorted(sets.roots()):
                    yield (*key, "essential", v, None, None, last)

        yield from _tables(rows(), schema)

    sorted_rows = rows.repartition("it", "graph_id").sortWithinPartitions("it", "graph_id", F.col("w").asc_nulls_first(), "e_ord")
    return sorted_rows.mapInArrow(solve, "it int, graph_id long, kind string, a long, b long, e_ord long, value double")


def persistent_wl(graphs: GraphSet, iterations: int = 2, tau: float = 1.0, p: float = 2.0, smooth: bool = False):
    """(labels, kruskal rows) of the Weisfeiler-Lehman filtration of each iteration."""
    graphs = graphs.written()
    labels = wl.history(graphs, iterations)
    weighted = wl.weight_history(graphs, labels, tau, p, smooth)
    vertices = None
    for it, x in enumerate(labels):
        v = x.select(F.lit(it).alias("it"), "graph_id", "v")
        vertices = v if vertices is None else vertices.union(v)
    return labels, kruskal(vertices, weighted)


def _labels(labels: list[DataFrame], name: str) -> DataFrame:
    found = None
    for it, x in enumerate(labels):
        x = x.select(F.lit(it).alias("it"), "graph_id", F.col("v").alias(name), "label")
        found = x if found is None else found.union(x)
    return found


def diagram(rows: DataFrame) -> DataFrame:
    """it, graph_id, birth, death, creator, essential of the points; births are 0."""
    points = rows.where("kind <> 'cycle'")
    return points.select("it", "graph_id", F.lit(0.0).alias("birth"), F.col("value").alias("death"), F.col("a").alias("creator"), (F.col("kind") == "essential").alias("essential"))


def betti0(rows: DataFrame) -> DataFrame:
    """it, graph_id, betti0: the number of components."""
    return rows.groupBy("it", "graph_id").agg(F.sum((F.col("kind") == "essential").cast("long")).alias("betti0"))


def remove_diagonal(points: DataFrame) -> DataFrame:
    """The points whose birth and death differ."""
    return points.where("birth <> death or death is null")


def label_persistence(labels: list[DataFrame], rows: DataFrame, p: float = 2.0) -> DataFrame:
    """it, graph_id, label, value: the sum of persistence^p over the points that vertices of a label create."""
    points = rows.where("kind <> 'cycle'").join(_labels(labels, "a"), ["it", "graph_id", "a"])
    return points.groupBy("it", "graph_id", "label").agg(F.sum(F.pow(F.abs("value"), F.lit(p))).alias("value"))


def cycle_persistence(labels: list[DataFrame], rows: DataFrame, p: float = 2.0) -> DataFrame:
    """it, graph_id, label, value: each cycle edge gives weight^p to both ends' labels, twice where equal."""
    cycles = rows.where("kind = 'cycle'").select("it", "graph_id", F.explode(F.array("a", "b")).alias("a"), F.pow(F.abs("value"), F.lit(p)).alias("w"))
    return cycles.join(_labels(labels, "a"), ["it", "graph_id", "a"]).groupBy("it", "graph_id", "label").agg(F.sum("w").alias("value"))


def total_persistence(rows: DataFrame, p: float = 2.0) -> DataFrame:
    """it, graph_id, value: the p-norm of the points' persistence."""
    points = rows.where("kind <> 'cycle'").groupBy("it", "graph_id")
    return points.agg(F.pow(F.sum(F.pow(F.abs("value"), F.lit(p))), F.lit(1 / p)).alias("value"))


def infinity_norm(rows: DataFrame, p: float = 2.0) -> DataFrame:
    """it, graph_id, value: the largest persistence^p."""
    return rows.where("kind <> 'cycle'").groupBy("it", "graph_id").agg(F.max(F.pow(F.abs("value"), F.lit(p))).alias("value"))


def vertex_diagram(graphs: GraphSet, weights: DataFrame) -> DataFrame:
    """graph_id, dim, birth, death (null: never), creator of the sublevel filtration by vertex weight
    (graph_id, v, weight).

    A vertex enters at its weight, an edge at the larger of its ends'. Where components meet, the one
    whose least (weight, id) is larger dies. Each cycle edge starts an essential class of dimension 1, with
    no creator. Pairs without persistence are kept.
    """
    side = lambda c: weights.select("graph_id", F.col("v").alias(c), F.col("weight").alias(f"w_{c}"))
    edges = graphs.edges.join(side("u"), ["graph_id", "u"]).join(side("v"), ["graph_id", "v"])
    none = F.lit(None)
    rows = edges.select("graph_id", F.greatest("w_u", "w_v").cast("double").alias("t"), F.lit(1).alias("what"), F.col("e_ord").cast("long").alias("e_ord"), "u", "v").union(
        weights.select("graph_id", F.col("weight").cast("double"), F.lit(0), none.cast("long"), "v", none.cast("long"))
    )
    schema = pa.schema([("graph_id", pa.int64()), ("dim", pa.int32()), ("birth", pa.float64()), ("death", pa.float64()), ("creator", pa.int64())])

    def solve(batches):
        def rows():
            for (g,), items in _by_graph(batches, ("graph_id",), ("t", "what", "u", "v")):
                weight: dict = {}
                sets = UnionFind(lambda a, b: min(a, b, key=lambda x: (weight[x], x)))
                for t, what, u, v in items:
                    if not what:
                        weight[u] = t
                        sets.find(u)
                        continue
                    gone = sets.merge(u, v)
                    yield (g, 1, t, None, None) if gone is None else (g, 0, weight[gone], t, gone)
                for v in sorted(sets.roots()):
                    yield g, 0, weight[v], None, v

        yield from _tables(rows(), schema)

    sorted_rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", "t", "what", F.col("e_ord").asc_nulls_first(), "u")
    return sorted_rows.mapInArrow(solve, "graph_id long, dim int, birth double, death double, creator long")


def extended_diagram(graphs: GraphSet, weights: DataFrame) -> DataFrame:
    """The extended diagram's points of dimension 0: each component's essential class (its least weight) dies
    at its greatest weight on the way down; ordinary pairs as in vertex_diagram. graph_id, kind, birth, death.
    """
    up = vertex_diagram(graphs, weights)
    down = vertex_diagram(graphs, weights.withColumn("weight", -F.col("weight")))
    ordinary = up.where("dim = 0 and death is not null").select("graph_id", F.lit("ordinary").alias("kind"), "birth", "death")
    relative = down.where("dim = 0 and death is not null").select("graph_id", F.lit("relative").alias("kind"), -F.col("birth"), -F.col("death"))
    comp = component_of(graphs)
    range_ = weights.join(comp, ["graph_id", "v"]).groupBy("graph_id", "component").agg(F.min("weight").cast("double").alias("birth"), F.max("weight").cast("double").alias("death"))
    return ordinary.union(relative).union(range_.select("graph_id", F.lit("extended"), "birth", "death"))


def cycle_pairs(weight: dict, edges: list[tuple]) -> Iterator[tuple[float, float]]:
    """(birth, death) of the extended points of dimension 1 of one graph: a cycle is born when its last edge
    enters on the way up (at the larger end's weight) and dies when it is filled on the way down (at an
    edge's smaller end's weight).

    Edges come in the order of the way down. A forest holds, of those so far, the ones that enter first on the way
    up: an edge that closes a cycle fills the one whose last edge on the way up is the cycle's largest, and that edge
    leaves the forest. So each edge costs a few path queries, and no column is kept.
    """
    number = {v: k for k, v in enumerate(weight)}
    rising = sorted(edges, key=lambda e: (max(weight[e[0]], weight[e[1]]), e))
    place = {e: k for k, e in enumerate(rising)}
    n = len(number)
    forest, sets = PathForest([-1] * n + list(range(len(rising)))), UnionFind(min)
    for e in sorted(edges, key=lambda e: (-min(weight[e[0]], weight[e[1]]), e)):
        k = place[e]
        u, v = number[e[0]], number[e[1]]
        last = None
        if sets.merge(u, v) is None:
            last = k if u == v else max(k, forest.largest(u, v))
            yield max(weight[x] for x in rising[last]), min(weight[x] for x in e)
            if last != k:
                for x in rising[last]:
                    forest.cut(n + last, number[x])
        if last != k:
            forest.link(n + k, u)
            forest.link(n + k, v)


def extended_cycles(graphs: GraphSet, weights: DataFrame) -> DataFrame:
    """graph_id, birth, death: the extended diagram's points of dimension 1 (graph_id, v, weight), one for each
    independent cycle. One graph is one group of a task."""
    rows = weights.select("graph_id", F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.col("weight").cast("double").alias("w")).union(
        graphs.edges.select("graph_id", "u", "v", F.lit(None).cast("double"))
    )
    schema = pa.schema([("graph_id", pa.int64()), ("birth", pa.float64()), ("death", pa.float64())])

    def solve(batches):
        def rows():
            for (g,), items in _by_graph(batches, ("graph_id",), ("u", "v", "w")):
                weight = {u: w for u, v, w in items if v is None}
                for point in cycle_pairs(weight, [(u, v) for u, v, _ in items if v is not None]):
                    yield g, *point

        yield from _tables(rows(), schema)

    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(solve, "graph_id long, birth double, death double")


def component_of(graphs: GraphSet) -> DataFrame:
    """graph_id, v, component (the largest vertex of the component)."""
    rows = graphs.edges.select("graph_id", "u", "v").union(graphs.vertices.select("graph_id", F.col("v").alias("u"), "v"))
    schema = pa.schema([("graph_id", pa.int64()), ("v", pa.int64()), ("component", pa.int64())])

    def solve(batches):
        def rows():
            for (g,), edges in _by_graph(batches, ("graph_id",), ("u", "v")):
                sets = UnionFind(max)
                for u, v in edges:
                    sets.merge(u, v)
                for v in sorted(sets.up):
                    yield g, v, sets.find(v)

        yield from _tables(rows(), schema)

    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(solve, "graph_id long, v long, component long")


def normalise(points: DataFrame) -> DataFrame:
    """Births and deaths scaled to the graph's finite range, as (x - min) / (max - min); 0 where that is empty."""
    span = points.select("graph_id", F.explode(F.array("birth", "death")).alias("x")).groupBy("graph_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias(c)
    keep = [c for c in points.columns if c not in ("birth", "death")]
    return points.join(span, "graph_id").select(*keep, scaled("birth"), scaled("death"))


def threshold(points: DataFrame, least: float = 0.0) -> DataFrame:
    """The points of persistence over ``least``, and those that never die."""
    return points.where(F.col("death").isNull() | (F.col("death") - F.col("birth") > least))


def rips_pairs(n: int, edges: list[tuple[float, int, int]]) -> Iterator[tuple[int, float, float | None]]:
    """(dimension, birth, death) up to dimension 1 of the flag complex of the sorted edges (weight, i, j),
    by cohomology over Z/2: the columns of edges, latest first, in terms of the triangles over them, earliest first.
    Classes without persistence are left out.

    A triangle is (its longest edge, the vertex opposite) and comes from the neighbours of an edge when asked
    for; none is kept but the pivots of reduced columns. Edges that kill a component have no column (clearing), and an
    edge that is the longest of its own earliest triangle pairs with it at once, with nothing to store.
    """
    value = [w for w, _, _ in edges]
    sets = UnionFind(min)
    for i in range(n):
        sets.find(i)
    cycles = []
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for k, (w, i, j) in enumerate(edges):
        near[i][j] = near[j][i] = k
        if sets.merge(i, j) is None:
            cycles.append(k)
        elif w > 0:
            yield 0, 0.0, w
    for _ in sets.roots():
        yield 0, 0.0, None

    def over(k: int) -> Iterator[tuple[int, int]]:
        """The triangles over an edge."""
        _, i, j = edges[k]
        few, many = sorted((near[i], near[j]), key=len)
        for x in few:
            if x in many:
                a, b = near[i][x], near[j][x]
                yield (k, x) if k > a and k > b else (a, j) if a > b else (b, i)

    owners: dict[tuple[int, int], list[int]] = {}  # the edges whose columns sum up to the one with this pivot
    for k in reversed(cycles):
        first = min(over(k), default=None)
        if first is not None and first[0] == k:
            continue
        column, parts = [], {k}
        for t in over(k):
            heappush(column, t)
        while column:
            t = heappop(column)
            if column and column[0] == t:
                heappop(column)
                continue
            more = owners.get(t)
            if more is None and t == min(over(t[0])):
                more = [t[0]]
            if more is None:
                owners[t] = [*parts]
                if value[t[0]] > value[k]:
                    yield 1, value[k], value[t[0]]
                break
            heappush(column, t)
            for e in more:
                parts ^= {e}
                for other in over(e):
                    heappush(column, other)
        else:
            yield 1, value[k], None


def rips_diagram(graphs: GraphSet, weighted: DataFrame) -> DataFrame:
    """graph_id, dim, birth, death (null: never) of the Vietoris-Rips filtration by edge weight
    (graph_id, u, v, weight) up to dimension 1; pairs that are no edges never enter."""
    rows = weighted.select("graph_id", "u", "v", F.col("weight").cast("double").alias("w")).union(
        graphs.vertices.select("graph_id", F.col("v").alias("u"), "v", F.lit(None).cast("double"))
    )
    schema = pa.schema([("graph_id", pa.int64()), ("dim", pa.int32()), ("birth", pa.float64()), ("death", pa.float64())])

    def solve(batches):
        def rows():
            for (g,), items in _by_graph(batches, ("graph_id",), ("u", "v", "w")):
                number = {v: k for k, v in enumerate(sorted({x for u, v, _ in items for x in (u, v)}))}
                edges = sorted((w, *sorted((number[u], number[v]))) for u, v, w in items if w is not None and u != v)
                for point in rips_pairs(len(number), edges):
                    yield g, *point

        yield from _tables(rows(), schema)

    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(solve, "graph_id long, dim int, birth double, death double")


def bottleneck_distances(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """g1, g2, distance of the finite points (graph_id, birth, death) for each pair (g1, g2)."""
    diagrams = points.where("death is not null").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.array("birth", "death"))).alias("d"))
    empty = F.array().cast("array<array<double>>")
    both = pairs.join(diagrams.withColumnsRenamed({"graph_id": "g1", "d": "d1"}), "g1", "left").join(diagrams.withColumnsRenamed({"graph_id": "g2", "d": "d2"}), "g2", "left")
    both = both.select("g1", "g2", F.coalesce("d1", empty).alias("d1"), F.coalesce("d2", empty).alias("d2"))

    def solve(batches):
        for batch in batches:
            found = [bottleneck([*map(tuple, x)], [*map(tuple, y)]) for x, y in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), pa.array(found, pa.float64())], names=["g1", "g2", "distance"])

    # dealt out by number: the rows are small, their matchings are not
    dealt = both.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(solve, "g1 long, g2 long, distance double")
