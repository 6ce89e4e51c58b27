"""Collections with one row for each graph, and their kernels in numpy.

A packed row has a graph's vertices in order and its edges as pairs of places among them. Graphs are independent, so
whatever needs one graph at a time is a pass over these rows without a shuffle: a task takes some hundred thousand
vertices and edges of many graphs at once as flat arrays (``Graphs``). Only a graph has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.tables import dense_ids, materialise

#: One row for each graph: vertices v in order, their labels, whether they are vertices at all or only ends of edges,
#: and edges (a, b) as places in v, from 0, in the order of their ids.
SCHEMA = "graph_id long, v array<long>, raw_label array<long>, known array<boolean>, a array<int>, b array<int>"
_ARROW = pa.schema([("graph_id", pa.int64()), ("v", pa.list_(pa.int64())), ("raw_label", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

#: Vertices and edges that a kernel takes at once, unless one graph has more.
MOST = 300_000
#: Distinct signatures up to which their numbers are broadcast; beyond, the join is a shuffle.
MOST_BROADCAST = 1_000_000


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, numbered in the order of the columns, and the first row of each group."""
    n = len(columns[0])
    order = np.lexsort(columns[::-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            x = c[order]
            new[1:] |= x[1:] != x[:-1]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def lists(values: np.ndarray, counts: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    flat = pa.array(values, mask=mask)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), flat)


def joined(g: np.ndarray, o: np.ndarray, v: np.ndarray, raw: np.ndarray, none: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Packed rows of whole graphs from rows (graph, group, vertex, label): vertices of one group are joined."""
    number, first = groups(g, o, v)
    g, o, v, raw, none, known = (x[first] for x in (g, o, v, raw, none, known))
    at, seen = groups(g, v)
    team = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])))
    n, codes, i, d = len(g), [np.zeros(0, np.int64)], np.arange(len(g)), 0
    while len(i):
        d += 1
        i = i[i + d < n]
        i = i[team[i] == team[i + d]]
        codes.append(at[i] * len(seen) + at[i + d])
    codes = np.unique(np.concatenate(codes))
    vg = g[seen]
    starts = np.flatnonzero(np.append(True, vg[1:] != vg[:-1]))
    sizes = np.diff(np.append(starts, len(vg)))
    graph = np.repeat(np.arange(len(starts)), sizes)
    a, b = codes // len(seen), codes % len(seen)
    edges = np.bincount(graph[a], minlength=len(starts))
    place = np.arange(len(vg)) - np.repeat(starts, sizes)
    columns = [pa.array(vg[starts]), lists(v[seen], sizes), lists(raw[seen], sizes, none[seen]), lists(known[seen], sizes)]
    return pa.RecordBatch.from_arrays([*columns, lists(place[a].astype(np.int32), edges), lists(place[b].astype(np.int32), edges)], schema=_ARROW)


def from_groups(items: DataFrame) -> DataFrame:
    """Packed rows of the graphs of items(graph_id, o, v, raw_label, known): vertices are joined that share an o."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            raw = rows["raw_label"]
            g, o, v = (rows[c].to_numpy() for c in ("graph_id", "o", "v"))
            return joined(g, o, v, raw.fill_null(0).to_numpy(), raw.is_null().to_numpy(), rows["known"].to_numpy())

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MOST:
                rows = pa.Table.from_batches(held)
                g = rows["graph_id"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield made(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    n = len(g) - cut
        if n:
            yield made(pa.Table.from_batches(held))

    rows = items.where("graph_id is not null and v is not null").select("graph_id", "o", "v", "raw_label", "known")
    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(build, SCHEMA)


def vertices(packed: DataFrame) -> DataFrame:
    """graph_id, v, raw_label."""
    each = packed.select("graph_id", F.inline(F.arrays_zip("v", "raw_label", "known")))
    return each.where("known").select("graph_id", "v", "raw_label")


def edges(packed: DataFrame) -> DataFrame:
    """graph_id, u, v, e_ord."""
    end = lambda c: F.transform(c, lambda k: F.element_at("v", k + 1))
    each = packed.select("graph_id", end("a").alias("x"), end("b").alias("y"))
    each = each.select("graph_id", F.posexplode(F.arrays_zip("x", "y")).alias("k", "e"))
    return each.select("graph_id", F.col("e.x").alias("u"), F.col("e.y").alias("v"), (F.col("k") + 1).alias("e_ord"))


class Graphs:
    """Some graphs as flat arrays: vertices with graph, v, raw, none (no label) and known; edges (a, b) as places among
    the vertices of all of them, with eg (graph) and e_ord."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        size = lambda c: column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda c: column(c).flatten()
        self.ids = column("graph_id").to_numpy()
        self.n, self.m = size("v"), size("a")
        self.first = np.append(0, np.cumsum(self.n))
        self.edge_first = np.append(0, np.cumsum(self.m))
        self.graph = np.repeat(np.arange(len(self.ids)), self.n)
        self.eg = np.repeat(np.arange(len(self.ids)), self.m)
        self.v = flat("v").to_numpy()
        raw = flat("raw_label")
        self.none = raw.is_null().to_numpy(zero_copy_only=False)
        self.raw = raw.fill_null(0).to_numpy()
        self.known = flat("known").to_numpy(zero_copy_only=False)
        shift = np.repeat(self.first[:-1], self.m)
        self.a, self.b = flat("a").to_numpy() + shift, flat("b").to_numpy() + shift
        self.e_ord = np.arange(len(self.a)) - np.repeat(self.edge_first[:-1], self.m) + 1
        #: edges between vertices
        self.whole = self.known[self.a] & self.known[self.b]

    @property
    def id(self) -> np.ndarray:
        """The graph's id of each vertex."""
        return self.ids[self.graph]

    def arcs(self, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by source, sources, ends) of both directions of the edges, a loop once, sorted by source and end;
        ``whole``: only between vertices."""
        a, b = (self.a[self.whole], self.b[self.whole]) if whole else (self.a, self.b)
        other = a != b
        src, dst = np.append(a, b[other]), np.append(b, a[other])
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        return np.searchsorted(src, np.arange(len(self.v) + 1)), src, dst


def parts(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[Graphs]:
    """The rows as ``Graphs`` of about ``most`` vertices and edges."""
    for batch in batches:
        size = sum(batch.column(batch.schema.get_field_index(c)).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "a"))
        start = total = 0
        for k, x in enumerate(size):
            if total and total + x > most:
                yield Graphs(batch.slice(start, k - start))
                start, total = k, 0
            total += x
        if start < len(size):
            yield Graphs(batch.slice(start))


def each(packed: DataFrame, f: Callable[[Graphs], Iterator[list]], schema: str, most: int = MOST, held: int = 1_000_000) -> DataFrame:
    """Rows of ``schema`` from ``f``, which yields columns for some graphs."""
    spark = packed.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, most):
            for columns in f(part):
                table = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)
                for at in range(0, table.num_rows, held):
                    yield table.slice(at, held)

    return packed.mapInArrow(run, schema)


# Weisfeiler-Lehman


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    return _mix(_mix(x + np.uint64(seed)) ^ (y * np.uint64(0x9E3779B97F4A7C15)))


def signatures(p: Graphs, iterations: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two 64-bit hashes of each vertex's signature in iterations 0 to ``iterations``: of its label, then of its own
    signature and the multiset of its neighbours', as sums of hashes. Signatures are the same in all graphs."""
    raw, none = p.raw.astype(np.uint64), p.none.astype(np.uint64)
    found = [tuple(_pair(raw, none, s) for s in (1, 2))]
    first, _, dst = p.arcs()
    for _ in range(iterations):
        h1, h2 = found[-1]
        new = []
        for s, (x, y) in enumerate(((h1, h2), (h2, h1))):
            sums = np.append(np.uint64(0), np.cumsum(_pair(x, y, 3 + s)[dst], dtype=np.uint64))
            new.append(_pair(x, _mix(_pair(sums[first[1:]] - sums[first[:-1]], y, 5 + s)), 7 + s))
        found.append(tuple(new))
    return found


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[k] .. first[k] + size[k] - 1 of all k, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def weights(p: Graphs, label: tuple[np.ndarray, np.ndarray], near: bool, tau: float = 1.0, power: float = 2.0, chunk: int = 1_000_000) -> np.ndarray:
    """The weight of each edge between vertices: tau, plus 1 where the ends' labels differ, plus the norm of the difference of
    the ends' neighbour label counts if ``near``."""
    number, seen = groups(*label)
    a, b = p.a[p.whole], p.b[p.whole]
    differ = (number[a] != number[b]) + float(tau)
    if not near:
        return differ
    width = len(seen)
    _, src, dst = p.arcs()
    key, count = np.unique(src * width + number[dst], return_counts=True)
    count = count.astype(float)
    owner = key // max(1, width)
    whole = np.bincount(owner, count**power, len(p.v))
    first = np.searchsorted(owner, np.arange(len(p.v) + 1))
    size = np.diff(first)
    x, y = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    norm = whole[y]
    cuts = np.searchsorted(np.cumsum(size[x]), np.arange(chunk, size[x].sum() + chunk, chunk))
    for i, j in zip(np.append(0, cuts), np.append(cuts, len(x))):
        if i < j:
            at = _spans(first[x[i:j]], size[x[i:j]])
            edge = np.repeat(np.arange(j - i), size[x[i:j]])
            want = y[i:j][edge] * width + key[at] % width
            to = np.minimum(np.searchsorted(key, want), len(key) - 1)
            other = np.where(key[to] == want, count[to], 0.0)
            norm[i:j] += np.bincount(edge, np.abs(count[at] - other) ** power - other**power, j - i)
    return (np.sqrt(norm) if power == 2 else norm ** (1 / power)) + differ


def weight_history(p: Graphs, iterations: int, tau: float = 1.0, power: float = 2.0, smooth: bool = False) -> list[np.ndarray]:
    """The weights of iterations 0 to ``iterations``, each by the labels of the one before it; ``smooth``: running sums."""
    labels = signatures(p, max(0, iterations - 1))
    found = [weights(p, labels[max(0, it - 1)], it > 0, tau, power) for it in range(iterations + 1)]
    return list(np.cumsum(found, axis=0)) if smooth else found


# components in the order of a filtration


def merges(n: int, a: np.ndarray, b: np.ndarray, first: np.ndarray, few: int = 16, up: np.ndarray | None = None) -> np.ndarray:
    """For each edge the root that gives way, the smaller of two, or -1 where its ends are one component. The edges
    of graph k are first[k] .. first[k + 1] - 1, in order. The k-th edges of all graphs are taken together, until
    ``few`` graphs are left; those go on one by one. ``up``, 0 .. n - 1 at first, gets the way to each vertex's root."""
    up = np.arange(n) if up is None else up
    gone = np.full(len(a), -1, np.int64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, left = first[:-1][order], size[order]

    def root(x):
        while True:
            over = up[x]
            top = up[over]
            if np.array_equal(over, top):
                return over
            up[x] = top
            x = top

    k = 0
    active = int(np.count_nonzero(left > 0))
    falling = -left
    while active >= few:
        e = start[:active] + k
        x, y = root(a[e]), root(b[e])
        low, high = np.minimum(x, y), np.maximum(x, y)
        up[low] = high
        gone[e] = np.where(x == y, -1, low)
        k += 1
        active = int(np.searchsorted(falling, -k))
    for i in range(active):
        s, t = int(start[i]) + k, int(start[i] + left[i])
        if s < t:
            gone[s:t] = _one_by_one(up, a[s:t], b[s:t])
    return gone


def _one_by_one(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    ends = np.append(a, b)
    low = int(ends.min())
    high = int(max(ends.max(), up[ends].max()))
    over = up[low : high + 1]
    while not np.array_equal(over, up[over]):
        over = up[over]
    held, found = (over - low).tolist(), []
    # roots may lie beyond the ends that are left
    more = int(max(held, default=0)) + 1
    held += range(len(held), more)
    for x, y in zip((a - low).tolist(), (b - low).tolist()):
        while held[x] != x:
            held[x] = held[held[x]]
            x = held[x]
        while held[y] != y:
            held[y] = held[held[y]]
            y = held[y]
        if x == y:
            found.append(-1)
        else:
            x, y = (x, y) if x < y else (y, x)
            held[x] = y
            found.append(x + low)
    ways = np.array(held)
    moved = np.flatnonzero(ways != np.arange(len(ways)))
    up[low + moved] = low + ways[moved]
    return found


def kruskal(p: Graphs, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(death of each vertex, whether it is essential, whether each edge between vertices closes a cycle) by
    edge weight, ties by e_ord; the rules of ``persistence.kruskal``."""
    a, b, graph = p.a[p.whole], p.b[p.whole], p.eg[p.whole]
    order = np.lexsort((weight, graph))
    first = np.searchsorted(graph[order], np.arange(len(p.ids) + 1))
    gone = merges(len(p.v), a[order], b[order], first)
    sorted_ = weight[order]
    last = np.zeros(len(p.ids))
    some = first[1:] > first[:-1]
    last[some] = sorted_[first[1:][some] - 1]
    death, essential = last[p.graph], np.ones(len(p.v), bool)
    dies = gone >= 0
    death[gone[dies]] = sorted_[dies]
    essential[gone[dies]] = False
    cycle = np.empty(len(a), bool)
    cycle[order] = ~dies
    return death, essential, cycle


def edge_weights(packed: DataFrame, iterations: list[int], tau: float = 1.0, p: float = 2.0, smooth: bool = False) -> DataFrame:
    """it, graph_id, u, v, e_ord, weight of the iterations asked."""

    def f(x: Graphs):
        found = weight_history(x, max(iterations), tau, p, smooth)
        ids = x.ids[x.eg[x.whole]]
        for it in iterations:
            yield [np.full(len(ids), it), ids, x.v[x.a[x.whole]], x.v[x.b[x.whole]], x.e_ord[x.whole], found[it]]

    return each(packed, f, "it int, graph_id long, u long, v long, e_ord int, weight double")


def cycle_edges(packed: DataFrame, iterations: int = 2, tau: float = 1.0, p: float = 2.0, smooth: bool = False) -> DataFrame:
    """it, graph_id, u, v, e_ord, weight of the edges that close a cycle."""

    def f(x: Graphs):
        for it, w in enumerate(weight_history(x, iterations, tau, p, smooth)):
            at = kruskal(x, w)[2]
            e = np.flatnonzero(x.whole)[at]
            yield [np.full(len(e), it), x.ids[x.eg[e]], x.v[x.a[e]], x.v[x.b[e]], x.e_ord[e], w[at]]

    return each(packed, f, "it int, graph_id long, u long, v long, e_ord long, weight double")


def norms(packed: DataFrame, iterations: int = 2, tau: float = 1.0, p: float = 2.0, smooth: bool = False) -> DataFrame:
    """it, graph_id, total, infinity: the p-norm of the points' persistence and the largest persistence^p."""

    def f(x: Graphs):
        graph = x.graph[x.known]
        there = np.bincount(graph, minlength=len(x.ids)) > 0
        for it, w in enumerate(weight_history(x, iterations, tau, p, smooth)):
            value = np.abs(kruskal(x, w)[0][x.known]) ** p
            top = np.zeros(len(x.ids))
            np.maximum.at(top, graph, value)
            total = np.bincount(graph, value, len(x.ids)) ** (1 / p)
            yield [np.full(there.sum(), it), x.ids[there], total[there], top[there]]

    return each(packed, f, "it int, graph_id long, total double, infinity double")


def label_sums(packed: DataFrame, iterations: int = 2, tau: float = 1.0, p: float = 2.0, smooth: bool = False) -> DataFrame:
    """it, graph_id, label, n, points, cycles of each label in a graph: its vertices, the sum of persistence^p over the points
    that they create, and the sum of weight^p over the cycle edges at them (null without one)."""

    def f(x: Graphs):
        labels = signatures(x, iterations)
        for it, w in enumerate(weight_history(x, iterations, tau, p, smooth)):
            death, _, cycle = kruskal(x, w)
            number, seen = groups(x.graph, *labels[it])
            n = np.bincount(number[x.known], minlength=len(seen))
            points = np.bincount(number[x.known], np.abs(death[x.known]) ** p, len(seen))
            ends = np.append(number[x.a[x.whole][cycle]], number[x.b[x.whole][cycle]])
            value = np.abs(np.tile(w[cycle], 2)) ** p
            cycles, met = np.bincount(ends, value, len(seen)), np.bincount(ends, minlength=len(seen)) > 0
            some = n > 0
            h1, h2 = (h[seen][some].view(np.int64) for h in labels[it])
            yield [np.full(some.sum(), it), x.id[seen][some], h1, h2, n[some], points[some], pa.array(cycles[some], mask=~met[some])]

    sums = each(packed, f, "it int, graph_id long, h1 long, h2 long, n long, points double, cycles double")
    return numbered(packed, sums, iterations)


def numbered(packed: DataFrame, rows: DataFrame, iterations: int) -> DataFrame:
    """``rows`` (it, h1, h2, ...) with ``label`` for the hashes: the signature's number in its iteration by first
    appearance over (graph_id, v), across all graphs."""

    def f(x: Graphs):
        vertex = np.flatnonzero(x.known)
        for it, (h1, h2) in enumerate(signatures(x, iterations)):
            _, seen = groups(h1[vertex], h2[vertex], x.id[vertex], x.v[vertex])
            seen = vertex[seen]
            new = np.ones(len(seen), bool)
            new[1:] = (h1[seen][1:] != h1[seen][:-1]) | (h2[seen][1:] != h2[seen][:-1])
            seen = seen[new]
            yield [np.full(len(seen), it), h1[seen].view(np.int64), h2[seen].view(np.int64), x.id[seen], x.v[seen]]

    found = each(packed, f, "it int, h1 long, h2 long, graph_id long, v long")
    first = found.groupBy("it", "h1", "h2").agg(F.min(F.struct("graph_id", "v")).alias("f"))
    first = materialise(first.select("it", "h1", "h2", "f.graph_id", "f.v"), once=True)
    counts = dict(first.groupBy("it").count().collect())  # one for each iteration
    before, total = F.lit(0).cast("long"), 0
    for it in sorted(counts):
        before = F.when(F.col("it") == it, F.lit(total).cast("long")).otherwise(before)
        total += counts[it]
    ids = dense_ids(first, ["it", "graph_id", "v"], "label").select("it", "h1", "h2", (F.col("label") - before).alias("label"))
    ids = F.broadcast(ids) if total <= MOST_BROADCAST else ids
    return rows.join(ids, ["it", "h1", "h2"]).drop("h1", "h2")


def degree(p: Graphs) -> np.ndarray:
    """The number of edge ends at each vertex."""
    return np.bincount(p.a, minlength=len(p.v)) + np.bincount(p.b, minlength=len(p.v))


def label(p: Graphs) -> np.ndarray:
    """The label of each vertex as weight; 0 where it is null."""
    return p.raw.astype(float)


def _sublevel(p: Graphs, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vertices that die, the weights at which they do, the weights of edges that close cycles with their graphs last) of
    the filtration by vertex weight, by the rules of ``persistence.vertex_diagram``; and the way to the roots."""
    order = np.lexsort((-np.arange(len(p.v)), -weight, p.graph))
    place = np.empty(len(p.v), np.int64)
    place[order] = np.arange(len(p.v))
    a, b, graph = p.a[p.whole], p.b[p.whole], p.eg[p.whole]
    t = np.maximum(weight[a], weight[b])
    rising = np.lexsort((t, graph))
    graph, t, up = graph[rising], t[rising], np.arange(len(p.v))
    gone = merges(len(p.v), place[a[rising]], place[b[rising]], np.searchsorted(graph, np.arange(len(p.ids) + 1)), up=up)
    while not np.array_equal(up, up[up]):
        up = up[up]
    dies = gone >= 0
    return order[gone[dies]], t[dies], np.stack([t[~dies], graph[~dies]]), order[up[place]]


def vertex_diagram(packed: DataFrame, weight: Callable[[Graphs], np.ndarray]) -> DataFrame:
    """``persistence.vertex_diagram`` of packed rows and a weight of each vertex."""

    def f(p: Graphs):
        w = weight(p).astype(float)
        dead, death, (cycle, graph), _ = _sublevel(p, w)
        lives = p.known.copy()
        lives[dead] = False
        lives = np.flatnonzero(lives)
        none = lambda n: pa.nulls(n, pa.float64())
        yield [p.id[dead], np.zeros(len(dead)).astype(np.int32), w[dead], death, p.v[dead]]
        yield [p.id[lives], np.zeros(len(lives)).astype(np.int32), w[lives], none(len(lives)), p.v[lives]]
        yield [p.ids[graph.astype(np.int64)], np.ones(len(graph)).astype(np.int32), cycle, none(len(graph)), pa.nulls(len(graph), pa.int64())]

    return each(packed, f, "graph_id long, dim int, birth double, death double, creator long")


def extended_diagram(packed: DataFrame, weight: Callable[[Graphs], np.ndarray]) -> DataFrame:
    """``persistence.extended_diagram`` of packed rows and a weight of each vertex, in one pass."""

    def f(p: Graphs):
        w = weight(p).astype(float)
        kind = lambda name, n: pa.array(np.full(n, name))
        dead, death, _, root = _sublevel(p, w)
        yield [p.id[dead], kind("ordinary", len(dead)), w[dead], death]
        top = w.copy()
        np.maximum.at(top, root[p.known], w[p.known])
        roots = np.flatnonzero(p.known & (root == np.arange(len(p.v))))
        yield [p.id[roots], kind("extended", len(roots)), w[roots], top[roots]]
        dead, death, _, _ = _sublevel(p, -w)
        yield [p.id[dead], kind("relative", len(dead)), w[dead], -death]

    return each(packed, f, "graph_id long, kind string, birth double, death double")


def largest(packed: DataFrame, weight: Callable[[Graphs], np.ndarray]) -> DataFrame:
    """graph_id, weight: the largest weight of a vertex of each graph."""

    def f(p: Graphs):
        graph, w = p.graph[p.known], weight(p)[p.known].astype(float)
        order = np.lexsort((w, graph))
        last = np.flatnonzero(np.append(np.diff(graph), 1)) if len(graph) else np.zeros(0, np.int64)
        yield [p.ids[graph[last]], w[order][last]]

    return each(packed, f, "graph_id long, weight double")


# heat kernels


def _laplacians(p: Graphs, most: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vertices [graph, place], normalised Laplacians) of stacks of graphs of one size; of larger graphs one by one."""
    d = degree(p).astype(float)
    other = p.whole & (p.a != p.b)
    a, b, graph = p.a[other], p.b[other], p.eg[other]
    value = -1 / np.sqrt(d[a] * d[b])
    own = np.where(p.known & (d > 0), 1.0, 0.0)
    first = np.searchsorted(graph, np.arange(len(p.ids) + 1))
    order = np.argsort(p.n, kind="stable")
    at = 0
    while at < len(order):
        n = int(p.n[order[at]])
        end = int(np.searchsorted(p.n[order], n, "right"))
        end = min(end, at + max(1, 2_000_000 // max(1, n * n))) if n <= most else at + 1
        some = order[at:end]
        at = end
        if not n:
            continue
        m = np.zeros((len(some), n, n))
        e = _spans(first[some], first[some + 1] - first[some])
        k = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
        start = p.first[graph[e]]
        m[k, a[e] - start, b[e] - start] = m[k, b[e] - start, a[e] - start] = value[e]
        vertex = p.first[some][:, None] + np.arange(n)
        m[:, np.arange(n), np.arange(n)] = own[vertex]
        yield vertex, m


def _heat(packed: DataFrame, diagonal: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def f(p: Graphs):
        weight = np.zeros(len(p.v))
        for vertex, m in _laplacians(p):
            weight[vertex] = diagonal(m)
        yield [p.id[p.known], p.v[p.known], weight[p.known]]

    return each(packed, f, "graph_id long, v long, weight double")


def heat_kernel(packed: DataFrame, t: float = 0.1, order: int = 6) -> DataFrame:
    """``signatures.heat_kernel`` of packed rows; a graph's matrix is held in one task."""

    def diagonal(m):
        powers = [np.broadcast_to(np.eye(m.shape[1]), m.shape), m]
        while len(powers) <= (order + 1) // 2:
            powers.append(powers[-1] @ m)
        return sum(((-t) ** k / math.factorial(k)) * (powers[k // 2] * powers[k - k // 2]).sum(2) for k in range(order + 1))

    return _heat(packed, diagonal)


def heat_kernel_exact(packed: DataFrame, t: float = 0.1) -> DataFrame:
    """``signatures.heat_kernel_exact`` of packed rows."""

    def diagonal(m):
        values, vectors = np.linalg.eigh(m)
        return ((vectors * vectors) * np.exp(-t * values)[:, None, :]).sum(2)

    return _heat(packed, diagonal)


# counts of features


def shortest_path_features(packed: DataFrame) -> DataFrame:
    """``kernels.shortest_path_features`` of packed rows. 64 sources of a graph are searched from at once, as the bits of
    one number; a graph of more vertices takes several turns."""

    def f(p: Graphs):
        _, src, dst = p.arcs(whole=False)
        place = np.arange(len(p.v)) - p.first[p.graph]
        lab, _ = groups(p.none, p.raw)
        rows = []
        for turn in range(-(-int(p.n.max(initial=0)) // 64)):
            mine = p.n[p.graph] > 64 * turn
            keep = mine[src]
            s, d = src[keep], dst[keep]
            if not len(s):
                continue
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            owner = s[starts]
            source = p.known & (place // 64 == turn) & ~p.none
            bit = np.where(source, np.uint64(1) << (place % 64).astype(np.uint64), np.uint64(0))
            # the sources of each label in each graph
            number, seen = groups(p.graph[source], lab[source])
            masks = np.zeros(len(seen), np.uint64)
            np.bitwise_or.at(masks, number, bit[source])
            mg, ml = p.graph[source][seen], lab[source][seen]
            mfirst = np.searchsorted(mg, np.arange(len(p.ids) + 1))
            reached, front, length = bit.copy(), bit, 0
            while True:
                length += 1
                new = np.zeros(len(p.v), np.uint64)
                new[owner] = np.bitwise_or.reduceat(front[d], starts)
                new &= ~reached
                hit = np.flatnonzero(new)
                if not len(hit):
                    break
                reached |= new
                front = new
                hit = hit[p.known[hit] & ~p.none[hit]]
                many = mfirst[p.graph[hit] + 1] - mfirst[p.graph[hit]]
                v, m = np.repeat(hit, many), _spans(mfirst[p.graph[hit]], many)
                n = np.bitwise_count(new[v] & masks[m]).astype(np.int64)
                some = n > 0
                v, m, n = v[some], m[some], n[some]
                rows.append((p.graph[v], np.minimum(lab[v], ml[m]), np.maximum(lab[v], ml[m]), np.full(len(v), length), n))
        if rows:
            graph, low, high, length, n = (np.concatenate(x) for x in zip(*rows))
            number, seen = groups(graph, low, high, length)
            total = np.bincount(number, n, len(seen)).astype(np.int64) // 2  # each pair is met from both of its ends
            value = p.raw[np.unique(lab, return_index=True)[1]]
            low, high = value[low[seen]], value[high[seen]]
            names = pc.binary_join_element_wise(*[pa.array(x).cast(pa.string()) for x in (np.minimum(low, high), np.maximum(low, high), length[seen])], "-")
            yield [p.ids[graph[seen]], names, total]

    return each(packed, f, "graph_id long, feature string, n long")


def _triangles(p: Graphs, a: np.ndarray, b: np.ndarray, chunk: int = 2_000_000) -> np.ndarray:
    """The number of triangles of each graph with edges a < b, sorted."""
    found = np.zeros(len(p.ids), np.int64)
    key = a * len(p.v) + b
    first = np.searchsorted(a, np.arange(len(p.v) + 1))
    size = (first[1:] - first[:-1])[b]
    cuts = np.searchsorted(np.cumsum(size), np.arange(chunk, size.sum() + chunk, chunk))
    for i, j in zip(np.append(0, cuts), np.append(cuts, len(a))):
        if i < j:
            e = np.repeat(np.arange(i, j), size[i:j])
            want = a[e] * len(p.v) + b[_spans(first[b[i:j]], size[i:j])]
            to = np.minimum(np.searchsorted(key, want), len(key) - 1)
            found += np.bincount(p.graph[a[e[key[to] == want]]], minlength=len(p.ids))
    return found


#: Induced graphs of three vertices.
GRAPHLETS = ("empty", "edge", "path", "triangle")


def graphlets3(packed: DataFrame) -> DataFrame:
    """``kernels.graphlets3`` of packed rows."""

    def f(p: Graphs):
        other = p.a != p.b
        a, b = p.a[other], p.b[other]
        d = np.bincount(a, minlength=len(p.v)) + np.bincount(b, minlength=len(p.v))
        triangle = _triangles(p, a, b)
        sums = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(p.first[:-1], len(x)))
        n, wedges, m = (np.where(p.n > 0, sums(x.astype(np.int64)), 0) for x in (p.known, d * (d - 1) // 2, d))
        m //= 2
        path = wedges - 3 * triangle
        edge = m * (n - 2) - 2 * path - 3 * triangle
        every = n * (n - 1) * (n - 2) // 6
        some = n > 0
        yield [x[some] for x in (p.ids, every - edge - path - triangle, edge, path, triangle)]

    return each(packed, f, "graph_id long, empty long, edge long, path long, triangle long")


def sampled_graphlets(packed: DataFrame, samples: int = 500, seed: int = 1, most: int = 1024) -> DataFrame:
    """``kernels.sampled_graphlets`` of packed rows."""

    def f(p: Graphs):
        place = np.cumsum(p.known) - 1  # among the vertices of all graphs
        n = np.bincount(p.graph[p.known], minlength=len(p.ids)).astype(np.int64)
        start = np.append(0, np.cumsum(n))[:-1]
        a, b, graph = place[p.a[p.whole]], place[p.b[p.whole]], p.eg[p.whole]
        # a table of all pairs for each small graph; the others' edges are searched for
        small = n <= most
        square = np.where(small, n * n, 0)
        base = np.append(0, np.cumsum(square))
        there = np.zeros(base[-1] + 1, bool)
        inside = small[graph]
        g = graph[inside]
        there[base[g] + (a[inside] - start[g]) * n[g] + b[inside] - start[g]] = True
        key = np.sort(a[~inside] * len(p.v) + b[~inside])
        asked = np.flatnonzero(n > 2)
        size = max(1, 400_000 // samples)
        for at in range(0, len(asked), size):
            g = asked[at : at + size]
            h = hash_step(hash_start(seed), p.ids[g])[:, None]
            h = hash_step(h, np.arange(1, samples + 1))
            x = np.sort([np.floor(hash_end(hash_step(h, j)) * n[g][:, None]).astype(np.int64) for j in (1, 2, 3)], axis=0)
            edges_ = np.zeros(x.shape[1:], np.int64)
            for i, j in ((0, 1), (0, 2), (1, 2)):
                hit = there[np.where(small[g][:, None], base[g][:, None] + x[i] * n[g][:, None] + x[j], base[-1])]
                if len(key):
                    large = ~small[g]
                    want = (start[g][large][:, None] + x[i][large]) * len(p.v) + start[g][large][:, None] + x[j][large]
                    hit[large] = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
                edges_ += hit
            kind = np.where((x[0] < x[1]) & (x[1] < x[2]), edges_, 4)
            count = np.bincount((np.arange(len(g))[:, None] * 5 + kind).ravel(), minlength=5 * len(g)).reshape(-1, 5)[:, :4]
            i, j = np.nonzero(count)
            yield [p.ids[g[i]], pa.array(np.array(GRAPHLETS)[j]), count[i, j]]

    return each(packed, f, "graph_id long, feature string, n long")


def hash_start(seed: int) -> np.ndarray:
    """The state of ``tables.portable_hash`` after its first part."""
    return hash_step(np.array(17, np.int64), seed)


def hash_step(h: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    return (h * 48271 + (part % 2147483647) * 69621 + 11) % 2147483647


def hash_end(h: np.ndarray) -> np.ndarray:
    return (h * 16807) % 2147483647 / 2147483647.0


def wl_rows(packed: DataFrame, iterations: int = 5) -> DataFrame:
    """graph_id, f, x: ``kernels.feature_rows`` of the label histograms of all iterations. A feature is a 64-bit hash of
    iteration and signature; two of 10**8 different ones are equal with a chance of 3 in 10,000."""

    def f(p: Graphs):
        graph = p.graph[p.known]
        rows = []
        for it, h in enumerate(signatures(p, iterations)):
            key = _pair(h[0][p.known], h[1][p.known], 101 + it).view(np.int64)
            number, seen = groups(graph, key)
            rows.append((graph[seen], key[seen], np.bincount(number, minlength=len(seen)).astype(float)))
        graph, key, n = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((key, graph))
        graph, key, n = graph[order], key[order], n[order]
        n /= np.sqrt(np.bincount(graph, n * n, len(p.ids)))[graph]
        count = np.bincount(graph, minlength=len(p.ids))
        yield [p.ids[count > 0], lists(key, count[count > 0]), lists(n, count[count > 0])]

    return each(packed, f, "graph_id long, f array<long>, x array<double>", held=10_000)


def graphlet_features(packed: DataFrame) -> DataFrame:
    """graph_id, feature, n of the exact counts."""
    kinds = F.expr("stack(4, 'empty', empty, 'edge', edge, 'path', path, 'triangle', triangle) as (feature, n)")
    return graphlets3(packed).select("graph_id", kinds).where("n > 0")
