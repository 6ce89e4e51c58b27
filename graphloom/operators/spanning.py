"""Spanning forests, components and H0 of graphs that no task could hold.

A least spanning forest comes from rounds: each component takes its cheapest outgoing edge, components joined
by these are contracted to one, and of the parallel edges left between two of them the cheapest stays. The
forest alone tells when components of the filtration by edge weight meet. To read its merge tree, the forest's
edges are cut in half by their order, again and again: the components of the lower half are the vertices of
the upper one, so both halves are problems of their own. Problems of few enough edges are solved each in a
task. Everything that grows with a graph is a join, a pre-aggregated grouping or a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tables import dense_ids, materialise
from graphloom.operators.persistence import kruskal


def _to_roots(parents: DataFrame) -> DataFrame:
    """part, node, root of trees (part, node, up), roots being their own parents: each round doubles the steps."""
    at = materialise(parents.withColumnRenamed("up", "root"))
    while True:
        ahead = at.select("part", F.col("node").alias("root"), F.col("root").alias("further"))
        moved = materialise(at.join(ahead, ["part", "root"]).select("part", "node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        at = moved.select("part", "node", "root")
        if not moved.where("moved").limit(1).count():
            return at


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of edges(part, u, v, weight, e_ord), in each part on its own: (part, e_ord) of the edges
    of the least spanning forest, ties going by e_ord, and the component (part, node, component) of each end,
    named by one of its nodes. e_ord must tell a part's edges apart; self-loops are left out.

    Each round at least halves the components that still have outgoing edges.
    """
    live = materialise(edges.where("u <> v").select("part", "u", "v", "weight", "e_ord"))
    forest = live.select("part", "e_ord").limit(0)
    labels = live.select("part", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = materialise(labels)
    while live.limit(1).count():
        ends = live.select("part", F.col("u").alias("node"), F.col("v").alias("up"), "weight", "e_ord").union(live.select("part", "v", "u", "weight", "e_ord"))
        best = ends.groupBy("part", "node").agg(F.min(F.struct("weight", "e_ord", "up")).alias("best"))
        best = materialise(best.select("part", "node", F.col("best.up").alias("up"), F.col("best.e_ord").alias("e_ord")))
        forest = forest.union(materialise(best.select("part", "e_ord").distinct()))
        # of two that chose the same edge the larger one is the root
        other = best.select("part", F.col("node").alias("up"), F.col("e_ord").alias("others"))
        top = (F.col("others") == F.col("e_ord")) & (F.col("node") > F.col("up"))
        roots = _to_roots(best.join(other, ["part", "up"]).select("part", "node", F.when(top, F.col("node")).otherwise(F.col("up")).alias("up")))
        to = lambda end: roots.select("part", F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        moved = live.join(to("u"), ["part", "u"]).join(to("v"), ["part", "v"]).where("u_root <> v_root")
        moved = moved.groupBy("part", F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        live = materialise(moved.agg(F.min(F.struct("weight", "e_ord")).alias("least")).select("part", "u", "v", "least.*"))
        labels = labels.join(to("component"), ["part", "component"], "left")
        labels = materialise(labels.select("part", "node", F.coalesce("component_root", "component").alias("component")))
    return forest, labels


def largest_of_components(edges: DataFrame) -> DataFrame:
    """part, node, top: the largest node of each end's component."""
    labels = boruvka(edges)[1]
    top = labels.groupBy("part", "component").agg(F.max("node").alias("top"))
    return labels.join(materialise(top), ["part", "component"]).select("part", "node", "top")


def merges(forest: DataFrame, task_edges: int = 1 << 20) -> DataFrame:
    """vertex, value of each of the forest edges (u, v, weight, e_ord): the vertex that dies where the edge joins
    two components, the smaller of both components' largest, and the edge's weight.

    Halving by the edges' order leaves problems of ``task_edges`` edges at most, solved in a task each.
    """
    rows = materialise(dense_ids(forest.select("u", "v", "weight", "e_ord"), ["weight", "e_ord"], "place"))
    size = 1
    while size < rows.count():
        size *= 2
    while size > task_edges:
        half = size // 2
        rows = rows.withColumns({"part": F.floor(F.col("place") / size), "upper": F.col("place") % size >= half})
        lower = rows.where("not upper")
        tops = materialise(largest_of_components(lower))
        to = lambda end: tops.select("part", F.col("node").alias(end), F.col("top").alias(f"{end}_top"))
        upper = rows.where("upper").join(to("u"), ["part", "u"], "left").join(to("v"), ["part", "v"], "left")
        upper = upper.select(F.coalesce("u_top", "u").alias("u"), F.coalesce("v_top", "v").alias("v"), "weight", "e_ord", "place")
        rows = materialise(lower.select(*upper.columns).union(upper))
        size = half
    problems = rows.select(F.lit(0).alias("it"), F.floor(F.col("place") / size).cast("long").alias("graph_id"), "u", "v", "e_ord", "weight")
    none = problems.select("it", "graph_id", F.col("u").alias("v")).limit(0)
    # a problem's vertices stand for the components before it, each by its largest
    gone = kruskal(none, problems).where("kind = 'point'")
    return gone.select(F.col("a").alias("vertex"), "value")


def large_h0(vertices: DataFrame, edges: DataFrame, order: str = "sublevel", task_edges: int = 1 << 20) -> DataFrame:
    """kind, a, b, e_ord, value of one graph's H0 filtration by edge weight, as ``kruskal`` gives them for
    collections of small graphs: vertices(v), edges(u, v, weight, e_ord).

    An edge without vertices of its own makes them. Isolated vertices are essential; without edges all die at
    0.0. Self-loops are cycles. ``e_ord`` breaks ties and must tell the edges apart.
    """
    if order not in ("sublevel", "superlevel"):
        raise ValueError(f"unknown order {order!r}")
    sign = 1 if order == "sublevel" else -1
    part, none = F.lit(0).cast("long").alias("part"), F.lit(None).cast("long")
    rows = materialise(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), (sign * F.col("weight").cast("double")).alias("weight"), F.col("e_ord").cast("long").alias("e_ord")))
    chosen, labels = boruvka(rows.withColumn("part", part))
    forest = materialise(rows.join(chosen.select("e_ord"), "e_ord", "left_semi"))
    points = merges(forest, task_edges).select(F.lit("point").alias("kind"), F.col("vertex").alias("a"), none.alias("b"), none.alias("e_ord"), (sign * F.col("value")).alias("value"))
    cycles = rows.join(forest.select("e_ord"), "e_ord", "left_anti").select(F.lit("cycle"), "u", "v", "e_ord", sign * F.col("weight"))
    tops = labels.groupBy("component").agg(F.max("node").alias("a")).select("a")
    known = vertices.select(F.col("v").cast("long").alias("a")).union(rows.select(F.explode(F.array("u", "v")))).distinct()
    alone = known.join(labels.select(F.col("node").alias("a")), "a", "left_anti")
    last = F.coalesce(F.lit((rows.agg(F.max("weight")).first() or [None])[0]), F.lit(0.0)).cast("double")
    essential = tops.union(alone).select(F.lit("essential"), "a", none, none, sign * last)
    return points.union(cycles).union(essential)
