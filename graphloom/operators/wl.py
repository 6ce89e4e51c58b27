"""Weisfeiler-Lehman relabelling, edge weights and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.tables import dense_ids, materialise
from graphloom.model import GraphSet


#: Distinct signatures up to which their numbers are broadcast; beyond, the join is a shuffle that Spark can split.
MOST_BROADCAST = 1_000_000


def _compress(rows: DataFrame, signature: str) -> DataFrame:
    """``rows`` with ``label``: the signature's number by first appearance over (graph_id, v), across all
    graphs.

    Signatures are grouped and joined by two 64-bit hashes, so that the key of a vertex of high degree is no
    longer than others'; two of 10**9 different signatures share both with a chance of about 10**-21. They
    are counted up in the map tasks, so only distinct ones are sorted.
    """
    keyed = materialise(rows.withColumns({"_h1": F.xxhash64(signature), "_h2": F.xxhash64(F.lit(1), signature)}))
    first = keyed.groupBy("_h1", "_h2").agg(F.min(F.struct("graph_id", "v")).alias("f"))
    first = materialise(first.select("_h1", "_h2", "f.graph_id", "f.v"))
    ids = dense_ids(first, ["graph_id", "v"], "label").select("_h1", "_h2", "label")
    ids = F.broadcast(ids) if first.count() <= MOST_BROADCAST else ids
    return keyed.join(ids, ["_h1", "_h2"]).drop("_h1", "_h2")


def initial_labels(graphs: GraphSet, known: DataFrame | None = None) -> DataFrame:
    """graph_id, v, label of iteration 0, from raw labels. ``known`` (raw_label, label) numbers some of them
    beforehand; the others' numbers follow the largest of those."""
    rows = graphs.vertices.select("graph_id", "v", "raw_label")
    if known is None:
        return _compress(rows, "raw_label").select("graph_id", "v", "label")
    known = F.broadcast(known.select("raw_label", F.col("label").alias("_known")))
    first = (known.agg(F.max("_known")).first()[0] + 1) if known.limit(1).count() else 0
    rows = materialise(rows.join(known, "raw_label", "left"))
    new = _compress(rows.where("_known is null").drop("_known"), "raw_label").select("graph_id", "v", (F.col("label") + first).alias("label"))
    return rows.where("_known is not null").select("graph_id", "v", F.col("_known").cast("long").alias("label")).union(new)


def refine(graphs: GraphSet, labels: DataFrame) -> DataFrame:
    """graph_id, v, merged, label of the next iteration: a vertex's label before its neighbours' sorted ones."""
    near = graphs.neighbours().join(labels.select("graph_id", F.col("v").alias("nbr"), F.col("label").alias("l")), ["graph_id", "nbr"])
    near = near.groupBy("graph_id", "v").agg(F.array_sort(F.collect_list("l")).alias("near"))
    merged = labels.join(near, ["graph_id", "v"], "left").select(
        "graph_id", "v", F.concat(F.array("label"), F.coalesce("near", F.array().cast("array<bigint>"))).alias("merged")
    )
    return _compress(merged, "merged").select("graph_id", "v", "merged", "label")


def history(graphs: GraphSet, iterations: int = 2) -> list[DataFrame]:
    """The labels (graph_id, v, label) of iterations 0 to ``iterations``, each written once."""
    graphs = graphs.written() if iterations else graphs
    found = [materialise(initial_labels(graphs))]
    for _ in range(iterations):
        found.append(materialise(refine(graphs, found[-1]).select("graph_id", "v", "label")))
    return found


def histogram(labels: list[DataFrame]) -> DataFrame:
    """it, graph_id, label, n: how many vertices have each label in each iteration."""
    found = None
    for it, x in enumerate(labels):
        n = x.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(it).alias("it"), "graph_id", "label", "n")
        found = n if found is None else found.union(n)
    return found


def label_counts(labels: list[DataFrame]) -> DataFrame:
    """it, n_labels: the width of each iteration's feature block."""
    return histogram(labels).groupBy("it").agg(F.countDistinct("label").alias("n_labels"))


def edge_weights(graphs: GraphSet, labels: DataFrame, near: DataFrame | None, tau: float = 1.0, p: float = 2.0) -> DataFrame:
    """graph_id, u, v, e_ord, weight: the p-norm of the difference of the ends' neighbour label counts,
    plus 1 where the ends' labels differ, plus tau.

    ``near`` has the labels that neighbours are counted by; without it (iteration 0) the norm is 0.
    """
    side = lambda c: labels.select("graph_id", F.col("v").alias(c), F.col("label").alias(f"l_{c}"))
    edges = graphs.edges.select("graph_id", "u", "v", "e_ord").join(side("u"), ["graph_id", "u"]).join(side("v"), ["graph_id", "v"])
    differ = (F.col("l_u") != F.col("l_v")).cast("int") + F.lit(float(tau))
    if near is None:
        return edges.select("graph_id", "u", "v", "e_ord", differ.alias("weight"))
    of = near.select("graph_id", F.col("v").alias("nbr"), F.col("label").alias("l"))
    counts = graphs.neighbours().join(of, ["graph_id", "nbr"]).groupBy("graph_id", "v", "l").agg(F.count(F.lit(1)).alias("c"))
    keys = ["graph_id", "e_ord"]
    ends = [
        edges.select(*keys, F.col(end).alias("v")).join(counts, ["graph_id", "v"]).select(*keys, "l", (sign * F.col("c")).alias("c"))
        for end, sign in (("u", 1), ("v", -1))
    ]
    gap = ends[0].union(ends[1]).groupBy(*keys, "l").agg(F.sum("c").alias("d")).groupBy(*keys)
    power = F.col("d") * F.col("d") if p == 2 else F.pow(F.abs("d"), F.lit(p))
    norm = F.pow(F.sum(power).cast("double"), F.lit(1 / p))
    return edges.join(gap.agg(norm.alias("norm")), keys).select("graph_id", "u", "v", "e_ord", (F.col("norm") + differ).alias("weight"))


def weight_history(graphs: GraphSet, labels: list[DataFrame], tau: float = 1.0, p: float = 2.0, smooth: bool = False) -> DataFrame:
    """it, graph_id, u, v, e_ord, weight of all iterations; an iteration counts neighbours by the labels
    before it. ``smooth``: the running sums over the iterations."""
    found = edge_weights(graphs, labels[0], None, tau, p).withColumn("it", F.lit(0))
    for it in range(1, len(labels)):
        found = found.union(edge_weights(graphs, labels[it - 1], labels[it - 1], tau, p).withColumn("it", F.lit(it)))
    if smooth:
        so_far = Window.partitionBy("graph_id", "e_ord").orderBy("it").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("weight", F.sum("weight").over(so_far))
    return found.select("it", "graph_id", "u", "v", "e_ord", "weight")
