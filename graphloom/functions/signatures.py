"""Vertex weights of graph collections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tables import materialise, portable_hash
from graphloom.model import GraphSet


def degree(graphs: GraphSet) -> DataFrame:
    """graph_id, v, weight: the number of edge ends; a self-loop has two, an isolated vertex 0."""
    ends = graphs.edges.select("graph_id", F.explode(F.array("u", "v")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return graphs.vertices.join(ends, ["graph_id", "v"], "left").select("graph_id", "v", F.coalesce("n", F.lit(0)).cast("double").alias("weight"))


def label(graphs: GraphSet) -> DataFrame:
    """The raw label as weight; 0 where it is null."""
    return graphs.vertices.select("graph_id", "v", F.coalesce(F.col("raw_label").cast("double"), F.lit(0.0)).alias("weight"))


def random(graphs: GraphSet, seed: int = 1) -> DataFrame:
    """A number in [0, 1) hashed from seed, graph and vertex."""
    return graphs.vertices.select("graph_id", "v", portable_hash(seed, F.col("graph_id"), F.col("v")).alias("weight"))


def random_edges(graphs: GraphSet, seed: int = 1) -> DataFrame:
    """graph_id, u, v, e_ord and a weight in [0, 1) hashed from seed, graph and ends."""
    weight = portable_hash(seed, F.col("graph_id"), F.col("u"), F.col("v"))
    return graphs.edges.select("graph_id", "u", "v", "e_ord", weight.alias("weight"))


def heat_kernel(graphs: GraphSet, t: float = 0.1, order: int = 6) -> DataFrame:
    """The diagonal of exp(-t L), L the normalised Laplacian, by its series to ``order``.

    The rows of L^k for k up to order / 2 come by joins over the edges; as L is symmetric, the diagonal of
    L^(k + l) sums the products of L^k's and L^l's rows, so no pair of vertices further apart is made.
    """
    deg = degree(graphs).withColumnRenamed("weight", "d")
    nb = graphs.neighbours().where("v <> nbr")
    d = lambda c, n: deg.select("graph_id", F.col("v").alias(c), F.col("d").alias(n))
    norm = nb.join(d("v", "dv"), ["graph_id", "v"]).join(d("nbr", "dn"), ["graph_id", "nbr"])
    norm = materialise(norm.select("graph_id", F.col("v").alias("m"), F.col("nbr").alias("w"), (1 / F.sqrt(F.col("dv") * F.col("dn"))).alias("a")))
    power = graphs.vertices.select("graph_id", "v", F.col("v").alias("w"), F.lit(1.0).alias("x"))
    half, powers = (order + 1) // 2, power.withColumn("k", F.lit(0))
    for k in range(1, half + 1):
        stay = power.join(d("w", "dw"), ["graph_id", "w"]).select("graph_id", "v", "w", F.when(F.col("dw") > 0, F.col("x")).otherwise(0.0).alias("x"))
        moved = power.withColumnRenamed("w", "m").join(norm, ["graph_id", "m"]).select("graph_id", "v", "w", (-F.col("x") * F.col("a")).alias("x"))
        power = materialise(stay.union(moved).groupBy("graph_id", "v", "w").agg(F.sum("x").alias("x")))
        powers = powers.union(power.withColumn("k", F.lit(k)))
    at = lambda k: F.sum(F.when(F.col("k") == k, F.col("x")).otherwise(0.0)).alias(f"x{k}")
    each = powers.groupBy("graph_id", "v", "w").agg(*[at(k) for k in range(half + 1)])
    series = sum(((-t) ** m / math.factorial(m)) * F.col(f"x{m // 2}") * F.col(f"x{m - m // 2}") for m in range(order + 1))
    return each.groupBy("graph_id", "v").agg(F.sum(series).alias("weight"))


def heat_kernel_exact(graphs: GraphSet, t: float = 0.1) -> DataFrame:
    """The same by the eigenvectors of each graph's Laplacian; a graph's matrix is held in one task."""
    rows = graphs.edges.select("graph_id", "u", "v").union(graphs.vertices.select("graph_id", F.col("v"), F.col("v")))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["u", "v"]].to_numpy())
        i, j = np.searchsorted(ids, pdf["u"]), np.searchsorted(ids, pdf["v"])
        a = np.zeros((len(ids), len(ids)))
        a[i, j] = a[j, i] = 1
        np.fill_diagonal(a, 0)
        d = a.sum(1)
        s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
        values, vectors = np.linalg.eigh(np.diag((d > 0).astype(float)) - s[:, None] * a * s)
        return pd.DataFrame({"graph_id": key[0], "v": ids, "weight": (vectors**2 * np.exp(-t * values)).sum(1)})

    return rows.groupBy("graph_id").applyInPandas(solve, "graph_id long, v long, weight double")


SIGNATURES = {"vertex_degree": degree, "vertex_label": label, "random": random, "hks": heat_kernel}


def signature(graphs: GraphSet, name: str, **options) -> DataFrame:
    """The named signature; unknown names raise."""
    if name not in SIGNATURES:
        raise ValueError(f"unknown signature {name!r}")
    return SIGNATURES[name](graphs, **options)
