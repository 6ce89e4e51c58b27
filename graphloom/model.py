"""The data model: collections of labelled graphs as three DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.tables import materialise


@dataclass(frozen=True)
class GraphSet:
    """vertices(graph_id, v, raw_label), edges(graph_id, u, v, e_ord) with u <= v, and graphs(graph_id, y).

    Edges are simple: one row for each unordered pair. e_ord numbers a graph's edges from 1 by (u, v). ``packed`` has
    the same in one row for each graph (operators.packed), for collections that are made so.
    """

    vertices: DataFrame
    edges: DataFrame
    graphs: DataFrame
    kept: bool = False
    packed: DataFrame | None = None

    def written(self) -> GraphSet:
        """The same collection, vertices and edges written once: for jobs that read them often."""
        if self.kept:
            return self
        if self.packed is None:
            return GraphSet(materialise(self.vertices), materialise(self.edges), self.graphs, True)
        from graphloom.operators import packed

        rows = materialise(self.packed, once=True)
        return GraphSet(packed.vertices(rows), packed.edges(rows), self.graphs, True, rows)

    def neighbours(self) -> DataFrame:
        """graph_id, v, nbr: both directions of each edge, a self-loop once."""
        e = self.edges
        back = e.where("u <> v").select("graph_id", F.col("v").alias("v"), F.col("u").alias("nbr"))
        return e.select("graph_id", F.col("u").alias("v"), F.col("v").alias("nbr")).union(back)


def build(
    pairs: DataFrame, labels: DataFrame | None = None, graphs: DataFrame | None = None, edge_labels: DataFrame | None = None
) -> GraphSet:
    """A collection from pairs(graph_id, u, v).

    ``labels`` (graph_id, v, raw_label) names the vertices; without it they are the pairs' ends, with label
    0, so that isolated vertices cannot exist. Parallel and reversed pairs collapse. ``edge_labels``
    (graph_id, u, v, label) are attached in graphs where they are as many as the pairs, else they are null.
    """
    both = pairs.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = both.distinct()
    edges = edges.withColumn("e_ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v")))
    if edge_labels is not None:
        n = pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
        m = edge_labels.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
        whole = n.join(m, ["graph_id", "n"]).select("graph_id")
        named = edge_labels.join(whole, "graph_id", "left_semi")
        named = named.groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("label").alias("label"))
        edges = edges.join(named, ["graph_id", "u", "v"], "left")
    if labels is None:
        ends = edges.select("graph_id", F.col("u").alias("v")).union(edges.select("graph_id", "v")).distinct()
        labels = ends.withColumn("raw_label", F.lit(0).cast("long"))
    if graphs is None:
        graphs = labels.select("graph_id").distinct().withColumn("y", F.lit(None).cast("string"))
    return GraphSet(labels, edges, graphs)
