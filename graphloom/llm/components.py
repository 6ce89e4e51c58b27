"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each end of the links (a, b).

    Each round a node takes the smallest component among its own and its neighbours' and then that
    component's own; rounds end when nothing changes. Links inside one component are dropped on the way.
    Only the number of changes reaches the driver.
    """
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    edges = links
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        near = both.join(at.withColumnsRenamed({"node": "to", "component": "c"}), "to").groupBy("node").agg(F.min("c").alias("c"))
        stepped = at.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("c", "component")).alias("next"))
        stepped = materialise(stepped)
        up = stepped.select(F.col("node").alias("next"), F.col("next").alias("root"))
        new = materialise(stepped.join(up, "next").select("node", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("changed")))
        if not new.where("changed").limit(1).count():
            return new.select("node", "component")
        at = new.select("node", "component")
        ends = [at.withColumnsRenamed({"node": k, "component": f"c{k}"}) for k in ("a", "b")]
        edges = materialise(edges.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
