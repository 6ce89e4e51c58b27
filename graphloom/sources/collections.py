"""Graph collections derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import GraphSet, build
from graphloom.operators import packed

#: Suppliers up to which their labels are broadcast; beyond, the join is a shuffle.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchase_graphs(spark: SparkSession, sf_dir: str) -> GraphSet:
    """One graph for each customer: suppliers joined when one order has both, labelled by nation modulo 5;
    the class is the market segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("graph_id"), F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("v"))
        .distinct()
    )
    nation = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("v"), (F.col("s_nationkey") % 5).cast("long").alias("raw_label")
    )
    vertices = items.select("graph_id", "v").distinct().join(nation, "v").select("graph_id", "v", "raw_label")
    other = items.select("graph_id", "o", F.col("v").alias("u"))
    pairs = items.join(other, ["graph_id", "o"]).where("u < v").select("graph_id", "u", "v").distinct()
    graphs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_mktsegment").alias("y"))
    return replace(build(pairs, vertices, graphs), packed=_packed(spark, sf_dir, orders, nation))


def _packed(spark: SparkSession, sf_dir: str, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """The same graphs in one row each: line items go to their customer's task, where its pairs are made."""
    few = table(spark, sf_dir, "supplier").count() <= MOST_BROADCAST
    nation = nation.withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("v"))
    rows = rows.join(F.broadcast(nation) if few else nation, "v", "left").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    known = F.coalesce("known", F.lit(False)).alias("known")
    return packed.from_groups(rows.select(F.col("o_custkey").alias("graph_id"), F.col("l_orderkey").alias("o"), "v", "raw_label", known))


CO_PURCHASE_SQL = """
li AS (SELECT DISTINCT o_custkey AS graph_id, l_orderkey AS o, l_suppkey AS v
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
vertices AS (SELECT DISTINCT graph_id, v, CAST(s_nationkey % 5 AS BIGINT) AS raw_label
             FROM li JOIN supplier ON v = s_suppkey),
pairs AS (SELECT DISTINCT a.graph_id, a.v AS u, b.v AS v
          FROM li a JOIN li b ON a.graph_id = b.graph_id AND a.o = b.o AND a.v < b.v),
edges AS (SELECT graph_id, u, v, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY u, v) AS e_ord FROM pairs),
adj AS (SELECT graph_id, u AS v, v AS nbr FROM edges UNION ALL SELECT graph_id, v, u FROM edges WHERE u <> v)
"""


def customer_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u (customer), v (minus supplier minus 1) and weight (line items): one bipartite graph."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("u"), (-F.col("l_suppkey") - 1).alias("v"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


CUSTOMER_SUPPLIER_SQL = """
gb AS (SELECT o_custkey AS u, -l_suppkey - 1 AS v, CAST(COUNT(*) AS DOUBLE) AS weight
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (user), u, v (event types) and weight (how often v follows u): directed, with self-loops."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("u"), F.lead("event_type").over(w).alias("v"))
    return (
        nxt.where("v is not null")
        .groupBy(F.col("user_id").alias("graph_id"), "u", "v")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


EVENT_TRANSITIONS_SQL = """
steps AS (SELECT user_id AS graph_id, event_type AS u,
                 LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events),
gt AS (SELECT graph_id, u, v, CAST(COUNT(*) AS DOUBLE) AS weight FROM steps WHERE v IS NOT NULL GROUP BY 1, 2, 3)
"""
