"""Graph convolution in long format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def symmetric(adj: DataFrame) -> DataFrame:
    """graph_id, i, j, a: the larger of both directions' non-negative entries."""
    return adj.union(adj.select("graph_id", "j", "i", "a")).groupBy("graph_id", "i", "j").agg(F.max("a").alias("a"))


def row_normalised(adj: DataFrame) -> DataFrame:
    """Entries over their row's sum; rows of sum 0 stay 0."""
    total = F.sum("a").over(Window.partitionBy("graph_id", "i"))
    return adj.select("graph_id", "i", "j", F.coalesce(F.try_divide(F.col("a"), total), F.lit(0.0)).alias("a"))


def with_self_loops(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """A + I over vertices(graph_id, v)."""
    eye = vertices.select("graph_id", F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("a"))
    return adj.union(eye).groupBy("graph_id", "i", "j").agg(F.sum("a").alias("a"))


def normalised_adjacency(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows of the symmetrised matrix plus identity, each of sum 1."""
    return row_normalised(with_self_loops(symmetric(adj), vertices))


def convolution(x: DataFrame, adj: DataFrame, weight: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """graph_id, v, f, value of A (X W) + b: ``x`` (graph_id, v, f, value), ``weight`` (f, h, w), ``bias``
    (h, b). Weights and bias are parameters of fixed size and are broadcast."""
    xw = x.join(F.broadcast(weight), "f").groupBy("graph_id", F.col("v").alias("j"), "h").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    out = adj.join(xw, ["graph_id", "j"]).groupBy("graph_id", F.col("i").alias("v"), "h").agg(F.sum(F.col("a") * F.col("z")).alias("value"))
    if bias is not None:
        out = out.join(F.broadcast(bias), "h").withColumn("value", F.col("value") + F.col("b"))
    return out.select("graph_id", "v", F.col("h").alias("f"), "value")


def relu(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.greatest("value", F.lit(0.0)))


def log_softmax(x: DataFrame) -> DataFrame:
    """value - max - ln(sum(exp(value - max))) of each vertex."""
    row = Window.partitionBy("graph_id", "v")
    shifted = x.withColumn("value", F.col("value") - F.max("value").over(row))
    return shifted.withColumn("value", F.col("value") - F.log(F.sum(F.exp("value")).over(row)))


def forward(x: DataFrame, adj: DataFrame, layers: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """Log-probabilities after the layers (weight, bias), with ReLU between them."""
    for k, (weight, bias) in enumerate(layers):
        x = convolution(relu(x) if k else x, adj, weight, bias)
    return log_softmax(x)


def predict(scores: DataFrame) -> DataFrame:
    """graph_id, v, f: the class of highest score, the lowest on ties."""
    return scores.groupBy("graph_id", "v").agg(F.max_by("f", F.struct("value", -F.col("f"))).alias("f"))


def loss(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """loss: the mean of minus the log-probability (graph_id, v, f, value) of the true class over the vertices
    of a batch (graph_id, v, f)."""
    return truth.join(scores, ["graph_id", "v", "f"]).agg((-F.avg("value")).alias("loss"))
