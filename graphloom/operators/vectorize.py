"""Fixed-size vectors from persistence diagrams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_diagonal(points: DataFrame, nu: float = 0.1) -> DataFrame:
    """Finite points turned by 45 degrees: x along the diagonal, y the persistence over sqrt 2, where y up to
    ``nu`` is stretched to ln(y / nu) + nu. Points on the diagonal get a null y."""
    y = (F.col("death") - F.col("birth")) / math.sqrt(2)
    stretched = F.when(y > nu, y).when(y > 0, F.log(y / nu) + nu)
    keep = [c for c in points.columns if c not in ("birth", "death")]
    return points.where("death is not null").select(*keep, ((F.col("birth") + F.col("death")) / math.sqrt(2)).alias("x"), stretched.alias("y"))


def centres(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """e, cx, cy: ``n`` seeded random centres above the diagonal of the unit square."""
    rng, found = np.random.default_rng(seed), []
    while len(found) < n:
        x, y = rng.random(2)
        if x <= y:
            found.append((len(found), float(x), float(y)))
    return spark.createDataFrame(found, "e int, cx double, cy double")


def slayer(points: DataFrame, centres: DataFrame, sharpness: float = 3.0) -> DataFrame:
    """graph_id, e, value: for each centre the sum over a graph's finite points of exp(-sharpness x squared
    distance). The centres are a parameter of fixed number, joined to each point."""
    gap = sharpness * ((F.col("birth") - F.col("cx")) ** 2 + (F.col("death") - F.col("cy")) ** 2)
    every = points.where("death is not null").groupBy("graph_id", "birth", "death").agg(F.count(F.lit(1)).alias("m"))
    return every.join(F.broadcast(centres)).groupBy("graph_id", "e").agg(F.sum(F.col("m") * F.exp(-gap)).alias("value"))


def slayer_births(points: DataFrame, centres: DataFrame, sharpness: float = 3.0) -> DataFrame:
    """The same over the births of the points that never die, with one-dimensional centres (e, cx)."""
    every = points.where("death is null").groupBy("graph_id", "birth").agg(F.count(F.lit(1)).alias("m"))
    gap = sharpness * (F.col("birth") - F.col("cx")) ** 2
    return every.join(F.broadcast(centres)).groupBy("graph_id", "e").agg(F.sum(F.col("m") * F.exp(-gap)).alias("value"))


def persistence_image(points: DataFrame, high: float, cells: int = 20, sigma: float = 0.1) -> DataFrame:
    """graph_id, i, j, value: each finite point's persistence times a Gaussian around (birth, persistence), at
    the centres of cells x cells squares over [0, high] x [0, high]."""
    centre = lambda c: F.lit(high) * (F.col(c) + 0.5) / cells
    rows = points.where("death > birth").groupBy("graph_id", "birth", "death").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("j"))
    life = F.col("death") - F.col("birth")
    gap = (F.col("birth") - centre("i")) ** 2 + (life - centre("j")) ** 2
    return rows.groupBy("graph_id", "i", "j").agg(F.sum(F.col("m") * life * F.exp(-gap / (2 * sigma * sigma))).alias("value"))


def persistence_landscape(points: DataFrame, high: float, layers: int = 5, steps: int = 100) -> DataFrame:
    """graph_id, k, i, value: the k-th largest tent height at each of ``steps`` places over [0, high]; places
    where it is 0 are left out."""
    at = F.lit(high) * (F.col("i") + 0.5) / steps
    rows = points.where("death > birth").withColumn("p", F.monotonically_increasing_id())
    rows = rows.select("graph_id", "p", "birth", "death", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    rows = rows.withColumn("value", F.least(at - F.col("birth"), F.col("death") - at)).where("value > 0")
    top = Window.partitionBy("graph_id", "i").orderBy(F.desc("value"), "p")
    return rows.withColumn("k", F.row_number().over(top)).where(F.col("k") <= layers).select("graph_id", "k", "i", "value")


def deep_set(points: DataFrame, weight: list[list[float]], bias: list[float]) -> DataFrame:
    """graph_id, h, value: the sum over a graph's finite points of W (birth, death) + b."""
    sums = points.where("death is not null").groupBy("graph_id").agg(F.sum("birth").alias("sb"), F.sum("death").alias("sd"), F.count(F.lit(1)).alias("n"))
    out = F.array(*[F.struct(F.lit(h).alias("h"), (a * F.col("sb") + b * F.col("sd") + c * F.col("n")).alias("value")) for h, ((a, b), c) in enumerate(zip(weight, bias))])
    return sums.select("graph_id", F.explode(out).alias("x")).select("graph_id", "x.h", "x.value")


def project(pooled: DataFrame, weight: list[list[float]], bias: list[float]) -> DataFrame:
    """graph_id, cls, score: the pooled values (graph_id, h, value) times ``weight`` [h][cls], plus ``bias``."""
    out = F.array(*[F.struct(F.lit(c).alias("cls"), (F.col("value") * F.element_at(F.array(*[F.lit(float(r[c])) for r in weight]), F.col("h") + 1)).alias("x")) for c in range(len(bias))])
    each = pooled.select("graph_id", F.explode(out).alias("o")).groupBy("graph_id", "o.cls").agg(F.sum("o.x").alias("score"))
    return each.select("graph_id", "cls", (F.col("score") + F.element_at(F.array(*[F.lit(float(b)) for b in bias]), F.col("cls") + 1)).alias("score"))


def diagram_groups(points: DataFrame) -> DataFrame:
    """The points (dim, birth, death) with ``part``: finite0, never0 or never1; others (finite of dimension 1) are left out."""
    part = F.when(F.col("death").isNull() & F.col("dim").isin(0, 1), F.concat(F.lit("never"), F.col("dim").cast("string")))
    return points.withColumn("part", part.when((F.col("dim") == 0) & F.col("death").isNotNull(), "finite0")).where("part is not null")
