"""Splits, rankings and metrics."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.tables import portable_hash


def positional_split(rows: DataFrame, order: str, train: int = 140, valid: int = 360) -> DataFrame:
    """``rows`` with ``part``: by the place ``order`` (from 0), train, then valid, then test."""
    at = F.col(order)
    return rows.withColumn("part", F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test"))


def head_split(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``part``: the first tenth by ``order`` (from 0) is test."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(F.broadcast(n)).withColumn("part", F.when(F.col(order) < F.expr("n_rows div 10"), "test").otherwise("train")).drop("n_rows")


def hash_split(rows: DataFrame, key: str, test_size: float, seed: int = 1) -> DataFrame:
    """``rows`` with ``part``, test for about ``test_size`` of the keys, whatever the partitioning."""
    return rows.withColumn("part", F.when(portable_hash(seed, F.col(key)) < test_size, "test").otherwise("train"))


def folds(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``rows`` with ``fold`` 0 to n - 1."""
    return rows.withColumn("fold", F.floor(portable_hash(seed, F.col(key)) * n).cast("int"))


def remap_classes(y: DataFrame) -> DataFrame:
    """``y`` (id, y) with classes from 0: -1 becomes 0 if there is one; else all go down by 1 if 0 is missing."""
    facts = y.agg(F.max((F.col("y") == -1).cast("int")).alias("minus"), F.max((F.col("y") == 0).cast("int")).alias("zero"))
    new = F.when(F.col("minus") == 1, F.when(F.col("y") == -1, 0).otherwise(F.col("y"))).when(F.col("zero") == 0, F.col("y") - 1).otherwise(F.col("y"))
    return y.join(F.broadcast(facts)).select("id", new.cast("long").alias("y"))


def padded_labels(labels: DataFrame, width: int) -> DataFrame:
    """id, classes: an id's classes (id, cls from 0) in ascending order, filled up to ``width`` with -1."""
    found = labels.groupBy("id").agg(F.sort_array(F.collect_set(F.col("cls").cast("long"))).alias("classes"))
    fill = F.array_repeat(F.lit(-1).cast("long"), F.greatest(F.lit(width) - F.size("classes"), F.lit(0)))
    return found.select("id", F.concat("classes", fill).alias("classes"))


def top_k(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """id, cls: as many of an id's highest scores (id, cls, score) as it has true classes (id, cls); ties go
    to the smaller class."""
    k = truth.groupBy("id").agg(F.countDistinct("cls").alias("k"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "cls"))
    return scores.withColumn("place", place).join(k, "id").where("place <= k").select("id", "cls")


def _outcomes(found: DataFrame, truth: DataFrame) -> DataFrame:
    both = found.distinct().withColumn("p", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["id", "cls"], "full")
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy("cls").agg(count(hit).alias("tp"), count(F.col("t").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"))


def f1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """macro, micro of the predicted (id, cls) rows against the true ones."""
    one = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    every = 2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    return _outcomes(found, truth).agg(F.avg(one).alias("macro"), every.alias("micro"))


def subset_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """accuracy: the share of ids whose predicted classes are just the true ones."""
    both = found.distinct().withColumn("p", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["id", "cls"], "full")
    same = both.groupBy("id").agg(F.min((F.col("p").isNotNull() & F.col("t").isNotNull()).cast("int")).alias("same"))
    return same.agg(F.avg("same").alias("accuracy"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """accuracy of rows (label, prediction)."""
    return predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))


def one_vs_rest_probabilities(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """id, cls, score: a logistic regression for each class on rows (id, features, classes array<int>)."""
    found = None
    for k in range(classes):
        rows = train.withColumn("label", F.array_contains("classes", k).cast("double"))
        scored = LogisticRegression(maxIter=20).fit(rows).transform(test)
        from pyspark.ml.functions import vector_to_array

        x = scored.select("id", F.lit(k).alias("cls"), vector_to_array("probability")[1].alias("score"))
        found = x if found is None else found.union(x)
    return found


def classifier(name: str, features: int, classes: int, layers: tuple[int, ...] = (100, 50, 20)):
    """A Spark ML estimator over (features, label): ``svc``, ``logistic`` or ``dnn``."""
    if name == "svc":
        return OneVsRest(classifier=LinearSVC(maxIter=20))
    if name == "logistic":
        return LogisticRegression(maxIter=20)
    if name == "dnn":
        return MultilayerPerceptronClassifier(layers=[features, *layers, classes], seed=1, maxIter=50)
    raise ValueError(f"unknown classifier {name!r}")
