"""Helpers over DataFrames that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: The tables that open ``scratch`` blocks will delete, innermost last.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a new local folder will do for a local master, as in tests; on a cluster that raises,
    as executors would not see each other's files.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


#: Spark then deletes an action's shuffle files when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, once: bool = False) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a reread and no recomputation, and compresses better
    than checkpoint(), whose files hold serialised rows. ``once`` says that ``df`` itself is used no more:
    its shuffle files go as soon as it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if once:
        conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if once:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    for paths in _written[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``materialise`` writes within: write or collect a result inside.

        with scratch(spark):
            one_of_each(docs).write.parquet(path)
    """
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete(spark, path)


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0 without gaps in the order of ``order``, which must tell all rows apart.

    The rows are sorted by range, numbered within each range and shifted by the counts of the ranges
    before, so no task holds more than its range. The counts, one for each range, are broadcast.
    """
    placed = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(shift), "_range")
        .withColumn(name, F.col("_shift") + F.col("_place"))
        .drop("_range", "_place", "_shift")
    )


def portable_hash(*parts: Column | int) -> Column:
    """A number in [0, 1) from integers, by multiplications that cannot overflow 64 bits; SQL engines that
    agree on integer arithmetic agree on it."""
    h = F.lit(17).cast("long")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        h = (h * F.lit(48271) + F.pmod(p.cast("long"), F.lit(2147483647)) * F.lit(69621) + F.lit(11)) % F.lit(2147483647)
    h = (h * F.lit(16807)) % F.lit(2147483647)
    return h / F.lit(2147483647.0)


def portable_hash_sql(*parts: str | int) -> str:
    """The same in SQL text."""
    h = "CAST(17 AS BIGINT)"
    for p in parts:
        h = f"(({h} * 48271 + (CAST({p} AS BIGINT) % 2147483647) * 69621 + 11) % 2147483647)"
    return f"((({h} * 16807) % 2147483647) / 2147483647.0::DOUBLE)"
