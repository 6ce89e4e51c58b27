"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialise

#: A key is frequent if it has more than one row in so many. So there are fewer frequent keys than this.
FREQUENT = 1000


def join_by_frequency(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key and, in ``n``, how many of the
    ``total`` rows it has.

    Frequent keys, fewer than ``FREQUENT`` of them, are broadcast, so their rows stay where they are; the
    rest meets in a shuffle, where no key has more than one row in ``FREQUENT``. Keys must not be null.
    """
    often = F.broadcast(materialise(keyed.where(F.col(n) * FREQUENT > total)))
    rest = rows.join(often.select(*keys), list(keys), "left_anti").join(keyed.where(F.col(n) * FREQUENT <= total), list(keys))
    return rows.join(often, list(keys)).unionByName(rest)


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``group`` up to this one, by ``order``.

    Rows are sorted by range over the whole table and summed within each range, so a group may hold any
    share of the rows. A range can continue only one group from the ranges before it: the sums carried on,
    at most one row for each range, are broadcast. Rows equal in ``group`` and ``order`` lie in one range and
    are summed in any order. Groups must not be null.
    """
    placed = materialise(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    carried = carried.select("_range", *group, F.sum("_sum").over(earlier).alias("_carried")).where("_carried is not null")
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(name, F.sum(value).over(within)).join(F.broadcast(carried), ["_range", *group], "left")
    return summed.withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_range", "_carried")
