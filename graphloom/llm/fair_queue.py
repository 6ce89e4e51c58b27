"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow with a weight. Its documents wait in a shuffled order, one pass after the other; a
document's virtual finish time is the number of its source's words up to its end, over the source's target.
Served by finish time until the budget is spent, each source has then had its target, to within a document.
All sources share the budget by weight; none gets more than ``passes`` times what it has, and what it can't
take goes to the others by weight.

Everything is DataFrame operations. Running sums go by ranges, so a source may hold any share of the rows;
the driver sees single rows only: totals, the water level of each round and the place where the budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tables import dense_ids
from graphloom.llm.common import materialise, table, whole_text
from graphloom.llm.spread import join_by_frequency, running_sums

#: How the sources weigh, by code point, repeating.
WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """The number of words, between ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shuffled(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text: the order in which a source's documents wait."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(whole_text(text).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def fill(sources: DataFrame, budget: int, passes: int) -> DataFrame:
    """``sources`` (size, weight) with their ``target``: budget x weight / weights, at most ``passes`` x size.

    Each round shares what is left by weight among the sources that are not full, and fills those whose share
    is more than they can take; it ends when none is. The level only rises, so at most as many rounds as there
    are sources are needed, and commonly a few. A round brings one row to the driver.
    """
    level, most = -1.0, F.col("size") * passes
    while True:
        open_ = F.col("weight") * F.lit(level) <= most
        spent, weights = sources.agg(F.sum(F.when(~open_, most).otherwise(0)), F.sum(F.when(open_, F.col("weight")).otherwise(0))).first()
        if not weights or (budget - spent) / weights <= level:
            return sources.withColumn("target", F.when(open_, F.col("weight") * F.lit(level)).otherwise(most.cast("double")))
        level = (budget - spent) / weights


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words) of each row of ``docs``: as many words in all
    as the documents have, each source's near its target, each document at most ``passes`` times.

    Sources weigh ``weights`` in turn, by code point of their names, null last, the empty name apart from null.
    A document is taken whole; the mix ends before the first that would exceed the budget. Between finish times
    that are equal the source that is earlier by name comes first. Null and empty texts have size 0 and nothing
    is taken of them; a source of such alone has target 0. Null doc_ids and repeated rows are rows like others.
    Texts count whole, however long; columns beside doc_id, text and source are ignored; an empty table gives
    no rows. The result depends on the rows alone, not on how they are spread.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))  # "t", for null, is after any "s..."
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), size_of(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text")).alias("place")))
    sources = materialise(dense_ids(rows.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), ["name"], "number"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    budget, total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    sources = materialise(fill(sources.withColumn("weight", weight), budget, passes))
    known = sources.select("name", "number", F.col("size").alias("source_size"), "target", "rows")
    waiting = join_by_frequency(rows, known, ["name"], "rows", total).drop("rows")
    waiting = materialise(running_sums(waiting, ["number"], ["place", "doc_id", "size"], "size", "words"))
    ends = F.col("words") + F.col("source_size") * F.col("pass")
    each = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    queue = waiting.where("size > 0").select("number", "size", "words", "source_size", "target", each)
    queue = queue.select(F.lit(0).alias("all"), F.try_divide(ends, F.col("target")).alias("finish"), "number", ends.alias("ends"), "size")
    served = running_sums(queue, ["all"], ["finish", "number", "ends"], "size", "served").where(F.col("served") <= budget)
    last = served.agg(F.max(F.struct("finish", "number", "ends")).alias("last")).first()["last"]
    place = lambda k: F.struct(F.try_divide(F.col("words") + F.col("source_size") * k, F.col("target")).alias("finish"), "number", (F.col("words") + F.col("source_size") * k).alias("ends"))
    end = F.struct(*[F.lit(x).cast(kind).alias(c) for x, kind, c in zip(last or (-1, 0, 0), ("double", "long", "long"), ("finish", "number", "ends"))])
    times = sum(((place(k) <= end).cast("long") for k in range(passes)), F.lit(0))
    return waiting.select("doc_id", F.when(F.col("name") != "t", F.substring("name", 2, 1 << 30)).alias("source"), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).alias("taken"))


def op12_fair_queue(spark, sf_dir: str) -> DataFrame:
    """All documents mixed 5 : 2 : 1, at most three times each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
