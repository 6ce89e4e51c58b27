"""Sharding by a hierarchical weighted hash tree.

A topology names regions, their racks and their shards, each shard with a weight. A key descends
from the root: at each level every child draws ``-ln(u) / weight`` with u hashed from the key and the
child's name, and the smallest draw wins. A child's draw depends on nothing but the key, its own name
and its own weight, so when a weight changes, keys move only into or out of the subtrees whose
weights changed. Everything is a column expression; no Python runs on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import table, whole_text


class Shard(NamedTuple):
    """A leaf of the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_topology(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Shard]:
    """Shards 0, 1, ... of equal weight, the same number in each rack."""
    return [
        Shard(f"region{a}", f"rack{b}", (a * racks + b) * shards + c)
        for a in range(regions)
        for b in range(racks)
        for c in range(shards)
    ]


def with_new_shard(topology: Sequence[Shard]) -> list[Shard]:
    """One more shard, numbered next, in a region of its own: only its own subtree's weight changes."""
    n = max(s.shard for s in topology) + 1
    return [*topology, Shard(f"region-of-{n}", "rack0", n)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential variate of rate ``weight`` hashed from key and name (52 bits of md5)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / weight


def children_of(topology: Sequence[Shard]) -> dict[str, dict[str, float]]:
    """Each inner node's path, with its children's paths and total weights."""
    below: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for s in topology:
        if s.weight <= 0:
            raise ValueError("weights must be positive")
        path = ""
        for step in (s.region, s.rack, str(s.shard)):
            below[path][f"{path}/{step}"] += s.weight
            path = f"{path}/{step}"
    return below


def _children(topology: Sequence[Shard]) -> Column:
    """The same as a map literal."""
    entries: list[Column] = []
    for parent, kids in children_of(topology).items():
        entries += [
            F.lit(parent),
            F.array(*[F.struct(F.lit(k).alias("path"), F.lit(float(w)).alias("weight")) for k, w in kids.items()]),
        ]
    return F.create_map(*entries)


def shard_of(key: Column, topology: Sequence[Shard]) -> Column:
    """The shard that ``key`` (a string column) descends to."""
    children, at = _children(topology), F.lit("")
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(children, at),
            lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path")),
        )
        at = F.array_min(draws)["path"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def assign_shards(
    docs: DataFrame,
    topology: Sequence[Shard] | None = None,
    grown: Sequence[Shard] | None = None,
    slot_buckets: int = 1024,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row of ``docs``.

    A slot is the row's place in its shard, from 0 without gaps. Rows are numbered within
    ``slot_buckets`` hash buckets (of id and text) of each shard and offset by the counts of the buckets before, so no
    task ever holds a whole shard; the broadcast offsets have shards x slot_buckets rows at most.

    Null text: size 1, crc32 of the empty text. Null doc_id: one key of its own, all such rows in one
    shard. Repeated rows share a shard and get slots of their own. Other columns are ignored; an empty
    table gives no rows.
    """
    topology = regular_topology() if topology is None else topology
    grown = with_new_shard(topology) if grown is None else grown
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = whole_text(F.col("text"))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        shard_of(key, topology).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
        (F.conv(F.substring(F.md5(F.concat_ws("|", key, crc).cast("binary")), 1, 8), 16, 10).cast("long") % slot_buckets).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op3_weighted_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by law ``key``, and where they go with a seventeenth."""
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
