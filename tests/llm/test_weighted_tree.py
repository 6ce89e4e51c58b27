import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm.weighted_tree import Shard, assign_shards, op3_weighted_hash_tree, regular_topology, with_new_shard

SMALL = "/root/testdata/sf0.01"


def draw(key, name, weight):
    bits = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight


def descend(key, topology):
    """The definition, by walking down with summed weights."""
    path, under = "", topology
    for level in (0, 1, 2):
        kids = defaultdict(list)
        for s in under:
            kids[f"{path}/{s[level]}"].append(s)
        path = min(kids, key=lambda k: (draw(key, k, sum(s.weight for s in kids[k])), k))
        under = kids[path]
    return under[0].shard


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op3_weighted_hash_tree(spark, SMALL).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    slots = defaultdict(list)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == descend(str(r.doc_id), regular_topology())
        assert r.grown_shard in (r.shard, 16)
        assert r.grown_shard == descend(str(r.doc_id), with_new_shard(regular_topology()))
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20 < sum(r.grown_shard == 16 for r in found) < 110


def test_movement_stays_in_changed_subtrees(spark):
    old = [Shard("a", "x", 0), Shard("a", "x", 1), Shard("a", "y", 2, 2.0), Shard("b", "z", 3), Shard("b", "z", 4, 3.0)]
    new = [s._replace(weight=5.0) if s.shard == 2 else s for s in old]
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    moved = Counter((r.shard, r.grown_shard) for r in assign_shards(docs, old, new).collect())
    for (x, y), _ in moved.items():
        if x != y:  # a's and y's weights rose: nothing leaves shard 2, nothing enters b
            assert x != 2 and y in (0, 1, 2)
            assert y == 2 or x in (3, 4)
    share = Counter()
    for (x, _), n in moved.items():
        share[x] += n / 4000
    assert all(abs(share[s.shard] - s.weight / 8) < 0.03 for s in old)
    with pytest.raises(ValueError):
        assign_shards(docs, [Shard("a", "b", 0, 0.0)])


def test_edge_cases(spark):
    rows = [(None, None, 1), (None, "", 1), (1, "é" * 100_000, 1), (2, None, 1), (3, "x", 1), (3, "x", 1), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    found = assign_shards(docs, slot_buckets=3).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted([("None", 1), ("None", 1), ("1", 200_001), ("2", 1), ("3", 2), ("3", 2), ("3", 2)])
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 3}) == 1
    assert assign_shards(docs.limit(0)).count() == 0
