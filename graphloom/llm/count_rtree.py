"""Near-duplicate join by count vectors in R-trees.

A document's set holds the 64-bit hashes of its five-word shingles. Hashing the shingles into groups and
counting each group's makes the set a point; two sets share at most the sum of their coordinates' minima,
which bounds their similarity from above. A box of points bounds it for all sets inside.

Equal sets collapse to one node first. Nodes meet in the cells of their rarest shingles: linked sets share
one among their first floor(n / 4) + 1, whatever the order, and an order by rising frequency (from a table
of counters of fixed size) keeps common passages out of the cells. Of cells with the same members one is
enough. A cell's smallest node is its hub; each node is verified with the hub it shares most cells with.
That already joins most copies of one text into a component. Cells that still hold several components go
through R-trees over their points: first for each node's nearest point in another component, then, with
the components that those links make, for all pairs of different components that the bounds let pass.
Verification counts shared shingles on the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from graphloom.llm.common import ODD, byte_slices, hashed_words, materialise, mixed, table, whole_text
from graphloom.llm.components import components

SHINGLE, GROUPS, COUNTER_BITS = 5, 256, 17


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; of a shorter text's whole sequence.

    Equal shingles have equal hashes; two different ones clash with a chance of about 2**-60, so a count of
    the shared shingles of two sets of n is wrong with a chance of about n**2 / 2**60.
    """
    if not len(texts):
        return []
    _, _, _, h, first = hashed_words(texts)
    n = max(0, len(h) - SHINGLE + 1)
    rolled = np.full(n, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        rolled = rolled * ODD + h[j : j + n]
        rolled ^= rolled >> np.uint64(32)
    rolled = mixed(rolled)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(rolled[a : b - SHINGLE + 1])
            found.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            whole = np.full(min(b - a, 1), b - a, np.uint64)
            for x in h[a:b]:
                whole = whole * ODD + x
                whole ^= whole >> np.uint64(32)
            found.append(mixed(whole))
    return found


def shingle_set(text: str) -> np.ndarray:
    """That of one text."""
    return shingle_sets(pa.array([text], pa.string()))[0]


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many of the set's shingles fall into each group, by their highest bits."""
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def packed_point(s: np.ndarray, groups: int = GROUPS) -> bytes:
    """The count vector in one byte for each group, or in four where a count needs them; the first byte
    tells which."""
    n = count_vector(s, groups)
    wide = int(n.max() >= 256)
    return bytes([wide]) + n.astype("<u4" if wide else "u1").tobytes()


def fine_point(s: np.ndarray) -> bytes | None:
    """For a larger set a point of more groups, with two shingles or fewer in each on average: bounds over
    fuller groups let too much pass."""
    groups = 1 << min(16, len(s).bit_length() - 1)
    return packed_point(s, groups) if groups > GROUPS else None


def point_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[0] else "u1", offset=1).astype(np.int64)


def coarse(point: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The counts of fewer groups."""
    return point.reshape(groups, -1).sum(1)


def most_shared(p: np.ndarray, q: np.ndarray) -> int:
    """The bound on the shingles that two sets share, in the groups of the coarser point."""
    groups = min(len(p), len(q))
    return int(np.minimum(coarse(p, groups), coarse(q, groups)).sum())


def set_id(s: np.ndarray) -> int:
    """A 63-bit hash of the whole set."""
    return set_ids(s)[0]


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit hashes of the whole set."""
    both = xxhash.xxh3_128_intdigest(s.tobytes())
    return both >> 65, both & ((1 << 63) - 1)


def linked(shared, a, b):
    """The link rule on set sizes: 100 x intersection >= 75 x union."""
    return 100 * shared >= 75 * (a + b - shared)


class RTree:
    """Boxes over count vectors, packed bottom up from points in the order of size and then of the widest
    coordinates. Each level has the boxes' upper corners and smallest sizes."""

    def __init__(self, points: np.ndarray, fan: int = 16) -> None:
        size = points.sum(1)
        self.order = np.arange(len(points))
        if len(points) > fan:  # else one box holds them all
            wide = np.argsort(-points.var(0))[:2]
            slab = np.argsort(np.argsort(size, kind="stable"), kind="stable") // (fan * fan)
            self.order = np.lexsort((points[:, wide[1]], points[:, wide[0]], slab))
        self.points, self.size, self.fan = points[self.order], size[self.order], fan
        self.levels = []
        high, low = self.points, self.size
        while len(high) > 1:
            starts = range(0, len(high), fan)
            high, low = np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))

    def near(self, q: np.ndarray) -> np.ndarray:
        """Indices of all points that the bound lets link with ``q``."""
        n, at = int(q.sum()), np.zeros(1, np.int64)
        for k in reversed(range(len(self.levels))):
            high, low = self.levels[k]
            shared = np.minimum(np.minimum(high[at], q).sum(1), n)
            at = at[linked(shared, n, np.maximum(low[at], shared))]
            at = (self.fan * at[:, None] + np.arange(self.fan)).ravel()
            at = at[at < len(self.levels[k - 1][0] if k else self.points)]
        shared = np.minimum(self.points[at], q).sum(1)
        return self.order[at[linked(shared, n, self.size[at])]]


_DESCRIBED = "doc_id long, text_key long, n long, node long, other long, point binary, fine binary, counter int"


def _describe(batches):
    """Rows of the documents, and at the end of a task how many of its shingles fall on each counter."""
    names = [c.split()[0] for c in _DESCRIBED.split(", ")]
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in batches:
        for part in byte_slices(batch.column("text")):
            sets = shingle_sets(batch.column("text")[part])
            every = np.concatenate(sets)
            counters += np.bincount((every & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64), minlength=1 << COUNTER_BITS)
            ids = [set_ids(s) if len(s) else (None, None) for s in sets]
            columns = [
                batch.column("doc_id")[part],
                batch.column("text_key")[part],
                pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1)),
                pa.array([packed_point(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([fine_point(s) if len(s) else None for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    at = np.flatnonzero(counters)
    none = pa.nulls(len(at), pa.int64())
    columns = [none, none, pa.array(counters[at]), none, none, *[pa.nulls(len(at), pa.binary())] * 2, pa.array(at.astype(np.int32))]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def _cells(counters, renamed):
    """key, node: the first floor(n / 4) + 1 shingles of each set by rising frequency, then by hash."""

    def run(batches):
        freq, seen = counters.value.astype(np.int32), set()
        other = renamed.value
        for batch in batches:
            for part in byte_slices(batch.column("text")):
                keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for s in shingle_sets(batch.column("text")[part]):
                    node, again = set_ids(s)
                    node = again if node in other else node
                    if len(s) and node not in seen:  # equal sets of one task give their cells once
                        if len(seen) < 100_000:
                            seen.add(node)
                        order = np.argsort(freq[(s & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)], kind="stable")
                        keys.append(s[order[: len(s) // 4 + 1]].view(np.int64))
                        nodes.append(np.full(len(keys[-1]), node))
                columns = [pa.array(np.concatenate(x)) for x in (keys, nodes)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node"])

    return run


def _shared_cells(cells: DataFrame) -> DataFrame:
    """key, node, hub, weight: of the cells that hold several nodes, one for each set of members, how many
    there are of it, and its smallest node.

    Counts and sums come up from the map tasks, and joins by key have one row for each key on the other
    side, so a cell that very many nodes share is split. Sets of members are told apart by their smallest
    and largest node and three sums of node hashes, over 200 bits in all.
    """
    several = cells.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    members = materialise(cells.join(materialise(several), "key").select("key", "node", "hub", "top"))
    part = lambda x: F.sum(x.bitwiseAND(F.lit((1 << 28) - 1)))
    sums = members.groupBy("key", "hub", "top").agg(
        part(F.col("node")).alias("s1"), part(F.shiftright("node", 28)).alias("s2"), part(F.xxhash64("node")).alias("s3")
    )
    one = sums.groupBy("hub", "top", "s1", "s2", "s3").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    one = materialise(one.select("key", "weight"))
    return materialise(members.join(one, "key").select("key", "node", "hub", "weight").distinct())


@F.pandas_udf(BooleanType())
def _may_link(a: pd.Series, b: pd.Series) -> pd.Series:
    found = []
    for x, y in zip(a, b):
        p, q = point_of(x), point_of(y)
        found.append(bool(linked(most_shared(p, q), p.sum(), q.sum())))
    return pd.Series(found, dtype=bool)


def _check(batches):
    for batch in batches:
        memo: dict[int, np.ndarray] = {}
        held, keep = 0, []
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for i, ends in enumerate(zip(a, b)):
            for k, node in zip("ab", ends):
                if node not in memo:
                    if held > 1_000_000:  # shingles
                        memo, held = {n: memo[n] for n in ends if n in memo}, 0
                    memo[node] = shingle_sets(batch.column(f"text_{k}")[i : i + 1])[0]
                    held += len(memo[node])
            s, t = memo[ends[0]], memo[ends[1]]
            keep.append(bool(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) whose sets link: those that the finest points let pass, counted on the texts. One
    row's text stands for each node."""
    a, b = (nodes.select(F.col("node").alias(c), F.coalesce("fine", "point").alias(f"point_{c}")) for c in "ab")
    pairs = materialise(pairs.join(a, "a").join(b, "b").where(_may_link("point_a", "point_b")).select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialise(ends.join(nodes, "node").select("node", "doc_id", "text_key").withColumnsRenamed({"doc_id": "d", "text_key": "k"}))
    some = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted
    texts = rows.join(some, rows["doc_id"].eqNullSafe(some["d"]) & (rows["text_key"] == some["k"])).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts)
    a, b = (texts.withColumnsRenamed({"node": c, "text": f"text_{c}"}) for c in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(_check, "a long, b long")


def _tree_pairs(nearest: bool):
    """Pairs of different components in each unit: its points make an R-tree, which each of its askers goes
    through. ``nearest``: only the one of the highest bound for each asker, the others being left to the
    round after."""

    def pairs(members):
        asks, node, component, major, point = (list(x) for x in zip(*members))
        asks, node, component, major = np.array(asks), np.array(node), np.array(component), np.array(major)
        points = np.stack([point_of(p) for p in point])
        stands = np.flatnonzero(~asks)
        if not len(stands):
            return
        tree = RTree(points[stands])
        for i in np.flatnonzero(asks):
            near = stands[tree.near(points[i])]
            near = near[(component[near] != component[i]) & (major[near] | (node[near] > node[i]))]
            if nearest and len(near):
                shared = np.minimum(points[near], points[i]).sum(1)
                near = near[np.lexsort((node[near], -shared))[:1]]
            for j in near.tolist():
                yield min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))

    def out(found):
        found = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        unit, held, found = None, [], set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "asks", "node", "component", "major", "point"))):
                if row[:3] != unit:
                    if held:
                        found.update(pairs(held))
                    if len(found) > 200_000:
                        yield out(found)
                        found = set()
                    unit, held = row[:3], []
                held.append(row[3:])
        if held:
            found.update(pairs(held))
        yield out(found)

    return run


def _open_pairs(cells: DataFrame, nodes: DataFrame, of: DataFrame, tested: DataFrame, unit_size: int, nearest: bool) -> DataFrame:
    """Untested pairs (a < b) of different components from the cells that hold several.

    A cell's members outside its largest component ask. Askers are dealt into blocks of about
    ``unit_size``, and so are all members; a unit has one block of askers and one of members, so no task
    holds more, however large the cell.
    """
    placed = cells.select("key", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")
    )
    several = several.where("c1 < c2").join(tested.withColumn("done", F.lit(True)), ["a", "b"], "left")
    left = materialise(placed.join(several.where("n > 2 or done is null").select("key", "n"), "key"))
    most = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    most = most.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.max("n").alias("of"))
    blocks = lambda n: F.ceil(n / unit_size).cast("int")
    most = most.select(
        "key", F.col("most.component").alias("largest"), blocks(F.col("of")).alias("js"), blocks(F.col("of") - F.col("most.m")).alias("is")
    )
    left = left.drop("n").join(materialise(most), "key").withColumn("major", F.col("component") == F.col("largest"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ["key", "node", "component", "major"]
    points = left.select(*shown, every("is").alias("i"), block("js").alias("j"), F.lit(False).alias("asks"))
    askers = left.where("not major").select(*shown, block("is").alias("i"), every("js").alias("j"), F.lit(True).alias("asks"))
    units = points.union(askers).join(nodes.select("node", "point"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = units.mapInArrow(_tree_pairs(nearest), "a long, b long").distinct()
    return materialise(found.join(tested, ["a", "b"], "left_anti"))


def classes_of(docs: DataFrame, unit_size: int = 2000) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component (of those with a shingle) and least (the
    component's smallest doc_id) of each row of ``docs``."""
    spark = docs.sparkSession
    text = whole_text(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    every = materialise(rows.mapInArrow(_describe, _DESCRIBED))
    described = every.where("counter is null").drop("counter")
    counts = every.where("counter is not null").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    counters[counts["counter"].to_numpy()] = np.minimum(counts["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(counters)  # of fixed size

    # different sets of one 63-bit id, of which 30 billion sets have some tens, take the other id instead
    clashes = described.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high").select("node")
    renamed = {r["node"] for r in clashes.toLocalIterator()}
    if renamed:
        described = described.withColumn("node", F.when(F.col("node").isin(renamed), F.col("other")).otherwise(F.col("node")))
    clashing = spark.sparkContext.broadcast(renamed)
    points = (F.first(c).alias(c) for c in ("point", "fine"))
    nodes = described.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), *points)
    nodes = materialise(nodes.select("node", "row.doc_id", "row.text_key", "point", "fine"))

    cells = _shared_cells(materialise(rows.select("text").mapInArrow(_cells(shared, clashing), "key long, node long")))
    stars = cells.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("n"))
    tested = materialise(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
    links = materialise(_verify(tested, nodes, rows))
    of = components(links)
    for nearest in (True, False):
        pairs = _open_pairs(cells, nodes, of, tested, unit_size, nearest)
        if pairs.limit(1).count():
            links = links.union(materialise(_verify(pairs, nodes, rows)))
            tested = tested.union(pairs)
            of = components(links)

    grouped = described.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialise(grouped.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")))
    found = grouped.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component")
    return found.join(least, "component", "left")


def link_classes(docs: DataFrame, unit_size: int = 2000) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included) of
    each row of ``docs``.

    Null and wordless texts have no shingle, link with nothing and are their own component. Rows of null
    doc_id link like others; a component of such rows alone has a null id. Repeated rows are each returned.
    Very long texts are sets like others, whole. Of equally near points the smaller node is tried first,
    which changes no class. An empty table gives no rows. Other columns are ignored.
    """
    found = classes_of(docs, unit_size)
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller doc_id. All columns stay as they are.

    Rows of one doc_id and one component stay or go together. A row of null doc_id goes if its component
    has a row with an id, or, where all are null, one of another text with a smaller hash. Of rows of the same
    doc_id and text one stays, by a hash of all columns. Texts without a word stay.
    """
    of = materialise(classes_of(docs).where("n_shingles > 0"))
    nulls = of.where("least is null").groupBy("component").agg(F.min("text_key").alias("first"))
    later = of.join(nulls, "component", "left").where("doc_id <> least or (doc_id is null and (least is not null or text_key <> first))")
    keys = [F.col("doc_id").alias("key_doc"), F.col("text_key").alias("key_text")]
    later = later.select(*keys).distinct()
    text = F.xxhash64(whole_text(docs["text"]))
    same = lambda of: docs["doc_id"].cast("long").eqNullSafe(of["key_doc"]) & (text == of["key_text"])
    left = docs.join(later, same(later), "left_anti")
    again = materialise(of.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))
    if not again.limit(1).count():
        return left
    # pre-aggregated, so that any number of equal rows costs one from each task
    row = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in docs.columns])).alias("row")
    one = left.join(again, same(again), "left_semi").groupBy(docs["doc_id"], text).agg(row)
    return left.join(again, same(again), "left_anti").union(one.select("row.*"))


def op5_count_rtree(spark, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return link_classes(table(spark, sf_dir, "documents"))
