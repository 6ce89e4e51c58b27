"""Benchmark decontamination by the q-gram lemma.

A document that holds an item of m bytes with at most k edits shares at least m - q + 1 - k*q of the
item's q-grams, all on k + 1 neighbouring diagonals; q is 12, or less for an item so short that the bound
would be 0. Shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half, so that some
band holds any k + 1 neighbours. Bands that meet the bound, joined where they overlap, are verified by
alignment within them. Matching is on UTF-8 bytes, A-Z lower-cased, each ASCII white space as a blank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table, whole_text

Q = 12
#: Bytes of a text that are searched at a time, diagonals that are aligned at a time, and hits that are counted at a time.
SEGMENT, PORTION = 1 << 20, 500_000
_FOLD = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
MATCH = "doc_id long, item_id long, start long, end long, edits int"


def folded(text: str) -> bytes:
    """The bytes that are matched; as many as the text's UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """A hash of each q-gram. Equal grams hash alike; a clash only adds a candidate."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q < 8:
        h = np.ndarray((n,), "<u8", raw + bytes(8), 0, (1,)) & np.uint64((1 << (8 * q)) - 1)
        h *= np.uint64(0x9E3779B97F4A7C15)
    else:
        h = np.ndarray((n,), "<u8", raw, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= np.ndarray((n,), "<u8", raw, q - 8, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class GramIndex(NamedTuple):
    """Where the q-grams of items occur, one q for each index. Neighbouring places of one gram in one item,
    as in a row of dashes, are one run."""

    q: int
    seen: np.ndarray  # a bit array over the top bits of the hashes
    shift: int
    keys: np.ndarray
    starts: np.ndarray  # keys[i] has the runs starts[i]:starts[i + 1]
    item: np.ndarray
    low: np.ndarray  # a run's first and last place
    high: np.ndarray


class Items(NamedTuple):
    """A block of items, and the indexes of their q-grams."""

    ids: list[int]
    texts: list[bytes]
    edits: list[int]
    indexes: list[GramIndex]


def index_items(ids: list[int], texts: list[str], edit_share: float) -> Items:
    """The indexes. An item gets floor(edit_share x bytes) edits. Items without a byte are never found."""
    raw = [folded(t) for t in texts]
    edits = [int(edit_share * len(r)) for r in raw]
    by_q = defaultdict(list)
    for i, r in enumerate(raw):
        if r:
            by_q[min(Q, max(1, len(r) // (edits[i] + 1)))].append(i)
    return Items(ids, raw, edits, [_index(q, own, raw) for q, own in sorted(by_q.items())])


def _index(q: int, own: list[int], raw: list[bytes]) -> GramIndex:
    h = [grams(raw[i], q) for i in own]
    key = np.concatenate(h)
    item = np.repeat(own, [len(x) for x in h])
    at = np.concatenate([np.arange(len(x)) for x in h])
    order = np.lexsort((at, item, key))
    key, item, at = key[order], item[order], at[order]
    new = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    keys, starts = np.unique(key[first], return_index=True)
    bits = min(24, max(10, int(len(keys)).bit_length() + 6))
    seen = np.zeros(1 << bits, bool)
    seen[keys >> np.uint64(64 - bits)] = True
    return GramIndex(q, seen, 64 - bits, keys, np.append(starts, len(first)), item[first], at[first], at[last])


def edits_by_end(item: bytes, text: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The fewest edits that turn the item into a part of the text on diagonals low..high (text position
    minus item position), for each end of such a part, and those ends."""
    width = high - low + 1
    padded = np.full(len(item) + width, 256, np.int32)
    a, b = max(0, low), min(len(text), len(item) + high)
    padded[a - low : b - low] = np.frombuffer(text[a:b], np.uint8)
    steps = np.arange(width)
    row = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, 1 << 20)
    for i, c in enumerate(item):
        down = np.minimum(row + (padded[i : i + width] != c), np.append(row[1:], 1 << 20) + 1)
        row = np.minimum.accumulate(down - steps) + steps
    ends = len(item) + low + steps
    inside = (ends >= 0) & (ends <= len(text))
    return row[inside], ends[inside]


def align(item: bytes, text: bytes, low: int, high: int) -> tuple[int, int]:
    """The fewest edits of the item to some part of the text on those diagonals, and where that part ends."""
    row, ends = edits_by_end(item, text, low, high)
    best = int(row.argmin())
    return int(row[best]), int(ends[best])


def full_bands(index: GramIndex, items: Items, raw: bytes) -> Iterator[tuple[int, int]]:
    """(item, band) that meet the bound, in order. The text is searched by segments and its hits are counted
    by portions, so a text of one repeated byte needs no more memory than others."""
    edits, size = np.array(items.edits), np.array([len(t) for t in items.texts])
    codes, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for base in range(0, len(raw) - index.q + 1, SEGMENT):
        h = grams(raw if len(raw) <= SEGMENT else raw[base : base + SEGMENT + index.q - 1], index.q)[:SEGMENT]
        pos = np.flatnonzero(index.seen[h >> np.uint64(index.shift)])
        k = np.searchsorted(index.keys, h[pos])
        k[k == len(index.keys)] = 0
        hit = index.keys[k] == h[pos]
        pos, k = pos[hit] + base, k[hit]
        count = index.starts[k + 1] - index.starts[k]
        so_far = np.cumsum(count)
        start = 0
        while start < len(pos):
            end = max(start + 1, int(np.searchsorted(so_far, (so_far[start - 1] if start else 0) + PORTION, "right")))
            n = count[start:end]
            run = np.repeat(index.starts[k[start:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, p = index.item[run], np.repeat(pos[start:end], n)
            wide = edits[item] + 1
            # a run is in every band that holds one of its diagonals, counted as if it lay in it whole
            first, last = (p - index.high[run]) // wide - 1, (p - index.low[run]) // wide
            m = last - first + 1
            band = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
            weight = np.repeat(np.minimum(index.high[run] - index.low[run] + 1, 2 * wide), m)
            code, of = np.unique(np.repeat(item, m) << 40 | band + (1 << 39), return_inverse=True)
            codes.append(code)
            sums.append(np.bincount(of, weight).astype(np.int64))
            start = end
    code, of = np.unique(np.concatenate(codes), return_inverse=True)
    if len(code):
        item = code >> 40
        full = np.bincount(of, np.concatenate(sums)) >= size[item] - index.q + 1 - edits[item] * index.q
        yield from zip(item[full].tolist(), ((code[full] & ((1 << 40) - 1)) - (1 << 39)).tolist())


def copies(item: bytes, raw: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the first copy in each chain of overlapping ones."""
    at, chain = raw.find(item), 0
    while at >= 0:
        if at >= chain:
            yield at, at + len(item)
        chain = at + len(item)
        at = raw.find(item, at + 1)


def matches(items: Items, text: str) -> Iterator[tuple[int, int, int, int]]:
    """(place of the item in ``items``, start, end, edits) of the parts of the text that an item matches,
    the best of those that end at neighbouring bytes."""
    raw = folded(text)
    for index in items.indexes:
        for i, own in groupby(full_bands(index, items, raw), key=lambda x: x[0]):
            word, most = items.texts[i], items.edits[i]
            if not most:
                yield from ((i, a, b, 0) for a, b in copies(word, raw))
                continue
            regions: list[list[int]] = []
            for _, b in own:
                low, high = b * (most + 1), (b + 2) * (most + 1) - 1
                if regions and low <= regions[-1][1]:
                    regions[-1][1] = high
                else:
                    regions.append([low, high])
            for low, high in regions:
                for part in range(low, high + 1, SEGMENT):  # overlapping by all diagonals that a match can cross
                    row, ends = edits_by_end(word, raw, part, min(high, part + SEGMENT + most))
                    good = np.flatnonzero(row <= most)
                    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
                        best = run[int(row[run].argmin())]
                        end, size = int(ends[best]), len(word)
                        back = raw[max(0, end - size - most) : end][::-1]
                        _, rest = align(word[::-1], back, -most, most) if end else (0, size)
                        yield i, max(0, end - rest), end, int(row[best])


def apart(found: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of each cluster of an item's overlapping matches the first of fewest edits."""
    for _, group in groupby(sorted(found, key=lambda m: (m[0], m[1], m[2], m[3])), key=lambda m: m[0]):
        cluster: list[tuple[int, int, int, int]] = []
        for match in group:
            if cluster and match[1] >= max(m[2] for m in cluster):
                yield min(cluster, key=lambda m: m[3])
                cluster = []
            cluster.append(match)
        yield min(cluster, key=lambda m: m[3])


def find_items(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.05, block_bytes: int = 32_000_000) -> DataFrame:
    """MATCH for each item found in each row of ``docs``: one row for each item and place; start and end
    are byte offsets in the text.

    Items go to the executors in blocks of about ``block_bytes`` of text, each block against all rows, so
    what is broadcast stays bounded whatever the benchmark's size. Null and empty texts match nothing, on
    either side; items of any other length are found. Rows of null doc_id keep it. Repeated rows are each
    reported; items of the same text too. Of overlapping matches of one item the first of fewest edits
    counts. Very long texts are searched whole, by segments. An empty benchmark or table gives no rows.
    Other columns are ignored.
    """
    return _matches(docs, benchmark, edit_share, block_bytes).drop("text_key")


def _matches(docs: DataFrame, benchmark: DataFrame, edit_share: float, block_bytes: int = 32_000_000) -> DataFrame:
    """The same with text_key, a hash of the row's text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    named = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    text = whole_text(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    found = []
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(index_items([r["item_id"] for r in part], [r["text"] for r in part], edit_share))

        def search(batches, shared=shared):
            items = shared.value
            for batch in batches:
                out = []
                for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key"))):
                    for i, start, end, edits in apart(matches(items, text)):
                        out.append((doc_id, items.ids[i], start, end, edits, key))
                columns = [*zip(*out)] or [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "edits", "text_key"])

        found.append(rows.mapInArrow(search, f"{MATCH}, text_key long"))
    return reduce(DataFrame.union, found)


def without_items(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.05) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns. A row goes by its own text: another
    row of the same doc_id (null too) stays if its text holds no item."""
    hit = _matches(docs, benchmark, edit_share).select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hit["hit_doc"]) & (F.xxhash64(whole_text(docs["text"])) == hit["hit_text"])
    return docs.join(hit, same, "left_anti")


def op9_qgram_decontam(spark, sf_dir: str) -> DataFrame:
    """Every place of every document where a benchmark item occurs with at most one edit in 20 bytes."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
