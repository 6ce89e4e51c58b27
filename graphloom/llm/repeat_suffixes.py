"""Removal of repeated byte strings by bucket-pointer refinement.

Each byte that lies in a string of ``width`` bytes that also starts in a document of smaller doc_id goes.

Equal strings share their smallest q-gram (by hash, leftmost on ties), so the first buckets are keyed by
the q-grams that are smallest in some window. Each occurrence also has a hash of its context, the text of
all windows that its q-gram stands for. Buckets with one document hold no repeat and end there. An
occurrence whose context a smaller doc_id holds too goes whole. Of the buckets with several contexts, each
distinct context is fetched from the first document that holds it. Equal windows hold the q-gram at the same place, so a window that starts well before it
needs another context with the same bytes before the q-gram, and any other one with the same bytes after
it; contexts that share neither with another are done. The windows that are left are refined by bucket
pointers: the rank of a position's first eight bytes, then of the pair (rank here, rank eight on), then
sixteen on, each round reusing the ranks of the one before, until the rank tells the whole window. The
smallest doc_id of each rank decides its occurrences.

Contexts count as equal when q-gram and context have equal hashes, of 44 and 63 bits. Over 100 TB of text,
with some 5 x 10**12 occurrences, two different ones do so with a chance of about 10**-7; within one
q-gram's bucket of 10**9 different contexts, of about one in twenty.

The keys are worked on in a few passes, by their remainder, and the shuffle files of a pass are deleted
when it ends: disk holds the occurrences or the contexts of one pass at a time, at the price of reading
the text twice in each. Text crosses the network compressed, as an exchange by doc_id, for each pass and
for the last step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import byte_slices, materialise, slices, table, whole_text

Q, KEY_BITS, CONTEXT_BITS = 16, 44, 63
#: Bytes of a long text that are worked on at a time; they overlap by a window less one.
SEGMENT = 1 << 20
#: Short texts are worked on together, up to so many bytes.
TOGETHER = 1 << 16


@lru_cache(maxsize=1)
def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    of_byte = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers = []
    for base in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)):
        powers.append(np.multiply.accumulate(np.append(np.uint64(1), np.full(SEGMENT, base, np.uint64))))
    return of_byte, *powers


def smallest_grams(raw: bytes, width: int, sizes: list[int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each segment of the text, in order: keys, the contexts' hashes, the first and last start of the
    windows that each key stands for, and where its q-gram starts. The context is the text from the first
    start to the last end. With ``sizes``, ``raw`` is one segment of several texts in a row, and windows
    over the end of one are left out."""
    grams = width - Q + 1
    of_byte, powers, inverses = _hash_tables()
    for base in range(0, max(len(raw) - width + 1, 0), SEGMENT - width + 1):
        size = min(len(raw) - base, SEGMENT)
        n = size - Q + 1
        h = np.ndarray((n,), "<u8", raw, base, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += np.ndarray((n,), "<u8", raw, base + 8, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        # the position below the hash makes the leftmost of equal grams the smallest
        h = (h >> np.uint64(64 - KEY_BITS) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= grams:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < grams:
            h = np.minimum(h[: len(h) - (grams - span)], h[grams - span :])
        if sizes is None:
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
        else:
            ends = np.cumsum(sizes)
            starts = np.flatnonzero(np.arange(len(h)) <= np.repeat(ends - width, sizes)[: len(h)])
            if not len(starts):
                return
            # texts share no q-gram's place, so a key's windows are of one text
            own = h[starts]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            first, last = starts[first], starts[np.append(first[1:], len(own)) - 1]
        sums = of_byte[np.frombuffer(raw, np.uint8, size, base)] * powers[:size]
        sums = np.append(np.uint64(0), np.cumsum(sums, dtype=np.uint64))
        context = (sums[last + width] - sums[first]) * inverses[first] + (last - first).astype(np.uint64)
        context = (context ^ (context >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        context ^= context >> np.uint64(29)
        context *= np.uint64(0xBF58476D1CE4E5B9)
        context = (context >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)
        gram = (h[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        yield (h[first] >> np.uint64(20)).astype(np.int64), context, first + base, last + base, gram + base


def occurrences(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, contexts' hashes, places and which text they are of, of all texts in a row."""
    found = [(np.empty(0, np.int64),) * 6]
    lengths = [len(x) for x in texts]
    for part in slices(lengths, TOGETHER):
        sizes = lengths[part]
        starts = np.append(0, np.cumsum(sizes))[:-1]
        for key, context, first, last, gram in smallest_grams(b"".join(texts[part]), width, sizes if len(sizes) > 1 else None):
            of = np.searchsorted(starts, first, "right") - 1
            found.append((key, context, first - starts[of], last - first, gram - first, of + part.start))
    key, context, first, more, gram, of = (np.concatenate(x) for x in zip(*found))
    return key, context, (first * width + more) * width + gram, of


def of_place(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start of the place's windows, how many more there are, and the q-gram's distance from the first."""
    return at // (width * width), at // width % width, at % width


def window_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the windows data[s:s + width], by bucket-pointer refinement; equal ranks, equal windows.

    ``data`` must go on for at least 8 bytes after the last window.
    """
    def ranks(depth: int, at: np.ndarray) -> np.ndarray:
        """Of the first ``depth`` bytes at the sorted positions ``at``."""
        if depth == 8:
            key = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[at].astype(np.uint64)
            return np.unique(key, return_inverse=True)[1]
        half = 8
        while 2 * half < depth:
            half *= 2
        need = np.union1d(at, at + (depth - half))
        below = ranks(half, need)
        here, ahead = below[np.searchsorted(need, at)], below[np.searchsorted(need, at + (depth - half))]
        return np.unique(here.astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64), return_inverse=True)[1]

    return ranks(width, starts)


def _refine(width: int, most_bytes: int):
    """Per distinct context of a bucket, in its first document: runs of window starts that an earlier document has."""

    half = (width - Q + 1) // 2  # a window that starts so far before the q-gram or further counts as left

    def shared_by_others(bucket, docs, words):
        """Whether a row of the bucket from another document has the same words.
        Words are compared by a hash: a clash keeps a row that refinement then tells apart."""
        h = bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for w in words:
            h = (h ^ (h >> np.uint64(31)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(h)
        starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        open_ = (sizes > 1) & (np.minimum.reduceat(docs[order], starts) < np.maximum.reduceat(docs[order], starts))
        found = np.empty(len(h), bool)
        found[order] = np.repeat(open_, sizes)
        return found

    def solve(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        keys, hashes, docs, texts, at = (part[c].to_numpy() for c in ("key", "h", "doc_id", "text_key", "at"))
        text = pa.concat_arrays(part["ctx"].chunks)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.append(np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(32, np.uint8))
        base, (_, more, gram) = ends[:-1] - ends[0], of_place(at, width)
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        bucket = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        asked = [np.zeros(len(text), bool), np.zeros(len(text), bool)]  # right windows, left windows
        # all left windows have half bytes before the q-gram, all right ones width - Q - half + 1 after it
        before, after = range(-8, -half - 1, -8), range(Q, width - half - 6, 8)
        for side, have, offsets in ((1, gram >= half, before), (0, gram - more < half, after)):
            i = np.flatnonzero(have)
            if len(i):
                asked[side][i] = shared_by_others(bucket[i], docs[i], [eight[base[i] + gram[i] + o] for o in offsets])
        of = np.repeat(np.arange(len(text)), more + 1)
        place = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        left = gram[of] - place >= half
        least = docs[of]
        go_on = np.flatnonzero(np.where(left, asked[1][of], asked[0][of]))
        if len(go_on):
            rank = window_ranks(data, base[of[go_on]] + place[go_on], width)
            of_rank = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(of_rank, rank, least[go_on])
            least[go_on] = of_rank[rank]
        gone = least < docs[of]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (gone[1:] != gone[:-1])))
        last = np.append(first[1:], len(of)) - 1
        first, last = first[gone[first]], last[gone[first]]
        o = of[first]
        columns = [keys[o], hashes[o], docs[o], texts[o], at[o], place[first], place[last]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "h", "doc_id", "text_key", "at", "low", "high"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("ctx").nbytes
            if size > most_bytes:  # up to the last bucket, which may go on; a bucket is never cut
                keys = batch.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield solve(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                    held, size = [batch.slice(cut)], 0
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time, so that a worker holds little beside its input."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in _pieces(batches):
        packed = [squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "packed"])


def _grams(width: int, passes: int, turn: int):
    def run(batches):
        for batch in batches:
            for part in byte_slices(batch.column("text")):
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text")[part].to_pylist()]
                key, context, at, of = occurrences(texts, width)
                if passes > 1:
                    own = key % passes == turn
                    key, context, at, of = key[own], context[own], at[own], of[own]
                doc, text_key = (batch.column(c)[part].to_numpy()[of] for c in ("doc_id", "text_key"))
                columns = [pa.array(x) for x in (key, context, doc, text_key, at)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "doc_id", "text_key", "at"])

    return run


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of an array of structs; nulls are -1, and a null list is empty."""
    sizes = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    return np.append(0, np.cumsum(sizes)), [pc.fill_null(pc.struct_field(flat, n), -1).to_numpy(zero_copy_only=False) for n in names]


def _contexts(width: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _pieces(batches):
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
            texts: list[bytes] = []
            ends, (of_text, *fields) = _lists(batch.column("wanted"), "text_key", "key", "h", "at")
            for row, (doc, text_key, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "packed")))):
                own = ends[row] + np.flatnonzero(of_text[ends[row] : ends[row + 1]] == text_key)
                if not len(own):
                    continue
                raw = unpack(packed)
                first, more, _ = of_place(fields[2][own], width)
                texts += [raw[x:y] for x, y in zip(first.tolist(), (first + more + width).tolist())]
                for x, v in zip(out, (*(f[own] for f in fields), np.full(len(own), doc), np.full(len(own), text_key))):
                    x.append(v)
            key, context, at, doc, text_key = (pa.array(np.concatenate(x)) for x in out)
            yield pa.RecordBatch.from_arrays(
                [key, context, pa.array(texts, pa.binary()), doc, text_key, at], names=["key", "h", "ctx", "doc_id", "text_key", "at"]
            )

    return run


def _shared(rows: DataFrame, width: int, passes: int, turn: int) -> DataFrame:
    """The occurrences, of the keys of one pass, that a smaller doc_id may have too: doc_id, text_key and at;
    key and h unless the whole context goes; and ``asks``, true for one occurrence of each key and h."""
    in_bucket = Window.partitionBy("key")
    in_context = Window.partitionBy("key", "h").orderBy("doc_id", "text_key", "at")
    grams = rows.mapInArrow(_grams(width, passes, turn), "key long, h long, doc_id long, text_key long, at long")
    found = grams.select(
        "*",
        (F.min("doc_id").over(in_bucket) < F.max("doc_id").over(in_bucket)).alias("shared"),
        (F.min("h").over(in_bucket) < F.max("h").over(in_bucket)).alias("several"),
    ).where("shared")
    found = found.select(
        "*", F.first("doc_id").over(in_context).alias("first_doc"), F.row_number().over(in_context).alias("n"), F.rank().over(in_context).alias("place")
    )
    later = F.col("first_doc") < F.col("doc_id")
    # of equal rows, as repeated documents give them, one asks
    found = found.where(later | (F.col("several") & ((F.col("n") == 1) | (F.col("place") > 1))))
    keys = [F.when(~later, F.col(c)).alias(c) for c in ("key", "h")]
    return found.select(*keys, "doc_id", "text_key", "at", F.when(~later, F.col("n") == 1).alias("asks"))


def _answers(found: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """key, h, doc_id, text_key, at of the occurrences of ``found`` that ask, with each run of their windows
    (from low to high) that an earlier document has."""
    wanted = found.where("asks").groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "key", "h", "at")).alias("wanted"))
    return (
        packed.join(wanted, "doc_id")
        .select("doc_id", "text_key", "packed", "wanted")
        .mapInArrow(_contexts(width), "key long, h long, ctx binary, doc_id long, text_key long, at long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_refine(width, 2_000_000), "key long, h long, doc_id long, text_key long, at long, low long, high long")
    )


def repeated_spans(rows: DataFrame, packed: DataFrame, width: int, passes: int = 2) -> DataFrame:
    """doc_id and spans: of each document with bytes to remove, the occurrences by place, and which of
    their windows (from low to high; null: all) have an earlier copy.

    ``rows`` has doc_id (no null), text_key and text, ``packed`` the same with the text compressed.
    """
    none = F.lit(None).cast("long")
    span = lambda low, high: F.struct("text_key", "at", low.alias("low"), high.alias("high")).alias("s")
    spans = None
    for turn in range(passes):
        found = materialise(_shared(rows, width, passes, turn), once=True)
        answers = materialise(_answers(found, packed, width), once=True)
        # one document may hold a context at several places
        again = found.where("not asks").select("key", "h", "doc_id", "text_key", "at").distinct()
        again = again.join(answers.select("key", "h", "low", "high").distinct(), ["key", "h"])
        one = found.where("key is null").select("doc_id", span(none, none))
        for x in (answers, again):
            one = one.union(x.select("doc_id", span(F.col("low"), F.col("high"))))
        spans = one if spans is None else spans.union(one)
    return spans.groupBy("doc_id").agg(F.collect_list("s").alias("spans"))


def _removed(width: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _pieces(batches):
            kept, spans, sizes = [], [], []
            ends, (of_text, at, low, high) = _lists(batch.column("spans"), "text_key", "at", "low", "high")
            for row, (packed, text_key) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("text_key").to_pylist())):
                raw = unpack(packed)
                edges = np.zeros(len(raw) + 1, np.int32)
                own = np.arange(ends[row], ends[row + 1])
                own = own[of_text[own] == text_key]
                if len(own):
                    first, more, _ = of_place(at[own], width)
                    some = high[own] >= 0
                    np.add.at(edges, first + np.where(some, low[own], 0), 1)
                    np.add.at(edges, first + np.where(some, high[own], more) + width, -1)
                gone = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
                a, b = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])
                kept.append(np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes())
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = 50, passes: int = 2) -> DataFrame:
    """doc_id, n_bytes, removed (the maximal removed runs, as start and end byte) and kept (the bytes left)
    of each row of ``docs``.

    Strings are judged on the input. Null text counts as empty. Rows of null doc_id stay whole and remove
    nothing from others. Rows that share a doc_id don't touch each other; each repeated row is returned.
    Very long texts are worked on by segments, with the same result. An empty table gives no rows. Other
    columns are ignored. More ``passes`` over the text need less disk, with the same result.
    """
    if not Q <= width:
        raise ValueError(f"width must be at least {Q}")
    if passes < 1:
        raise ValueError("at least one pass")
    text = whole_text(F.col("text"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = every.where("doc_id is not null")
    pack = lambda x: x.mapInArrow(_packed, "doc_id long, text_key long, packed binary")
    packed = pack(rows)
    spans = repeated_spans(rows, packed, width, passes)
    whole = pack(every.where("doc_id is null")).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    kind = "doc_id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"
    return packed.join(spans, "doc_id", "left").select(*whole.columns).union(whole).mapInArrow(_removed(width), kind)


def op6_repeat_suffixes(spark, sf_dir: str) -> DataFrame:
    """Every document without its bytes in 50-byte strings of earlier documents, as digests."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
