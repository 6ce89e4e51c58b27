"""Helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.tables import delete, materialise, scratch, shared_dir

__all__ = [
    "ODD", "WORD_SPACE", "bucket_of", "byte_slices", "delete", "hashed_words", "materialise", "mixed", "scratch", "shared_dir", "slices", "table", "whole_text", "words_of",
]

#: The ASCII white space that separates words, space and \x09-\x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder; Spark reads it, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def whole_text(text: Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z and cuts at ASCII white space: what ``[^\\x20\\x09-\\x0D]+`` finds, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of a list whose items have these sizes, of about ``most`` in all, at least one item each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def byte_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of an array of texts of about ``most`` bytes each, at least one text each."""
    return slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most)


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: Bytes of words that are hashed at a time.
SEGMENT = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _hash_tables(size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte (A-Z as a-z), and the powers of an odd number and of its inverse modulo 2**64."""
    of_byte = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
    of_byte[65:91] = of_byte[97:123]
    base = 0xD6E8FEB86659FD93
    powers = (np.multiply.accumulate(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return of_byte, *powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, start, end and 64-bit hash of each word of ``words_of``, and which word is
    each text's first (and, at last, how many there are).

    Equal words have equal hashes; two different ones clash with a chance of about 2**-56 or less.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.empty(0, np.uint8)
    edge = np.zeros(size + 1, bool)
    edge[offsets - offsets[0]] = True
    blank = _SPACE[data]
    starts = np.flatnonzero(~blank & (edge[:-1] | np.append(True, blank[:-1])[:size]))
    ends = np.flatnonzero(~blank & (edge[1:] | np.append(blank[1:], True)[:size])) + 1
    hashes, done = [np.empty(0, np.uint64)], 0
    while done < len(starts):  # whole words of about a segment; a longer word is a segment of its own
        low = starts[done]
        some = max(done + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        n = int(ends[some - 1] - low)
        of_byte, up, down = _hash_tables(SEGMENT if n <= SEGMENT else n)
        sums = np.append(np.uint64(0), np.cumsum(of_byte[data[low : low + n]] * up[:n], dtype=np.uint64))
        a, b = starts[done:some] - low, ends[done:some] - low
        hashes.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        done = some
    return data, starts, ends, np.concatenate(hashes), np.searchsorted(starts, offsets - offsets[0])
