"""Spelling variants: a self-join of the vocabulary's trie with active-node sets.

Two words at distance one share what lies before their one edit and what lies after it. So the vocabulary is
partitioned by known prefixes and, for edits further ahead, by known suffixes: with m the smaller length of a
pair, the window [0, m) of places for the edit is cut in half, and each word goes to one unit by the prefix
before the right half and to another by the suffix behind the left one. Units of too many words are cut again,
down to windows of one place, which the alphabet bounds. No unit is dropped or cut off.

In a unit the middles of its words, between prefix and suffix, make a trie, walked down level by level. A
node's active nodes are those within distance one of it. They are kept as pairs: of one level, where a
character was replaced, and of two neighbouring levels, where one was inserted; both go on to children of equal
characters. Pairs of terminal nodes are words at distance one. Branches of one word without a pair are left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import byte_slices, materialise, table

#: The letters of a word, once A-Z are lower case; all are single bytes in Latin-1.
_RUN, _END = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Characters of a text that are cut into runs at a time; a run is never cut.
SEGMENT = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words of one unit. Windows of one place have fewer: 90 letters make 90 + 90**2 middles at most.
UNIT = 10_000
#: Words whose tries are walked together.
BATCH = 100_000


def _runs(text: str) -> Iterator[list[str]]:
    start = 0
    while start < len(text):
        end = _END.search(text, min(start + SEGMENT, len(text)))
        stop = end.start() if end else len(text)
        yield _RUN.findall(text, start, stop)
        start = max(stop, start + 1)


def word_counts(docs: DataFrame, least: int = 7, misspell: int | None = None) -> DataFrame:
    """word, n of all words of at least ``least`` letters in the documents (doc_id, text).

    Words are the maximal runs of [A-Za-z] and U+00C0 to U+00FF, A-Z lower-cased. ``misspell`` k plants
    misspellings: with h the crc32 of <doc_id>:<run> (no doc_id: empty), a run whose h is divisible by k loses
    its code point h % length. Counts are summed within each task before they are dealt out by word.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)
            counts.clear()
            return found

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for s in byte_slices(texts):
                for doc_id, text in zip(ids[s].to_pylist(), texts[s].to_pylist()):
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                    for runs in _runs(lowered):
                        if misspell is None:
                            counts.update(r for r in runs if len(r) >= least)
                            continue
                        for run, n in Counter(r for r in runs if len(r) >= least).items():
                            h = zlib.crc32(run.encode(), seed)
                            if h % misspell:
                                counts[run] += n
                            elif len(run) > least:
                                k = h % len(run)
                                counts[run[:k] + run[k + 1 :]] += n
                        if len(counts) > HELD:
                            yield out()
        if counts:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(middles: list[bytes], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all middles of one unit at distance one, each pair once. ``unit`` numbers the units from
    0; the middles of a unit are distinct.

    Level t has a node for each distinct (parent, character); a word keeps its node while that is shared or
    active. ``level[0]`` is the node of each word at depth t and ``level[1]`` at depth t + 1, -1 where it has none.
    """
    data = np.frombuffer(b"".join(middles), np.uint8)
    lengths = np.array([len(m) for m in middles], np.int64)
    starts = np.cumsum(lengths) - lengths

    def grow(words: np.ndarray, nodes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words longer than ``depth`` their children: (words, node of each, key of each node, word ending
        at each node or -1); a key is parent * 256 + character, in ascending order."""
        on = lengths[words] > depth
        words = words[on]
        keys, node = np.unique(nodes[on] * 256 + data[starts[words] + depth], return_inverse=True)
        ends = np.full(len(keys), -1)
        done = lengths[words] == depth + 1
        ends[node[done]] = words[done]
        return words, node, keys, ends

    def both(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children with equal characters of the pairs (a, b)."""
        low, high = np.searchsorted(keys_a, a * 256), np.searchsorted(keys_a, (a + 1) * 256)
        n = high - low
        child = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        want = np.repeat(b, n) * 256 + (keys_a[child] & 255)
        at = np.minimum(np.searchsorted(keys_b, want), max(len(keys_b) - 1, 0))
        hit = keys_b[at] == want if len(keys_b) else np.zeros(len(want), bool)
        return child[hit], at[hit]

    none = np.empty(0, np.int64)
    units = int(unit.max()) + 1 if len(unit) else 0
    here_ends = np.full(units, -1)
    words = np.arange(len(middles))
    here_ends[unit[lengths == 0]] = words[lengths == 0]
    words_1, nodes_1, keys_1, ends_1 = grow(words, unit, 0)
    parents = units  # how many nodes the level above has
    same, skew, depth = (none, none), (none, none), 0
    found_i, found_j = [], []
    while True:
        # (parent, child) with more than one word below the parent: one character more on one side
        below = np.bincount(keys_1[nodes_1] >> 8, minlength=parents) + (here_ends >= 0)
        child = np.flatnonzero(below[keys_1 >> 8] > 1)
        # within a run of equal characters several places give the same pair
        pairs = np.unique(np.append(skew[0], keys_1[child] >> 8) * (len(keys_1) + 1) + np.append(skew[1], child))
        skew = np.divmod(pairs, len(keys_1) + 1)
        for (a, b), ends_b in ((same, here_ends), (skew, ends_1)):
            i, j = here_ends[a], ends_b[b]
            hit = (i >= 0) & (j >= 0)
            found_i.append(i[hit])
            found_j.append(j[hit])
        if not len(keys_1):
            return np.concatenate(found_i), np.concatenate(found_j)
        # one level down: pairs that agree, and all pairs of one parent's children
        counts = np.bincount(keys_1 >> 8, minlength=parents)
        first = np.cumsum(counts) - counts
        later = (first + counts)[keys_1 >> 8] - np.arange(len(keys_1)) - 1
        a = np.repeat(np.arange(len(keys_1)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        kept = both(*same, keys_1, keys_1)
        same = np.append(kept[0], a), np.append(kept[1], b)
        # words alone on their branch and in no pair are left
        active = np.bincount(nodes_1, minlength=len(keys_1)) > 1
        active[same[0]] = active[same[1]] = active[skew[1]] = True
        wanted = np.zeros(parents, bool)
        wanted[skew[0]] = True
        active |= wanted[keys_1 >> 8]
        stay = active[nodes_1]
        words_2, nodes_2, keys_2, ends_2 = grow(words_1[stay], nodes_1[stay], depth + 1)
        skew = both(*skew, keys_1, keys_2)
        parents, here_ends = len(keys_1), ends_1
        words_1, nodes_1, keys_1, ends_1, depth = words_2, nodes_2, keys_2, ends_2, depth + 1


def _halves(rows: DataFrame) -> DataFrame:
    """The rows of units with the window [low, high) as rows of its two halves."""
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))))
    return rows.select("word", "n", "m", half.alias("w")).select("word", "n", "m", "w.low", "w.high")


def _named(rows: DataFrame) -> DataFrame:
    """With the unit's name: the smaller length, the window, and what is known before and behind it."""
    tail = F.expr("right(word, m - high)")
    return rows.withColumn("unit", F.concat_ws("|", F.concat_ws(":", "m", "low", "high"), F.expr("left(word, low)"), tail))


def units_of(words: DataFrame, least: int, most: int = UNIT) -> DataFrame:
    """unit, word, n, low, behind (how many known letters follow the window): each word in each of its units of
    two words and more, by windows that are cut until no unit has more than ``most`` words.

    Counts of units are pre-aggregated; units are told apart by joins, which split the words of a hot one. There
    are as many rounds at most as halvings of the longest word, commonly one or two.
    """
    length = F.length("word")
    each = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least)
    rows, done = materialise(_named(_halves(each.select("word", "n", "m", F.lit(0).alias("low"), F.col("m").alias("high"))))), None
    while True:
        counts = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("high") - F.col("low")).alias("places"))
        large = materialise(counts.where((F.col("words") > most) & (F.col("places") > 1)).select("unit"))
        if not large.limit(1).count():
            return (rows if done is None else done.unionByName(rows)).select("unit", "word", "n", "low", (F.col("m") - F.col("high")).alias("behind"))
        small = rows.join(large, "unit", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = materialise(_named(_halves(rows.join(large, "unit", "left_semi"))))


def near_words(words: DataFrame, least: int = 7, most: int = UNIT) -> DataFrame:
    """word, near, near_n: each word of (word, n) with all words at distance one, in both directions."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(units: list, rows: list) -> Iterator[pa.RecordBatch]:
            codes = np.cumsum([0, *(a != b for a, b in zip(units[1:], units))])
            texts = [w.encode("latin-1") for w, _, _, _ in rows]
            i, j = near_pairs([t[low : len(t) - behind] for t, (_, _, low, behind) in zip(texts, rows)], codes)
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000].tolist(), j[k : k + 50_000].tolist()
                pairs = [(rows[x][0], rows[y][0], rows[y][1]) for x, y in zip(a + b, b + a)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs), schema.types)], schema=schema)

        units, rows = [], []
        for batch in batches:
            new = zip(batch.column("unit").to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("word", "n", "low", "behind"))))
            for unit, row in new:
                if len(rows) >= BATCH and unit != units[-1]:
                    yield from solve(units, rows)
                    units, rows = [], []
                units.append(unit)
                rows.append(row)
        if rows:
            yield from solve(units, rows)

    dealt = units_of(words, least, most).repartition("unit").sortWithinPartitions("unit", "word")
    # a pair whose edit can lie at several places may be found in two units
    return dealt.mapInArrow(search, "word string, near string, near_n long").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root from (word, form), form null where there is none: what following the forms leads to last.

    Each round doubles the steps that are done; forms must lead nowhere in circles."""
    at = materialise(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialise(at.where("word <> root").join(ahead, "root").select("word", "further"))
        if not ahead.limit(1).count():
            return at
        at = materialise(at.join(ahead, "word", "left").select("word", F.coalesce("further", "root").alias("root")))


def spelling_groups(docs: DataFrame, least: int = 7, times: int = 2, factor: int = 10, misspell: int | None = None, most: int = UNIT) -> DataFrame:
    """word, form, root (strings), n, n_near and form_n of each word of the documents (doc_id, text) of at
    least ``least`` letters and ``times`` occurrences n, as ``word_counts`` cuts and counts them.

    Two words are near if one inserted, deleted or replaced letter makes one of the other; n_near counts a
    word's near words. Its form is the near word of largest n (of equal ones the smallest by code point) if
    that n is at least ``factor`` times its own, else null, as is form_n. The root is where following forms
    ends: the word itself if it has none.

    Null and empty texts have no words; a null doc_id counts as empty in ``misspell``; repeated rows count as
    often as they are there; very long texts and words count whole; other columns are ignored; an empty table
    gives no rows.
    """
    words = materialise(word_counts(docs, least, misspell).where(F.col("n") >= times))
    near = near_words(words, least, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    all_ = words.join(near, "word", "left")
    good = -F.col("best.n") >= F.col("n") * factor
    all_ = materialise(all_.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.n")).alias("form_n")))
    return all_.join(roots_of(all_), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_trie(spark, sf_dir: str) -> DataFrame:
    """All words of seven letters and more in all documents, one occurrence in 31 misspelt."""
    return spelling_groups(table(spark, sf_dir, "documents"), misspell=31)
