"""Language-model scoring by Brown class-based bigrams.

Exchange clustering assigns words to classes: an item moves to the class that raises the likelihood of the
class bigrams most. The most frequent words and the words' endings (last three bytes) are exchanged one
after the other until none moves. All other words of the vocabulary's head start in their ending's class;
how often each follows and precedes each class is then counted over all training rows, and all of them
move at once, in as many tasks as the counts are dealt to. Words beyond the head have their ending's class.

A text's probability is the product over its tokens of P(class | class before) x P(word | class). Each
class gives the share of its tokens whose word occurs once to the add-one unigrams, which know unknown
words. Word counts, class bigrams and vocabulary come from all training rows; only the vocabulary's head
and tables of fixed size reach the driver. Words of the head are told by 64-bit hashes, of which a word of
10**9 others shares one with a chance of about 10**-5.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bucket_of, byte_slices, hashed_words, materialise, table, whole_text, words_of

_DOCS = b"\n"  # no word; its count is that of the training rows


class Vocabulary(NamedTuple):
    """The most frequent words with their counts, and how words map to items.

    Ids below len(words) are those words; then come the endings' ids, then the end of a text.
    """

    words: list[bytes]
    counts: np.ndarray
    items: int
    endings: int
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return len(self.words) + self.endings

    def item_of(self) -> np.ndarray:
        """The item of each id."""
        n = min(self.items, len(self.words))
        rest = [n + _ending(w, self.endings) for w in self.words[n:]]
        return np.array([*range(n), *rest, *range(n, n + self.endings + 1)])


def _ending(word: bytes, endings: int) -> int:
    return crc32(word[-3:]) % endings


class ClassModel(NamedTuple):
    """What scoring needs. ``next_class[c, d]``: P(d | c)."""

    vocabulary: Vocabulary
    class_of: np.ndarray  # of each item
    next_class: np.ndarray
    class_tokens: np.ndarray
    novel: np.ndarray  # of each class: the share that the unigrams get


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n: counts over all rows of ``docs``, and the rows' number under the word ``\\n``."""

    def count(batches):
        def out(c):
            return pa.RecordBatch.from_arrays([pa.array([*c], pa.binary()), pa.array([*c.values()], pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
                if len(found) > 400_000:
                    yield out(found)
                    found = Counter()
            found[_DOCS] += batch.num_rows
        yield out(found)

    rows = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class _Reader:
    """Finds the ids of words."""

    def __init__(self, v: Vocabulary) -> None:
        h = hashed_words(pa.array(v.words, pa.binary()))[3]
        self.id = np.argsort(h)
        self.h, self.v = h[self.id], v

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts' words with an end after each text, the number of tokens of each text, the
        texts' bytes, and where each word starts and ends in them."""
        data, starts, ends, h, first = hashed_words(texts)
        ids = len(self.v.words) + _endings(data, starts, ends) % self.v.endings
        if len(self.h):
            k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            ids = np.where(self.h[k] == h, self.id[k], ids)
        sizes = np.diff(first) + 1
        found = np.full(len(ids) + len(sizes), self.v.end)
        found[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
        return found, sizes, data, starts, ends


#: crc32's table, from its values on single bytes: crc32(b) = ~(table[255 ^ b] ^ 0xFFFFFF).
_CRC = np.array([crc32(bytes([255 ^ b])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word's last three lower-cased bytes."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        at = ends - back
        b = _LOWER[data[np.maximum(at, 0)]] if len(data) else np.empty(0, np.uint8)
        crc = np.where(at >= starts, _CRC[(crc ^ b) & 0xFF] ^ (crc >> np.uint32(8)), crc)
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def item_bigrams(docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """How often each item follows each other one over all rows of ``docs``; a text's start counts as an end."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    m = min(v.items, len(v.words)) + v.endings + 1

    def count(batches):
        v = shared.value
        reader, item_of = _Reader(v), v.item_of()
        n = np.zeros(m * m, np.int64)
        for batch in batches:
            for part in byte_slices(batch.column("text"), 4_000_000):
                item = item_of[reader.read(batch.column("text")[part])[0]]
                n += np.bincount(np.append(m - 1, item[:-1]) * m + item, minlength=m * m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["pair", "n"])

    rows = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(count, "pair int, n long")
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(m * m)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    return n.reshape(m, m)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_clusters(bigrams: np.ndarray, classes: int, rounds: int = 100) -> np.ndarray:
    """The class of each item. The last item keeps the last class for itself. Items go round the other
    classes by frequency at first; each then moves to the class of highest class-bigram likelihood, the
    lower class on ties, until a round moves none."""
    m, last = len(bigrams), classes - 1
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:-1], kind="stable")
    of = np.empty(m, int)
    of[order], of[-1] = np.arange(m - 1) % last, last
    hot = np.eye(classes)[of]
    n = hot.T @ bigrams @ hot
    for _ in range(rounds):
        moved = 0
        for w in order:
            own = bigrams[w, w]
            to = np.bincount(of, bigrams[w], classes)
            fro = np.bincount(of, bigrams[:, w], classes)
            to[of[w]] -= own
            fro[of[w]] -= own
            if not to.any() and not fro.any() and not own:
                continue
            a = of[w]
            n[a] -= to
            n[:, a] -= fro
            n[a, a] -= own
            plain = _xlogx(n)
            row, col = _xlogx(n + to) - plain, _xlogx(n + fro[:, None]) - plain
            both = _xlogx(n.diagonal() + to + fro + own) - plain.diagonal()
            left, right = n.sum(1), n.sum(0)
            gain = row.sum(1) - row.diagonal() + col.sum(0) - col.diagonal() + both
            gain -= _xlogx(left + to.sum() + own) - _xlogx(left) + _xlogx(right + fro.sum() + own) - _xlogx(right)
            b = int(np.argmax(gain[:last]))
            b = b if gain[b] > gain[a] + 1e-6 else a
            n[b] += to
            n[:, b] += fro
            n[b, b] += own
            of[w], moved = b, moved + (a != b)
        if not moved:
            break
    return of


def class_bigrams(docs: DataFrame, v: Vocabulary, class_of: np.ndarray) -> np.ndarray:
    """How often each class follows each other one over all rows of ``docs``."""
    shared, classes = docs.sparkSession.sparkContext.broadcast((v, class_of)), int(class_of[-1]) + 1

    def count(batches):
        v, class_of = shared.value
        reader, cls = _Reader(v), class_of[v.item_of()]
        n = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for part in byte_slices(batch.column("text"), 4_000_000):
                c = cls[reader.read(batch.column("text")[part])[0]]
                n += np.bincount(np.append(classes - 1, c[:-1]) * classes + c, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes, dtype=np.int32)), pa.array(n)], names=["pair", "n"])

    rows = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(count, "pair int, n long")
    found = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(classes * classes)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    return n.reshape(classes, classes)


def exchange_rest(docs: DataFrame, v: Vocabulary, class_of: np.ndarray, first: int, parts: int = 64) -> np.ndarray:
    """``class_of`` after all items from ``first`` to the last word have moved at once.

    An item's counts are those of the classes before and after it over all rows of ``docs``; it moves to the
    class b of highest sum of counts x log n(c, b), counts x log n(b, d) and -2 x count x log n(b), which is
    what the class bigrams' likelihood gains by it to first order. Each task sends its counts in ``parts``
    packed pieces; a piece's task sums them and returns one byte for each item.
    """
    classes, words = int(class_of[-1]) + 1, v.items
    shared = docs.sparkSession.sparkContext.broadcast((v, class_of))

    def count(batches):
        v, class_of = shared.value
        reader, cls = _Reader(v), class_of[v.item_of()]
        n = np.zeros((words, 2 * classes), np.int32)
        for batch in batches:
            for part in byte_slices(batch.column("text"), 4_000_000):
                ids = reader.read(batch.column("text")[part])[0]
                c = np.concatenate([[classes - 1], cls[ids], [classes - 1]])
                at = np.flatnonzero((ids >= first) & (ids < words))
                np.add.at(n, (ids[at], c[at]), 1)
                np.add.at(n, (ids[at], classes + c[at + 2]), 1)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        packed = [squeeze(np.ascontiguousarray(n[k::parts]).tobytes()) for k in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())], names=["part", "packed"])

    pairs = class_bigrams(docs, v, class_of) + 0.5
    size = pairs.sum(0)

    def move(batches):
        unpack = zstandard.ZstdDecompressor().decompress

        def best(n):
            gain = n[:, :classes] @ np.log(pairs) + n[:, classes:] @ np.log(pairs.T) - 2 * n[:, :classes].sum(1)[:, None] * np.log(size)
            return np.where(n.any(1), gain[:, : classes - 1].argmax(1), 255).astype(np.uint8).tobytes()

        part, n = None, None
        out: dict[int, bytes] = {}
        for batch in batches:
            for k, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                one = np.frombuffer(unpack(packed), np.int32).reshape(-1, 2 * classes).astype(np.int64)
                if k != part:
                    if n is not None:
                        out[part] = best(n)
                    part, n = k, one
                else:
                    n += one
        if n is not None:
            out[part] = best(n)
        yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), pa.array([*out.values()], pa.binary())], names=["part", "moved"])

    rows = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(count, "part int, packed binary")
    found = rows.repartition("part").sortWithinPartitions("part").mapInArrow(move, "part int, moved binary").toArrow()
    moved = np.full(words, 255, np.uint8)
    for k, b in zip(found["part"].to_pylist(), found["moved"].to_pylist()):
        moved[k::parts] = np.frombuffer(b, np.uint8)
    out = class_of.copy()
    out[:words] = np.where(moved < 255, moved, class_of[:words])
    return out


def train_classes(
    docs: DataFrame, head: int = 65_536, items: int | None = None, endings: int = 256, classes: int = 64, seeds: int = 1024, rounds: int = 1
) -> tuple[ClassModel, DataFrame]:
    """A model of the rows of ``docs``, and the counts of all their words (word, n).

    Of the ``head`` most frequent words, ``items`` (None: all) have a class of their own; ``seeds`` of them
    are exchanged one by one with the endings, the others together, in ``rounds`` over all rows.
    Classes are kept in one byte, of which 255 means none: more than 255 raise.
    """
    if classes > 255:
        raise ValueError(f"{classes} classes, at most 255")
    counts = materialise(count_words(docs))
    total = counts.agg(
        F.sum(F.when(F.col("word") != _DOCS, F.col("n"))).alias("words"),
        F.sum((F.col("word") != _DOCS).cast("long")).alias("distinct"),
        F.sum(F.when(F.col("word") == _DOCS, F.col("n"))).alias("docs"),
    ).first()
    n_docs = total["docs"] or 0
    top = counts.where(F.col("word") != _DOCS).orderBy(F.desc("n"), "word").limit(head).toArrow()
    v = Vocabulary(
        top["word"].to_pylist(),
        np.array(top["n"].to_pylist() + [0] * endings + [n_docs], float),
        min(head if items is None else items, len(top)),
        endings,
        (total["words"] or 0) + n_docs,
        (total["distinct"] or 0) + (n_docs > 0),
    )
    few = v._replace(items=min(seeds, v.items))
    of = exchange_clusters(item_bigrams(docs, few), classes)[few.item_of()]  # of each id
    of = np.concatenate([of[: v.items], of[len(v.words) :]])  # of each item
    if v.items > few.items:
        for _ in range(rounds):
            of = exchange_rest(docs, v, of, few.items)
    hot = np.eye(classes)[of]
    n = class_bigrams(docs, v, of)
    tokens = n.sum(0)
    share = (tokens + 1) / (tokens.sum() + classes)
    once = _once(counts, v) @ hot
    return ClassModel(v, of, (n + 5 * share) / (n.sum(1, keepdims=True) + 5), np.maximum(tokens, 1), (once + 1) / (tokens + 2)), counts


def _once(counts: DataFrame, v: Vocabulary) -> np.ndarray:
    """How many words of each item occur once."""
    ending = F.crc32(F.substring("word", -3, 3)) % v.endings
    found = counts.where((F.col("n") == 1) & (F.col("word") != _DOCS)).groupBy(ending.alias("ending")).count().collect()
    own = min(v.items, len(v.words))
    once = np.zeros(own + v.endings + 1)
    for r in found:
        once[own + r["ending"]] = r["count"]
    for i in np.flatnonzero(v.counts[:own] == 1):  # counted with their endings, but items of their own
        once[own + _ending(v.words[i], v.endings)] -= 1
        once[i] = 1
    return once


_SCORED = (
    "doc_id long, text_key long, word binary, tokens long, known long, base double, full double, a double, b double, times long"
)


def score_documents(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each row of ``docs``.

    Tokens are the words and one end. ``base_score`` sums log10 of the add-one unigrams, ``score`` log10 of
    the model; ``perplexity`` is 10 ** (-score / n_tokens). The most frequent words are looked up in the
    tasks; the others' counts are joined by word, each word of a text with the same class before it once.
    Null text counts as empty: one token, the end. Repeated rows and null ids each keep their row; very long
    texts are scored whole; an empty table gives no rows; other columns are ignored. A model without
    training rows gives unknown words probability 1 as its base.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the words' lengths
    v = model.vocabulary
    spread = float(v.tokens + v.distinct + 1)
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def score(batches):
        model = shared.value
        v = model.vocabulary
        reader, cls, n_of = _Reader(v), model.class_of[v.item_of()], v.counts
        classes = len(model.next_class)
        word_part = (1 - model.novel) * model.next_class / model.class_tokens
        unigram_part = model.next_class @ model.novel
        for batch in batches:
            for part in byte_slices(batch.column("text")):
                found, sizes, data, starts, ends = reader.read(batch.column("text")[part])
                c, n = cls[found], n_of[found]
                before = np.append(cls[v.end], c[:-1])
                a, b = word_part[before, c], unigram_part[before]
                rare = (found >= len(v.words)) & (found < v.end)
                base = np.where(rare, 0, np.log10((n + 1) / spread))
                full = np.where(rare, 0, np.log10(a * n + b * (n + 1) / spread))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                sums = [np.add.reduceat(x, first) for x in (~rare & (n > 0), base, full)]
                doc, text_key = batch.column("doc_id")[part], batch.column("text_key")[part]
                at = np.flatnonzero(rare)
                of = np.repeat(np.arange(len(sizes)), sizes)[at]
                low, high = starts[at - of], ends[at - of]
                words = [data[x:y].tobytes().lower() for x, y in zip(low.tolist(), high.tolist())]
                seen = Counter(zip(of.tolist(), (before[at] * classes + c[at]).tolist(), words))
                of = np.fromiter((k[0] for k in seen), np.int64, len(seen))
                was, now = np.divmod(np.fromiter((k[1] for k in seen), np.int64, len(seen)), classes)
                nothing = lambda kind: pa.nulls(len(seen), kind)
                columns = [
                    pa.concat_arrays([x, x.take(pa.array(of))]) for x in (doc, text_key)
                ] + [
                    # no word holds a line feed: the texts' own rows spread over the join and match nothing
                    pa.array([b"\n%d" % k for k in text_key.to_pylist()] + [k[2] for k in seen], pa.binary()),
                    pa.concat_arrays([pa.array(sizes), nothing(pa.int64())]),
                    pa.concat_arrays([pa.array(sums[0].astype(np.int64)), nothing(pa.int64())]),
                    pa.concat_arrays([pa.array(sums[1]), nothing(pa.float64())]),
                    pa.concat_arrays([pa.array(sums[2]), nothing(pa.float64())]),
                    pa.concat_arrays([pa.nulls(len(sizes), pa.float64()), pa.array(word_part[was, now])]),
                    pa.concat_arrays([pa.nulls(len(sizes), pa.float64()), pa.array(unigram_part[was])]),
                    pa.array([1] * len(sizes) + [*seen.values()], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    text = whole_text(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    each = rows.mapInArrow(score, _SCORED).join(counts.where(F.col("word") != _DOCS), "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = F.col("a").isNotNull()
    unigram = (n + 1) / F.lit(spread)
    base = F.when(rare, F.col("times") * F.log10(unigram)).otherwise(F.col("base"))
    full = F.when(rare, F.col("times") * F.log10(F.col("a") * n + F.col("b") * unigram)).otherwise(F.col("full"))
    known = F.when(rare, F.when(n > 0, F.col("times")).otherwise(0)).otherwise(F.col("known"))
    # rows of the same id and text come together, and apart again by their number
    sums = each.groupBy("doc_id", "text_key").agg(
        F.sum("tokens").alias("t"), F.sum(known).alias("k"), F.sum(base).alias("b"), F.sum(full).alias("f"), F.count("tokens").alias("m")
    )
    one = sums.select(
        "doc_id",
        F.expr("t div m").alias("n_tokens"),
        F.expr("k div m").alias("n_known"),
        (F.col("b") / F.col("m")).alias("base_score"),
        (F.col("f") / F.col("m")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"),
    )
    return one.drop("copy").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_brown_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; every seventh bucket of ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model, counts = train_classes(docs.where(bucket_of(F.col("doc_id"), 7) != 2))
    scored = score_documents(docs, model, counts)
    return scored.select(
        "doc_id",
        (bucket_of(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
