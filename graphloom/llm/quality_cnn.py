"""Quality classification by a byte-level convolutional network in numpy.

Each position of a text is a symbol: its byte, and whether the four bytes there also occurred a few
bytes before. Learned filters slide over the symbols; each filter's responses are max-pooled over
overlapping chunks that cover the whole document; mean and maximum over the chunks combine into one
probability.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bucket_of, table, whole_text

WIDTH, FILTERS, HALF, LAGS = 5, 16, 256, 24
#: Bytes that are convolved at a time, a multiple of HALF, so that very long texts need little memory.
SEGMENT = 256 * HALF


class ByteNet(NamedTuple):
    """filters[j][symbol]: what the symbol at offset j adds to each filter's response."""

    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    intercept: float


def untrained() -> ByteNet:
    """Scores everything 0.5."""
    return ByteNet(np.zeros((WIDTH, 512, FILTERS), np.float32), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)


def symbols(raw: bytes) -> np.ndarray:
    """The text's symbols, padded by zeros to at least one chunk's half and WIDTH - 1 more."""
    n = max(len(raw), 1)
    padded = np.frombuffer(raw + bytes(n + WIDTH - 1 - len(raw) + 3), np.uint8)
    four = padded[:-3].astype(np.uint32)
    for j in (1, 2, 3):
        four |= padded[j : len(padded) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    again = np.zeros(len(four), bool)
    for lag in range(2, LAGS + 1):
        again[lag:] |= four[lag:] == four[:-lag]
    again[len(raw) :] = False
    return padded[:-3] + again.astype(np.uint16) * np.uint16(256)


def chunk_maxima(net: ByteNet, raw: bytes) -> np.ndarray:
    """Each filter's largest response in each chunk of two halves; neighbouring chunks share a half."""
    found = []
    s = symbols(raw)
    n = len(s) - WIDTH + 1
    for start in range(0, n, SEGMENT):
        part = s[start : min(start + SEGMENT, n) + WIDTH - 1]
        m = len(part) - WIDTH + 1
        response = net.filters[0][part[:m]]
        for j in range(1, WIDTH):
            response += net.filters[j][part[j : j + m]]
        found.append(np.maximum.reduceat(response, range(0, m, HALF)))
    halves = np.concatenate(found)
    return halves if len(halves) == 1 else np.maximum(halves[:-1], halves[1:])


def score_text(net: ByteNet, text: str) -> float:
    """The probability that the text's label is 1."""
    active = np.maximum(chunk_maxima(net, text.encode("utf-8", "surrogatepass")) + net.bias, 0)
    z = np.concatenate([active.mean(0), active.max(0)]) @ net.weight + net.intercept
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chunks_of(s: np.ndarray) -> np.ndarray:
    """All chunks of a text's symbols, (chunks, symbols), as views into one padded copy."""
    n = len(s) - WIDTH + 1
    count = max(1, -(-n // HALF) - 1)
    size = 2 * HALF + WIDTH - 1
    padded = np.pad(s, (0, max(0, (count - 1) * HALF + size - len(s))), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, size)[: (count - 1) * HALF + 1 : HALF]


def peaks(filters: np.ndarray, s: np.ndarray, portion: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each chunk of the symbols, and the symbols there, (chunks, WIDTH,
    filters)."""
    chunks, most, found = chunks_of(s), [], []
    in_last = len(s) - WIDTH + 1 - (len(chunks) - 1) * HALF
    for start in range(0, len(chunks), portion):
        part = chunks[start : start + portion]
        n = part.shape[1] - WIDTH + 1
        response = filters[0][part[:, :n]]
        for j in range(1, WIDTH):
            response += filters[j][part[:, j : j + n]]
        if start + portion >= len(chunks):
            response[-1, in_last:] = -np.inf  # there is only padding
        where = response.argmax(1)
        most.append(np.take_along_axis(response, where[:, None], 1)[:, 0])
        found.append(np.stack([np.take_along_axis(part, where + j, 1) for j in range(WIDTH)], 1))
    return np.concatenate(most), np.concatenate(found)


def fit_net(texts: Sequence[np.ndarray], label: Sequence[int], seed: int = 7, epochs: int = 8, batch: int = 32) -> ByteNet:
    """Adam on the logistic loss, both labels weighted alike. ``texts`` holds the symbols of each sampled
    document. Without both labels there is nothing to learn and all scores are 0.5."""
    y = np.asarray(label, float)
    if len(y) == 0 or y.min() == y.max():
        return untrained()
    rng = np.random.default_rng(seed)
    share = y.mean()
    value = {
        "filters": rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -0.3),
        "weight": rng.normal(0, 0.3, 2 * FILTERS),
        "intercept": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in value.items()}
    second = {k: np.zeros_like(v) for k, v in value.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            each = [peaks(value["filters"], texts[i]) for i in ids]
            most, there = (np.concatenate(x) for x in zip(*each))
            sizes = np.array([len(x) for x, _ in each])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            doc = np.repeat(np.arange(len(ids)), sizes)
            peak = most + value["bias"]
            active = np.maximum(peak, 0)
            mean, top = np.add.reduceat(active, starts) / sizes[:, None], np.maximum.reduceat(active, starts)
            pooled = np.concatenate([mean, top], 1)
            prob = 1 / (1 + np.exp(-np.clip(pooled @ value["weight"] + value["intercept"], -30, 30)))
            error = (prob - y[ids]) * np.where(y[ids] == 1, 0.5 / share, 0.5 / (1 - share)) / len(ids)
            back = error[:, None] * value["weight"]
            to_chunk = back[doc, :FILTERS] / sizes[doc][:, None] + back[doc, FILTERS:] * (active >= top[doc])
            to_chunk *= peak > 0
            grad = {k: np.zeros_like(v) for k, v in value.items()}
            for j in range(WIDTH):
                np.add.at(grad["filters"][j], (there[:, j], np.arange(FILTERS)), to_chunk)
            grad["bias"] += to_chunk.sum(0)
            grad["weight"] += pooled.T @ error + 1e-3 * value["weight"]
            grad["intercept"] += error.sum()
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                moved = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                value[k] = (value[k] - 0.02 * moved).astype(value[k].dtype)
    return ByteNet(value["filters"], value["bias"], value["weight"], float(value["intercept"][0]))


def train_net(docs: DataFrame, labels: DataFrame, sample_docs: int = 800) -> ByteNet:
    """A net trained on the whole texts of at most ``sample_docs`` rows of each label, those of least hashed
    id; only those texts' symbols reach the driver. An id with several labels counts as the lowest; of
    repeated rows of an id some may fall out of the sample. Without rows of both labels all scores are 0.5."""
    one = (
        labels.where("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    picked = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)]

    @F.pandas_udf("binary")
    def coded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: symbols(t.encode("utf-8", "surrogatepass")).tobytes())

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
        .join(F.broadcast(picked[0].union(picked[1])), "doc_id")
        .select("doc_id", "quality", coded("text").alias("x"))
        .orderBy("doc_id")
        .limit(2 * sample_docs)
        .collect()
    )
    return fit_net([np.frombuffer(r["x"], np.uint16) for r in rows], [r["quality"] for r in rows])


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of each row of ``docs``, from whole texts.

    Null text counts as empty and is scored as one chunk of zeros. Repeated rows and null ids stay as
    they come; very long texts are convolved by segments, whole; an empty table gives no rows; other
    columns are ignored. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        net = shared.value
        return texts.map(lambda t: score_text(net, t)).astype(float)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(whole_text(F.col("text"))).alias("score"))


def op2_quality_cnn(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document; every fourth bucket of ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id").cast("long"), 4) != 2)
    scored = score_documents(docs, train_net(docs, labels))
    held_out = (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
