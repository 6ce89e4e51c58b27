"""Language identification by multilingual mixtures.

A document's hashed byte trigrams are a mixture of the languages' trigram distributions.
Expectation-maximisation estimates the proportions; the set of languages grows from the largest
proportion down as long as a likelihood penalised for its size grows. The language of largest
proportion in the chosen set is the prediction.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bucket_of, table, whole_text

#: Letters tell languages apart: other ASCII bytes count as space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}").search


def trigram_buckets(text: str, bits: int) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)
    b = b.astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


class LanguageModel(NamedTuple):
    """Trigram distributions: ``p[i]`` is that of ``names[i]``."""

    names: list[str]
    p: np.ndarray
    bits: int


def train_languages(docs: DataFrame, bits: int = 15) -> LanguageModel:
    """Counts over all rows of ``docs`` with a text and a lang. What reaches the driver is one count for
    each language and bucket."""

    def count(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << bits, np.int64))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums[lang] += np.bincount(trigram_buckets(text, bits), minlength=1 << bits)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                names=["lang", "bucket", "n"],
            )

    rows = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    found = (
        rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toPandas()
    names = sorted(found["lang"].unique())
    n = np.zeros((len(names), 1 << bits))
    n[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    n += 0.5
    return LanguageModel(names, n / n.sum(1, keepdims=True), bits)


def mixture(p: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions after ``steps`` of expectation-maximisation from ``share``, and the log-likelihood."""
    weight = n / n.sum()
    for _ in range(steps):
        share = share * (p @ (weight / (share @ p)))
    return share / share.sum(), float(n @ np.log(share @ p))


def identify(model: LanguageModel, text: str, penalty: float = 3.0) -> tuple[str, float]:
    """The language of largest proportion in the chosen set, and its proportion; ``und`` and 0 without a
    letter or without a model. A language more must raise the log-likelihood by ``penalty`` x ln(trigrams).
    Ties go to the first name."""
    if not model.names or not _LETTER(text):
        return "und", 0.0
    at, n = np.unique(trigram_buckets(text, model.bits), return_counts=True)
    p, n = model.p[:, at], n.astype(float)
    every, _ = mixture(p, n, np.full(len(p), 1 / len(p)), 8)
    order = np.argsort(-every, kind="stable")
    best, share = float(n @ np.log(p[order[0]])), np.ones(1)
    for size in range(2, len(order) + 1):
        part = order[:size]
        now, likely = mixture(p[part], n, np.maximum(every[part], 1e-3) / np.maximum(every[part], 1e-3).sum(), 5)
        if likely <= best + penalty * np.log(n.sum()):
            break
        best, share = likely, now
    top = int(np.argmax(share))
    return model.names[order[top]], float(min(1.0, share[top]))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``, from whole texts.

    Null or letterless text: ``und``, 0. Repeated rows and null ids stay as they come; other columns are
    ignored. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**bits numbers

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([identify(model, t) for t in texts], columns=["lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predicted(whole_text(F.col("text"))).alias("found"))
    return rows.select("doc_id", "found.lang_pred", "found.score")


def op4_language_mixture(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document; every fourth bucket of ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    found = identify_languages(docs, model)
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
