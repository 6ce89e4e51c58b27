"""Quality rules by line sequence labelling.

A linear-chain conditional random field over a document's lines, with the labels content and
boilerplate, is decoded by Viterbi; the share of words in content lines decides whether the document
stays. Before it come plain counts (words, symbols, duplicate lines, repeated five-word windows), of
which too few words or too many repeated ones reject a document at once.

The field is trained on a bounded sample of documents with a quality label. Lines have no labels of
their own, so training alternates: lines of good documents are content; lines of bad ones start as
boilerplate, and those that the trained field finds to be content are relabelled, the least content-like
line of each bad document excepted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import chain
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_SPACE, table, whole_text

#: What the contract counts as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
FEATURES = ("always", "capitals", "symbols", "bars", "shouts", "stutters", "seen", "blank", "short", "unended", "long_words")
CONTENT, BOILERPLATE = 0, 1

VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_words long, line_labels array<tinyint>"
)


class LineField(NamedTuple):
    """Weights of the field: emission[label][feature], transition[from][to], and the start's."""

    emission: list[list[float]]
    transition: list[list[float]]
    start: list[float]

    @classmethod
    def untrained(cls) -> LineField:
        """Every line is content."""
        return cls([[1.0] + [0.0] * (len(FEATURES) - 1), [0.0] * len(FEATURES)], [[0.0, 0.0]] * 2, [0.0, 0.0])


def among(data: bytes, drop: bytes) -> int:
    """How many of the bytes are among ``drop``."""
    return len(data) - len(data.translate(None, drop))


def line_features(line: str, words: list[bytes], seen: bool) -> list[int]:
    """The line's 0/1 features, in the order of FEATURES. ``words`` are the line's, as UTF-8."""
    n, raw = len(words), b" ".join(words)
    letters = among(raw, LETTERS)
    return [
        1,
        int(letters >= 4 and 2 * among(raw, UPPER) > letters),
        int(40 * among(raw, SYMBOLS) > len(raw)),
        int(raw.count(b"|") >= 2),
        int(4 * raw.count(b"!!") > n > 0),
        int(n > 3 and 4 * sum(map(eq, words, words[1:])) > n),
        int(seen and n > 0),
        int(n == 0),
        int(0 < n < 4),
        int(n > 0 and raw[-1:] not in b".!?"),
        int(n > 0 and len(raw) > 14 * n),
    ]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    grams = [*zip(*(words[i:] for i in range(width)))]
    if len(set(grams)) == len(grams):
        return 0
    count, covered, last = Counter(grams), 0, -1
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += min(width, i + width - 1 - last)
            last = i + width - 1
    return covered


def measure(text: str) -> tuple[list[int], list[list[int]], list[int]]:
    """The counts of VERDICT up to n_repeat_words, the features of each line, and each line's words."""
    features, sizes, every, seen, dups = [], [], [], set(), 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        again = line in seen
        dups += again and bool(words)
        features.append(line_features(line, words, again))
        sizes.append(len(words))
        every += words
        seen.add(line)
    symbols = sum(text.count(chr(c)) for c in SYMBOLS)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    return [len(every), chars, symbols, dups, repeated_words(every)], features, sizes


def viterbi(field: LineField, features: Sequence[Sequence[int]]) -> list[int]:
    """The most likely labels; content where two paths tie."""
    (w0, w1), ((t00, t01), (t10, t11)) = field.emission, field.transition
    back: list[tuple[int, int]] = []
    a, b = field.start
    for n, x in enumerate(features):
        e0 = sum(w for w, f in zip(w0, x) if f)
        e1 = sum(w for w, f in zip(w1, x) if f)
        if n:
            from0, from1 = int(b + t10 > a + t00), int(b + t11 > a + t01)
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01)
        a, b = a + e0, b + e1
    labels = [int(b > a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def judge_text(field: LineField, text: str, least_share: float) -> tuple:
    """The fields of VERDICT."""
    counts, features, sizes = measure(text)
    n_words, repeats = counts[0], counts[4]
    failed = n_words < 10 or 100 * repeats > 20 * n_words
    labels = viterbi(field, features)
    content = sum(n for n, label in zip(sizes, labels) if label == CONTENT)
    return (*counts, failed, not failed and content >= least_share * n_words, content, labels)


def fit_field(sequences: Sequence[np.ndarray], good: Sequence[bool], rounds: int = 3, steps: int = 50) -> LineField:
    """Maximum likelihood by Adam, in ``rounds`` of labelling and training.

    ``sequences`` holds a (lines, features) array for each sampled document. Without documents of both
    kinds there is nothing to learn and every line is content.
    """
    if not sequences or all(good) or not any(good):
        return LineField.untrained()
    x = np.concatenate(sequences).astype(np.float32)
    sizes = np.array([len(s) for s in sequences])
    starts = np.cumsum(sizes) - sizes
    y = np.where(np.repeat(good, sizes), CONTENT, BOILERPLATE)
    field = LineField.untrained()
    for _ in range(rounds):
        field = _train(x, starts, y, steps)
        w = np.array(field.emission)
        for i in np.flatnonzero(~np.asarray(good)):
            own = slice(starts[i], starts[i] + sizes[i])
            y[own] = viterbi(field, sequences[i])
            y[starts[i] + int(np.argmax(x[own] @ (w[1] - w[0])))] = BOILERPLATE
    return field


def _products(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each line the product, in logarithms, of its sequence's 2 x 2 matrices up to its own; ``place`` is
    the line's place in its sequence. Doubling the reach each time takes log2(longest) steps."""
    reach = 1
    while reach <= place.max():
        i = np.flatnonzero(place >= reach)
        a, b = m[i - reach], m[i]
        m = m.copy()
        m[i] = np.logaddexp(a[:, :, :1] + b[:, None, 0], a[:, :, 1:] + b[:, None, 1])
        reach *= 2
    return m


def _train(x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int, decay: float = 1e-3) -> LineField:
    """``x`` and ``y`` hold the lines of all documents in a row; ``starts`` is where each document begins."""
    n, width = x.shape
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    to_end = np.repeat(sizes, sizes) - 1 - place
    later = np.flatnonzero(place > 0)
    hot = np.eye(2)[y]
    both = np.einsum("na,nb->ab", hot[later - 1], hot[later])
    theta = np.zeros(2 * width + 4 + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t, start = theta[: 2 * width].reshape(2, width), theta[2 * width : -2].reshape(2, 2), theta[-2:]
        e = x @ w.T
        m = t + e[:, None, :]
        m[starts] = (start + e[starts])[:, None, :]
        forward = _products(m, place)[:, 0]
        # the same from each sequence's end, with the matrices turned over
        behind = _products(np.swapaxes(m, 1, 2)[::-1], to_end[::-1])[::-1]
        backward = np.zeros((n, 2))
        backward[later - 1] = np.logaddexp(behind[later, 0], behind[later, 1])
        total = np.repeat(np.logaddexp(*forward[starts + sizes - 1].T), sizes)
        state = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[later - 1, :, None] + t + (e + backward)[later, None] - total[later, None, None])
        lack = hot - state
        gradient = np.concatenate([(lack.T @ x).ravel(), (both - pair.sum(0)).ravel(), lack[starts].sum(0)])
        gradient = gradient / max(1, n) - decay * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.2 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineField(
        theta[: 2 * width].reshape(2, width).tolist(), theta[2 * width : -2].reshape(2, 2).tolist(), theta[-2:].tolist()
    )


def train_field(docs: DataFrame, labels: DataFrame, sample_docs: int = 1200) -> LineField:
    """A field trained on all lines of at most ``sample_docs`` labelled documents, those of least hashed id.
    Only their line features reach the driver. An id with several labels counts as the lowest; of repeated
    rows of an id some may fall out of the sample."""
    chosen = (
        labels.where("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )

    @F.pandas_udf("binary")  # a byte for each feature of each line
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bytes(chain.from_iterable(measure(t)[1])))

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", features("text").alias("x"))
        .orderBy("doc_id")
        .limit(sample_docs)
        .collect()
    )
    lines = [np.frombuffer(r["x"], np.uint8).reshape(-1, len(FEATURES)) for r in rows]
    return fit_field(lines, [r["quality"] == 1 for r in rows])


def judge_documents(docs: DataFrame, field: LineField, least_share: float = 0.5, name: str = "verdict") -> DataFrame:
    """``docs`` with one more column, a struct with the fields of VERDICT.

    ``line_labels`` marks each line 0 (content) or 1 (boilerplate); content where two paths tie. Null text
    counts as empty: one blank line, no words, base_failed. Very long texts are labelled whole. Rows stay as
    they come, repeated ones too; an empty table gives no rows; a column that is called ``name`` is replaced, so
    callers with such a column pass another. One pass, no shuffle.
    """
    columns = [c.split()[0] for c in VERDICT.split(", ")]

    @F.pandas_udf(VERDICT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(field, t, least_share) for t in texts], columns=columns)

    return docs.withColumn(name, judged(whole_text(F.col("text"))))


def keep_documents(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with its columns as they were."""
    name = "verdict"
    while name in docs.columns:
        name += "_"
    judged = judge_documents(docs, field, least_share, name)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def op10_line_crf(spark, sf_dir: str) -> DataFrame:
    """The counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    field = train_field(docs, table(spark, sf_dir, "labels"))
    judged = judge_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), field)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[f"verdict.{c}" for c in counts])

