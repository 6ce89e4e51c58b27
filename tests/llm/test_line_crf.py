from itertools import product
from zlib import crc32

import numpy as np
import pytest

from graphloom.llm.line_crf import FEATURES, LineField, fit_field, judge_documents, keep_documents, measure, op10_line_crf, train_field, viterbi

SMALL = "/root/testdata/sf0.01"


def brute_counts(text):
    words = (text or "").encode().split()
    lines = (text or "").split("\n")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    dups = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit)]


def test_counts():
    for t in ("", "a", "a b c d e a b c d e", "x " * 30, "a\n\na\n b\n b", "é|é <b> #*$%&", "a b c d e f g\nb c d e f\x0bg h i", "\t \n"):
        assert measure(t)[0] == brute_counts(t)


def path_score(field, x, y):
    total = field.start[y[0]]
    for i, label in enumerate(y):
        total += float(np.dot(field.emission[label], x[i])) + (field.transition[y[i - 1]][label] if i else 0)
    return total


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        field = LineField(rng.normal(size=(2, len(FEATURES))).tolist(), rng.normal(size=(2, 2)).tolist(), rng.normal(size=2).tolist())
        x = rng.integers(0, 2, (n, len(FEATURES)))
        best = max(path_score(field, x, y) for y in product((0, 1), repeat=n))
        assert path_score(field, x, viterbi(field, x.tolist())) == pytest.approx(best)


def test_training_separates():
    good = [np.eye(len(FEATURES), dtype=np.float32)[[0] * 5] for _ in range(40)]
    bad = []
    for _ in range(20):
        x = np.eye(len(FEATURES), dtype=np.float32)[[0] * 6]
        x[2:5, 2] = 1
        bad.append(x)
    field = fit_field(good + bad, [True] * 40 + [False] * 20)
    assert viterbi(field, bad[0].astype(int).tolist())[2:5] == [1, 1, 1]
    assert viterbi(field, good[0].astype(int).tolist()) == [0] * 5
    assert fit_field([], []) == fit_field(good, [True] * 40) == LineField.untrained()


def test_table_and_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = {r.doc_id: r for r in op10_line_crf(spark, SMALL).collect()}
    assert set(found) == set(texts)
    for d, r in found.items():
        if len(texts[d]) < 4000:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_counts(texts[d])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    q = {r.doc_id: r.quality for r in labels.collect()}
    learn = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    field = train_field(docs, learn)
    held = [r for r in judge_documents(docs, field).collect() if r.doc_id in q and crc32(str(r.doc_id).encode()) % 2]
    good, bad = ([r for r in held if q[r.doc_id] == k and not r.verdict.base_failed] for k in (1, 0))
    assert sum(r.verdict.kept for r in good) / len(good) > 0.97
    assert sum(r.verdict.kept for r in bad) / len(bad) < 0.3


def test_edge_cases(spark):
    rows = [(1, None, True), (None, "", True), (2, "w " * 9, True), (3, " ".join(f"w{i}" for i in range(30)), None), (3, " ".join(f"w{i}" for i in range(30)), None), (4, "\n" * 5000 + "a", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, verdict boolean")
    kept = keep_documents(docs, LineField.untrained())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3]
    assert keep_documents(docs.limit(0), LineField.untrained()).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert train_field(docs, nothing) == LineField.untrained()
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert isinstance(train_field(docs, odd), LineField)
