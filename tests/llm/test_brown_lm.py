import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm.brown_lm import exchange_clusters, op1_brown_lm, score_documents, train_classes

SMALL = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def test_base_by_brute_force(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = lambda d: crc32(str(d["doc_id"]).encode()) % 7 == 2
    c = Counter()
    for d in docs:
        if not held(d):
            c.update([*words(d["text"]), None])
    n, v = sum(c.values()), len(c)
    found = {r.doc_id: r for r in op1_brown_lm(spark, SMALL).collect()}
    assert len(found) == len(docs)
    better = 0.0
    for d in docs:
        r, t = found[d["doc_id"]], [*words(d["text"]), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(d), len(t), n)
        assert r.n_known == sum(c[x] > 0 for x in t)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        better += (r.score - r.base_score) * r.held_out
    assert better > 0


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, word string, n long")


def test_probabilities_sum_to_one_and_edge_cases(spark):
    data = [(1, "a b a c", "x", 1), (2, "b a", "x", 1), (3, "A\tb\n b", None, None), (4, None, "x", 1), (None, "", "x", 1), (2, "b a", "x", 1)]
    docs = rows(spark, data)
    model, counts = train_classes(docs, head=2, items=1, endings=3, classes=4)
    ask = [(i, w, "x", 1) for i, w in enumerate(["a", "b", "c", "unknown", None, "b " * 5000])] + [(None, "b a", "x", 1)] * 2
    got = score_documents(rows(spark, ask), model, counts).collect()
    assert len(got) == len(ask)
    by = {r.doc_id: r for r in got}
    assert by[4].n_tokens == 1 and by[4].n_known == 1 and by[5].n_tokens == 5001
    assert by[3].n_known == 1 and math.isfinite(by[3].score)
    # the first token's probabilities: a text of one word less the end after it
    v = model.vocabulary
    cls = model.class_of
    first, spread = model.next_class[cls[-1]], v.tokens + v.distinct + 1
    total = 0.0
    seen = Counter(x for d in data for x in words(d[1]))
    of = {w: cls[i] for w, i in zip(v.words, v.item_of())}
    for w, c in [*seen.items(), (None, len(data))]:
        k = cls[-1] if w is None else of.get(w, cls[min(v.items, len(v.words)) + crc32(w[-3:]) % v.endings])
        total += first[k] * (1 - model.novel[k]) * c / model.class_tokens[k] + first @ model.novel * (c + 1) / spread
    assert 0.5 < total + first @ model.novel / spread <= 1 + 1e-9


def test_empty_tables(spark):
    none = rows(spark, [])
    model, counts = train_classes(none)
    assert score_documents(none, model, counts).count() == 0
    one = score_documents(rows(spark, [(1, "a b", "x", 1)]), model, counts).first()
    assert (one.n_tokens, one.n_known, one.base_score) == (3, 0, 0.0)


def test_exchange_finds_alternating_classes():
    # items 0-3 follow items 4-7 and the other way round; 8 ends texts
    n = np.zeros((9, 9))
    n[:4, 4:8] = n[4:8, :4] = 10
    n[8, 0] = n[7, 8] = 2
    of = exchange_clusters(n, 3, rounds=10)
    assert len({*of[:4]}) == len({*of[4:8]}) == 1 and of[0] != of[4] and of[8] == 2


def test_more_classes_than_a_byte_holds():
    with pytest.raises(ValueError, match="300 classes"):
        train_classes(None, classes=300)
