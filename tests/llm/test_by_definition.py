"""Scores and verdicts of whole queries against plain second versions."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm import brown_lm, language_mixture, line_crf, quality_cnn
from graphloom.llm.common import bucket_of
from tests.llm.test_brown_lm import words
from tests.llm.test_learned import slow_features

SMALL = "/root/testdata/sf0.001"


def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


TEXTS = texts()


def test_class_bigram_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learn = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    for options in ({}, {"head": 50, "seeds": 20}, {"head": 50, "items": 30, "seeds": 30}):
        model, counts = brown_lm.train_classes(learn, **options)
        v = model.vocabulary
        c = Counter(w for d, t in TEXTS.items() if crc32(str(d).encode()) % 7 != 2 for w in [*words(t), None])
        of = dict(zip(v.words, model.class_of[v.item_of()]))
        of[None] = model.class_of[-1]
        end = v.items + v.endings
        cls = lambda w: of[w] if w in of else model.class_of[end - v.endings + crc32(w[-3:]) % v.endings]
        # the classes' tokens are those of the training rows' words
        tokens = Counter()
        for w, n in c.items():
            tokens[cls(w)] += n
        assert all(model.class_tokens[k] == max(1, tokens[k]) for k in range(len(model.class_tokens)))
        assert np.allclose(model.next_class.sum(1), 1)
        total, distinct = sum(c.values()), len(c)
        for r in brown_lm.score_documents(docs, model, counts).collect():
            before, score = model.class_of[-1], 0.0
            for w in [*words(TEXTS[r.doc_id]), None]:
                now, n = cls(w), c[w]
                plain = (n + 1) / (total + distinct + 1)
                p = model.next_class[before, now] * (1 - model.novel[now]) * n / max(1, tokens[now]) + model.next_class[before] @ model.novel * plain
                score += math.log10(p)
                before = now
            assert r.score == pytest.approx(score)
            assert r.perplexity == pytest.approx(10 ** (-score / r.n_tokens))


def test_exchanging_all_of_the_head_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, held = (docs.where((bucket_of(docs["doc_id"], 7) == 2) == x) for x in (False, True))
    score = []
    for rounds in (0, 1):
        model, counts = brown_lm.train_classes(learn, rounds=rounds)
        score.append(brown_lm.score_documents(held, model, counts).agg({"score": "sum"}).first()[0])
    assert score[1] > score[0]


def test_language_of_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_mixture.train_languages(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))

    def em(p, n, share, steps):
        for _ in range(steps):
            share = [s * sum(m * q[b] / sum(x * y[b] for x, y in zip(share, p)) for b, m in n.items()) / sum(n.values()) for s, q in zip(share, p)]
        share = [s / sum(share) for s in share]
        return share, sum(m * math.log(sum(s * q[b] for s, q in zip(share, p))) for b, m in n.items())

    for r in language_mixture.identify_languages(docs, model).collect():
        text = TEXTS[r.doc_id]
        if len(text) > 1500:
            continue
        n = Counter(language_mixture.trigram_buckets(text, model.bits).tolist())
        every, _ = em(model.p, n, [1 / len(model.p)] * len(model.p), 8)
        order = sorted(range(len(every)), key=lambda i: (-every[i], i))
        best, share = em([model.p[order[0]]], n, [1.0], 0)[1], [1.0]
        for size in range(2, len(order) + 1):
            start = [max(every[i], 1e-3) for i in order[:size]]
            now, likely = em([model.p[i] for i in order[:size]], n, [s / sum(start) for s in start], 5)
            if likely <= best + 3 * math.log(sum(n.values())):
                break
            best, share = likely, now
        top = max(range(len(share)), key=lambda i: share[i])
        assert (r.lang_pred, round(r.score, 6)) == (model.names[order[top]], round(min(1.0, share[top]), 6))


def test_quality_of_short_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = quality_cnn.train_net(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for r in quality_cnn.score_documents(docs, net).collect():
        raw = TEXTS[r.doc_id].encode()
        if len(raw) < 600:
            active = np.maximum(slow_features(net, raw) + net.bias, 0)
            z = [*active.mean(0), *active.max(0)] @ net.weight + net.intercept
            assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_verdict_of_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    field = line_crf.train_field(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for r in line_crf.judge_documents(docs, field).collect():
        counts, features, sizes = line_crf.measure(TEXTS[r.doc_id])
        best = {k: (s, ()) for k, s in enumerate(field.start)}
        for i, x in enumerate(features):
            gain = [float(np.dot(w, x)) for w in field.emission]
            if i:
                best = {k: max(((s + field.transition[j][k], path) for j, (s, path) in best.items()), key=lambda b: b[0]) for k in (0, 1)}
            best = {k: (s + gain[k], (*path, k)) for k, (s, path) in best.items()}
        labels = max(best.values(), key=lambda b: b[0])[1]
        content = sum(n for n, k in zip(sizes, labels) if k == 0)
        assert r.verdict.content_words == content
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r.verdict.kept == (not failed and content >= 0.5 * counts[0])
