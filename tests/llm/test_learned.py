"""The quality network and the language mixtures."""

import numpy as np

from graphloom.llm import language_mixture as lm
from graphloom.llm import quality_cnn as cnn

SMALL = "/root/testdata/sf0.01"


def slow_features(net, raw):
    """Every filter at every position, chunk by chunk."""
    pad = raw + b"\0" * 8
    sym = []
    for i in range(max(len(raw), 1) + cnn.WIDTH - 1):
        b = pad[i] if i < len(pad) else 0
        again = i < len(raw) and any(i - lag >= 0 and (pad + b"\0" * 8)[i : i + 4] == (pad + b"\0" * 8)[i - lag : i - lag + 4] for lag in range(2, cnn.LAGS + 1))
        sym.append(b + 256 * again)
    n = len(sym) - cnn.WIDTH + 1
    resp = np.array([sum(net.filters[j][sym[i + j]] for j in range(cnn.WIDTH)) for i in range(n)])
    halves = [resp[i : i + cnn.HALF].max(0) for i in range(0, n, cnn.HALF)]
    return np.array(halves if len(halves) == 1 else [np.maximum(a, b) for a, b in zip(halves, halves[1:])])


def test_convolution_by_definition():
    rng = np.random.default_rng(0)
    net = cnn.ByteNet(rng.normal(size=(cnn.WIDTH, 512, cnn.FILTERS)).astype(np.float32), rng.normal(size=cnn.FILTERS), rng.normal(size=2 * cnn.FILTERS), 0.1)
    for raw in (b"", b"a", b"abab" * 200, bytes(rng.integers(0, 256, 1500, dtype=np.uint8))):
        assert np.allclose(cnn.chunk_maxima(net, raw), slow_features(net, raw), atol=1e-4)
    long = bytes(rng.integers(97, 123, cnn.SEGMENT + 700, dtype=np.uint8))  # over a segment's end
    assert len(cnn.chunk_maxima(net, long)) == -(-len(long) // cnn.HALF) - 1
    tail = cnn.chunk_maxima(net, long[cnn.SEGMENT - 2 * cnn.HALF :])
    assert np.allclose(cnn.chunk_maxima(net, long)[-len(tail) + 1 :], tail[1:], atol=1e-4)


def test_quality_on_held_out_rows(spark):
    found = {r.doc_id: r for r in cnn.op2_quality_cnn(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    assert len(found) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    held = [(found[r.doc_id].score, r.quality) for r in labels if found[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_edge_cases(spark):
    rows = [(1, None, 0.5), (None, "", 0.5), (2, "x", None), (2, "x", None), (3, "word " * 60_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = cnn.train_net(docs, none)
    assert [r.score for r in cnn.score_documents(docs, net).collect()] == [0.5] * 5
    odd = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert len(cnn.score_documents(docs, cnn.train_net(docs, odd)).collect()) == 5
    assert cnn.score_documents(docs.limit(0), net).count() == 0


def test_languages_on_held_out_rows(spark):
    found = {r.doc_id: r for r in lm.op4_language_mixture(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = [found[r.doc_id].lang_pred == r.lang for r in docs if found[r.doc_id].held_out and r.text]
    assert len(found) == len(docs) and np.mean(held) > 0.97


def test_mixture_proportions():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(300, 0.3), 3)
    n = rng.multinomial(20_000, 0.7 * p[0] + 0.3 * p[2]).astype(float)
    share, _ = lm.mixture(p + 1e-9, n, np.full(3, 1 / 3), 200)
    assert np.allclose(share, [0.7, 0, 0.3], atol=0.02)


def test_language_edge_cases(spark):
    en, de = "the cat and the dog are in the house of the man ", "der hund und die katze sind nicht in dem haus mit "
    rows = [(1, en * 20, "en", "x"), (2, de * 20, "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 34 !?", "de", "x"), (None, en, None, "x"), (6, en * 3 + de, "en", None), (6, en * 3 + de, "en", None), (7, en * 20_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = lm.train_languages(docs)
    assert model.names == ["de", "en"]
    got = sorted(((str(r.doc_id), r.lang_pred) for r in lm.identify_languages(docs, model).collect()))
    assert got == [("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "en"), ("6", "en"), ("7", "en"), ("None", "en")]
    mixed = lm.identify(model, en * 30 + de * 10)
    assert mixed[0] == "en" and 0.6 < mixed[1] < 0.9
    empty = lm.train_languages(docs.limit(0))
    assert empty.names == [] and lm.identify_languages(docs, empty).first().lang_pred == "und"
    assert lm.identify_languages(docs.limit(0), model).count() == 0
