import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm.repeat_suffixes import occurrences, op6_repeat_suffixes, remove_repeats, window_ranks

SMALL = "/root/testdata/sf0.001"


def brute(docs, width=50):
    """By a dictionary of every string's first document."""
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            if doc is not None:
                first[raw[i : i + width]] = min(first.get(raw[i : i + width], doc), doc)
    for doc, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - width + 1):
            if doc is not None and first[raw[i : i + width]] < doc:
                gone[i + 1 : i + 1 + width] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        yield doc, len(raw), kept, int((gone[1:] & ~gone[:-1]).sum())


def same(found, docs, width=50):
    want = sorted(brute(docs, width), key=str)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed)) for r in found.collect()), key=str) == want


def table(spark, docs):
    return spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, kept binary")


def test_small_table(spark):
    docs = [*pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False, name=None)]
    want = {d: (n, hashlib.sha256(k).hexdigest(), s) for d, n, k, s in brute(docs)}
    got = {r.doc_id: (r.n_bytes, r.kept_sha256, r.n_spans) for r in op6_repeat_suffixes(spark, SMALL).collect()}
    assert got == want


def test_edge_cases(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdef é", k=n))
    p = prose(400)
    docs = [
        (5, p),
        (3, p),
        (3, p),  # a repeated row
        (3, "other " + p[100:200] + " text of the same id"),
        (7, "x" + p[50:99] + "y" + p[50:100] + "z"),
        (8, "ab" * 300),
        (9, "ba" * 40 + "c"),
        (10, "q" * 49),
        (11, "q" * 50),
        (12, "q" * 200),
        (13, None),
        (14, ""),
        (None, p),
        (None, None),
        (15, p[:60] + p[:60]),
        (16, "é" * 60 + p[300:]),
    ]
    same(remove_repeats(table(spark, docs)), docs)
    same(remove_repeats(table(spark, docs), 30), docs, 30)
    assert remove_repeats(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(table(spark, docs), 10)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    docs = [(1, long[1_040_000:1_060_000]), (2, long), (3, "zz" + long[1_048_500:1_048_700] + "zz")]
    got = {r.doc_id: (r.n_bytes - len(r.kept), [(s.start, s.end) for s in r.removed]) for r in remove_repeats(table(spark, docs)).collect()}
    assert got == {1: (0, []), 2: (20_000, [(1_040_000, 1_060_000)]), 3: (200, [(2, 202)])}


def test_window_ranks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    starts = np.arange(2900)
    for width in (20, 32, 50):
        rank = window_ranks(data, starts, width)
        texts = [data[s : s + width].tobytes() for s in starts]
        order = {t: i for i, t in enumerate(sorted(set(texts)))}
        assert rank.tolist() == [order[t] for t in texts]


@pytest.mark.parametrize("passes", [1, 3])
def test_any_number_of_passes(spark, passes):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(12)]
    docs = [(rng.randrange(40), " ".join(rng.choices(words, k=rng.randint(0, 120)))) for _ in range(60)]
    docs += docs[:5] + [(41, (docs[7][1] + " ") * 30)]
    same(remove_repeats(table(spark, docs), 24, passes), docs, 24)


def test_occurrences_leave_the_disk(spark):
    """What a pass shuffled is deleted when it ends; only its result stays, until the caller's own action."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {(f.name, f.stat().st_size) for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    before = shuffled()
    remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sum(n for _, n in shuffled() - before) < 100_000


def test_short_texts_together():
    """Texts worked on in a row give what each gives alone."""
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abc", k=rng.choice([0, 3, 49, 50, 51, 300, 70_000]))) for _ in range(60)]
    key, context, at, of = occurrences(texts, 50)
    for i, text in enumerate(texts):
        for got, want in zip((key, context, at), occurrences([text], 50)):
            assert np.array_equal(got[of == i], want)
