import random

import numpy as np
import pyarrow.parquet as pq

from graphloom.llm.components import components
from graphloom.llm.count_rtree import RTree, count_vector, link_classes, linked, one_of_each, op5_count_rtree, shingle_set

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """All pairs, by the definition."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    for i, (d, _) in enumerate(docs):
        ids = [e for j, (e, _) in enumerate(docs) if root(j) == root(i) and e is not None]
        yield d, len(sets[i]), min(ids, default=None) if sets[i] else d


def same(found, docs):
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(brute(docs), key=str)


def table(spark, docs):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, component_id int")


def test_small_table(spark):
    docs = [*pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False, name=None)]
    same(op5_count_rtree(spark, SMALL), docs)


def test_large_group_of_near_copies_with_stragglers(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(150):  # copies of the base with more and more edits: some link only by way of others
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        docs.append((i + 10, " ".join(w)))
    chain = list(base)
    for i in range(30):
        chain[(7 * i) % 120] = word()
        docs.append((500 + i, " ".join(chain)))
    docs += [(900 + i, " ".join([*base[:20], *(word() for _ in range(60))])) for i in range(40)]  # a shared passage
    rng.shuffle(docs)
    for unit in (2000, 16):
        same(link_classes(table(spark, docs), unit_size=unit), docs)


def test_edge_cases(spark):
    t = "one two three four five six seven eight nine ten"
    docs = [(3, t), (1, t.upper()), (1, t), (2, t.replace(" ", "\t")), (None, t), (None, "x y"), (None, None), (5, None), (6, ""), (7, " \n"), (8, "x"), (9, "X"), (10, "a b c d"), (11, "a b c d e"), (12, "a " * 30000), (13, "a a a a a")]
    same(link_classes(table(spark, docs)), docs)
    kept = one_of_each(table(spark, docs))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 1, 5, 6, 7, 8, 10, 11, 12]
    assert link_classes(table(spark, [])).count() == 0


def test_tree_misses_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(5, 400), dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < 0.06 * k, rng.integers(0, 2**63, len(base), dtype=np.uint64), base)) for k in range(5)]
    points = np.stack([count_vector(s) for s in sets])
    tree = RTree(points, fan=4)
    passed = 0
    for i, s in enumerate(sets):
        near = set(tree.near(points[i]).tolist())
        passed += len(near)
        assert {j for j, t in enumerate(sets) if linked(len(np.intersect1d(s, t)), len(s), len(t))} <= near
    assert passed < 0.2 * len(sets) ** 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (201, 201)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_short_and_repeated_texts():
    for t in ("", "a", "a b c d", "a b c d e", "a b c d e f", "a " * 50, "A b\tC  d\ne"):
        assert len(shingle_set(t)) == len(shingles(t))
    assert (shingle_set("A b\tC  d\ne f") == shingle_set("a B c d e F")).all()
