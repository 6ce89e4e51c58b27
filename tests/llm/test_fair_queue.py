import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from graphloom.llm import spread
from graphloom.llm.fair_queue import mix, op12_fair_queue
from graphloom.llm.spread import join_by_frequency, running_sums

SMALL = "/root/testdata/sf0.01"


def brute(docs, weights=(5, 2, 1), passes=3):
    """Serves the documents one by one."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    own = defaultdict(list)
    for k, d in enumerate(docs):
        own[d[2]].append(k)
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[k] for k in own[s]) for s in names}
    budget, weight, full = sum(size), {s: weights[i % len(weights)] for i, s in enumerate(names)}, set()
    while True:
        rest = [s for s in names if s not in full]
        level = Fraction(budget - sum(passes * total[s] for s in full), sum(weight[s] for s in rest)) if rest else 0
        over = {s for s in rest if weight[s] * level > passes * total[s]}
        if not over:
            break
        full |= over
    target = {s: passes * total[s] if s in full else float(level) * weight[s] for s in names}
    queue = []
    for number, s in enumerate(names):
        key = lambda k: (int(hashlib.md5(f"{'' if docs[k][0] is None else docs[k][0]}|{hashlib.md5((docs[k][1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16), docs[k][0] is not None, docs[k][0] or 0, size[k])
        done = 0
        for _ in range(passes):
            for k in sorted(own[s], key=key):
                if size[k]:
                    done += size[k]
                    queue.append((done / target[s], number, done, k))
    taken, served = [0] * len(docs), 0
    for *_, k in sorted(queue):
        if served + size[k] > budget:
            break
        served += size[k]
        taken[k] += size[k]
    return [(d[0], n, total[d[2]], round(float(target[d[2]]), 6), t) for d, n, t in zip(docs, size, taken)]


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = rows_of(op12_fair_queue(spark, SMALL))
    assert found == sorted(brute(docs), key=repr)
    assert all(t <= 3 * n for _, n, _, _, t in found)


@pytest.mark.parametrize("seed", range(3))
def test_skewed_sources(spark, seed, monkeypatch):
    """A source with most rows, tiny ones that are taken three times, empty ones, and null names and ids."""
    monkeypatch.setattr(spread, "FREQUENT", 4)
    rng = random.Random(seed)
    docs = [(rng.choice([None, i]), rng.choice([None, "", "a " * rng.randint(1, 40), "b\x0bc d"]), rng.choice(["big"] * 9 + ["", None, "é", "z", "Z", f"s{i % 7}"])) for i in range(400)]
    docs += docs[:30] + [(1000 + i, None, "none") for i in range(3)] + [(2000, "x " * 5000, "big")]
    wide = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, source string, size int, name string")
    found = rows_of(mix(wide))
    assert found == sorted(brute(docs), key=repr)
    assert rows_of(mix(wide.repartition(13))) == found
    sources = defaultdict(lambda: [0, 0.0, 0])
    for r in mix(wide).collect():
        sources[r.source][0] += r.taken
        sources[r.source][1] = r.target
        sources[r.source][2] = max(sources[r.source][2], r["size"])
    longest = max(n for _, _, n in sources.values())
    assert all(abs(taken - target) <= n + longest for taken, target, n in sources.values())


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert rows_of(mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert rows_of(mix(spark.createDataFrame([(1, "a b", None)], schema))) == [(1, 2, 2, 2.0, 2)]
    assert rows_of(mix(spark.createDataFrame([(1, "a " * 300_000, "a"), (2, "b", "b")], schema))) == sorted(brute([(1, "a " * 300_000, "a"), (2, "b", "b")]), key=repr)


def test_sums_carry_over_ranges(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 50) g", "id % 977 o", "id", "id % 11 v").repartition(9)
    found = {r.id: r.s for r in running_sums(rows, ["g"], ["o", "id"], "v", "s").collect()}
    sums = defaultdict(int)
    for i in sorted(range(5000), key=lambda i: (0 if i % 3 == 0 else i % 50, i % 977, i)):
        g = 0 if i % 3 == 0 else i % 50
        sums[g] += i % 11
        assert found[i] == sums[g]


def test_join_by_frequency_is_a_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 0, id % 100) k", "id")
    keyed = spark.range(90).selectExpr("id k", "if(id = 0, 2000, 10) n", "id * 2 x")
    assert sorted((r.id, r.x) for r in join_by_frequency(rows, keyed, ["k"], "n", 3000).collect()) == sorted((r.id, r.x) for r in rows.join(keyed, "k").collect())
