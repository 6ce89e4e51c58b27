import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import spelling_trie
from graphloom.llm.spelling_trie import near_pairs, near_words, op13_spelling_trie, roots_of, spelling_groups, units_of, word_counts

SMALL = "/root/testdata/sf0.01"
UPPER = {x: x + 32 for x in range(65, 91)}


def counts_of(docs, misspell=31, least=7):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            if misspell:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % misspell == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    return +counts


def brute_pairs(words):
    """All pairs that one deletion makes equal, or one deletion at the same place of both."""
    cut = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].append((w, i))
    found = set()
    for rest, made in cut.items():
        if rest in words:
            found |= {frozenset((rest, w)) for w, _ in made}
        by_place = defaultdict(set)
        for w, i in made:
            by_place[i].add(w)
        for same in by_place.values():
            found |= {frozenset((a, b)) for a in same for b in same if a < b}
    return found


def brute(counts, factor=10):
    near = defaultdict(set)
    for a, b in map(tuple, brute_pairs(counts)):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= factor * counts[w]:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    counts = {w: n for w, n in counts_of(docs).items() if n >= 2}
    assert rows_of(op13_spelling_trie(spark, SMALL)) == sorted(brute(counts))


@pytest.mark.parametrize("seed", range(20))
def test_trie_of_random_middles(seed):
    rng = random.Random(seed)
    middles, unit = [], []
    for u in range(rng.randint(1, 5)):
        made = {"".join(rng.choices("abÿ"[: rng.randint(1, 3)], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 60))}
        middles += [x.encode("latin-1") for x in made]
        unit += [u] * len(made)
    i, j = near_pairs(middles, np.array(unit))
    found = [(unit[a], frozenset((middles[a].decode("latin-1"), middles[b].decode("latin-1")))) for a, b in zip(i.tolist(), j.tolist())]
    want = {(u, p) for u in set(unit) for p in brute_pairs({m.decode("latin-1") for m, k in zip(middles, unit) if k == u})}
    assert len(found) == len(set(found)) and set(found) == want
    assert all(unit[a] == unit[b] for a, b in zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("most", [2, 10, 10_000])
def test_units_of_any_size_give_all_pairs(spark, most):
    """One prefix has most words; units of few words are cut down to windows of one place."""
    rng = random.Random(most)
    words = {rng.choice(["aaaa", "aaaa", "b"]) + "".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(700)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = near_words(table, most=most).collect()
    assert len(pairs) == len({(r.word, r.near) for r in pairs})
    found = {frozenset((r.word, r.near)) for r in pairs}
    assert found == brute_pairs(words) and len(pairs) == 2 * len(found)
    sizes = Counter(r.unit for r in units_of(table, 7, most).collect())
    places = {u: int(u.split("|")[0].split(":")[2]) - int(u.split("|")[0].split(":")[1]) for u in sizes}
    assert all(n <= most or places[u] <= 1 for u, n in sizes.items())


def test_forms_lead_to_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)] + [("x", None), ("y", "x")]
    found = {r.word: r.root for r in roots_of(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {f"w{i}": "w9" for i in range(10)} | {"x": "x", "y": "x"}


def test_odd_tables(spark, monkeypatch):
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long_ = "spelling" * 250 + " " + "spelling" * 249 + "speling"
    docs = [(None, "Spelling spelling SPELLING speling"), (1, None), (2, ""), (3, "spelling " * 30 + "speling-spellinG"), (3, "spelling " * 30 + "speling-spellinG")]
    docs += [(4, long_), (4, long_), (5, "Àÿéabcd Àÿéabcd xāspellingx")]
    table = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, n int, word string")
    monkeypatch.setattr(spelling_trie, "SEGMENT", 50)
    for misspell in (None, 31, 1):
        counts = {w: n for w, n in counts_of(docs, misspell).items() if n >= 2}
        assert rows_of(spelling_groups(table, misspell=misspell)) == sorted(brute(counts))


def test_counts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling_trie, "HELD", 3)
    docs = [(i, " ".join(f"letters{chr(97 + (i + k) % 26)}" for k in range(9))) for i in range(50)]
    found = {r.word: r.n for r in word_counts(spark.createDataFrame(docs, "doc_id long, text string"), misspell=31).collect()}
    assert found == dict(counts_of(docs))
