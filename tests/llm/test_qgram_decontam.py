import random

import pyarrow.parquet as pq

from graphloom.llm.qgram_decontam import align, find_items, folded, index_items, matches, without_items

DOCS, BENCH = "doc_id long, text string, item_id string", "item_id long, text string"


def distance_in(item: bytes, text: bytes) -> int:
    """The fewest edits of the item to some part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], [rng.choice("abcxyz")], [s[i], rng.choice("abcxyz")]])
    return "".join(s)


def test_finds_what_the_full_table_finds():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [prose(rng.randint(12, 30)) for _ in range(8)]
    index = index_items([*range(8)], items, 0.05)
    hits = 0
    for _ in range(60):
        i = rng.randrange(8)
        text = prose(30) + " " + edited(rng, items[i], rng.randint(0, 8)) + " " + prose(30)
        found = {}
        for k, start, end, n in matches(index, text):
            found[k] = min(found.get(k, 99), n)
            assert distance_in(folded(items[k]), folded(text)[start:end]) <= n
        for k in range(8):
            true = distance_in(folded(items[k]), folded(text))
            if true <= index.edits[k]:
                hits += 1
                assert found[k] == true
            else:
                assert k not in found
    assert hits > 30


def test_align():
    assert align(b"abcdef", b"xxabcdefyy", 0, 4) == (0, 8)
    assert align(b"abcdef", b"xxabdefyy", 0, 4)[0] == 1


def test_planted_table(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = dict(pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False))
    items = dict(pq.read_table(f"{d}/benchmark.parquet").to_pandas().itertuples(index=False))
    exact = {(k, i) for k, t in texts.items() for i, x in items.items() if folded(x) in folded(t)}
    found = {(r.doc_id, r.item_id) for r in find_items(docs, bench).collect()}
    assert exact <= found
    one = {(r.doc_id, r.item_id) for r in find_items(docs, bench, block_bytes=2000).collect()}
    assert one == found
    kept = {r.doc_id for r in without_items(docs, bench).collect()}
    assert kept == set(texts) - {k for k, _ in found}


def test_edge_cases(spark):
    item = "Some benchmark passage\nwith a number of words in it"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (5, item)], BENCH)
    rows = [(1, f"x {item.upper()} y", "a"), (2, None, None), (3, "", "b"), (None, item, "c"), (4, item, "d"), (4, item, "d"), (5, "z" * 200_000 + item, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((str(r.doc_id), r.item_id, r.start, r.edits) for r in find_items(docs, bench).collect())
    want = [("1", 1, 2, 0), ("4", 1, 0, 0), ("4", 1, 0, 0), ("5", 1, 200_000, 0), ("None", 1, 0, 0)]
    assert found == sorted(want + [(a, 5, c, d) for a, _, c, d in want])
    assert sorted(r.doc_id for r in without_items(docs, bench).collect()) == [2, 3]
    assert without_items(docs, bench).columns == docs.columns
    assert find_items(docs, bench.limit(0)).count() == 0
    assert find_items(docs.limit(0), bench).count() == 0


def places(item, text, share=0.05):
    index = index_items([7], [item], share)
    return sorted(matches(index, text))


def test_short_items_are_found():
    for m in range(1, 20):
        item = "abcdefghijklmnopqrst"[:m]
        assert places(item, "0123456789 " * 3 + item + " 12345") == [(0, 33, 33 + m, 0)]
        assert places(item, "0123456789 " * 3 + item[:-1] + "? 12345") == []
    assert places("", "text") == []
    assert [m[1] for m in places("aa", "aaaa baa")] == [0, 6]
    assert [m[1] for m in places("a", "aaa")] == [0, 1, 2]


def test_one_edit_at_each_place_of_items_about_twenty_bytes():
    for m in range(20, 26):
        item = "abcdefghijklmnopqrstuvwxyz"[:m]
        for i in range(m):
            for changed in (item[:i] + "?" + item[i + 1 :], item[:i] + item[i + 1 :], item[:i] + "?" + item[i:]):
                found = places(item, "0123456789 " + changed + " 0123456789")
                assert len(found) == 1 and found[0][3] == distance_in(item.encode(), changed.encode()) <= 1
        assert places(item, "0123456789 " + item[:3] + "?" + item[4:7] + "?" + item[8:]) == []


def test_long_periodic_texts():
    for item, text in (("-" * 400, "-" * 1_000_000), ("-" * 400, ("-" * 399 + "x") * 100), ("-=" * 150, "x" + "-=" * 20_000 + "x")):
        found = places(item, text)
        assert found and all(n <= 20 and distance_in(item.encode()[:1], text[a:b].encode()) == 0 for _, a, b, n in found)
    exact = places("-" * 400, "a" * 1000 + "-" * 100_000 + "b" * 1000)
    assert any(n == 0 and (a, b) == (1000, 1400) for _, a, b, n in exact)
    assert places("-" * 400, "-" * 379 + "x" * 1000) == []


def test_segments_lose_nothing():
    rng = random.Random(8)
    item = "".join(rng.choices("abcdefgh ", k=300))
    for at in ((1 << 20) - 300, (1 << 20) - 150, (1 << 20) - 5, (1 << 20) + 3):
        text = "z" * at + edited(rng, item, 10) + "z" * 500
        assert {m[0] for m in places(item, text)} == {0}
