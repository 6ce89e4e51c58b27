"""Nulls, repeated rows, very long texts and clashing columns, through single operators and the pipeline's stages."""

import corpus_pipeline
from graphloom.llm import language_mixture as lm
from graphloom.llm.line_runs import dedup_lines, repeated_runs
from graphloom.llm.trie_bpe import encode_documents

SMALL = "/root/testdata/sf0.001"


def test_letters_are_unicode_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = lm.train_languages(docs)
    for text in ("½", "²", "Ⅷ", "①", "12 ٣ !?", "_"):
        assert lm.identify(model, text) == ("und", 0.0)
    assert lm.identify(model, "ª")[0] != "und" and lm.identify(model, "é")[0] != "und"


def test_one_word_without_a_break(spark):
    import public_tokenizers

    texts = ["a" * 50_000, "xyz" * 9000, "é" * 5000]
    docs = spark.createDataFrame([(i, t, [0], "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids array<int>, decoded string")
    found = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.decoded for r in found} == dict(enumerate(texts))


def test_lines_with_clashing_columns_and_a_long_line(spark):
    long = "w " * 200_000
    rows = [(1, f"{long}\nx", 1, "a", [1]), (2, f"y\n{long}", 2, "b", None), (3, "", 3, "c", None), (4, None, 4, "d", None), (3, "", 3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line int, f_text_key string, f_marks array<int>")
    found = dedup_lines(docs, min_docs=2, count="lost")
    assert found.columns == [*docs.columns, "lost"]
    got = sorted(((r.doc_id, r.text, r.line, r.lost) for r in found.collect()), key=str)
    assert got == sorted([(1, f"{long}\nx", 1, 0), (2, "y", 2, 1), (3, "", 3, 0), (3, "", 3, 0), (4, None, 4, 0)], key=str)


def test_every_stage_takes_odd_rows(spark):
    prose = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if r.text and 300 < len(r.text) < 3000][:12]
    rows = [(i, t, "a", i, "b") for i, t in enumerate(prose)]
    rows += [(0, prose[0], "a", 0, "b"), (None, prose[1], None, None, None), (None, None, "a", 1, "b"), (50, None, None, None, "b"), (51, "", "a", None, None)]
    rows += [(52, prose[2] + " and so on", "a", 1, "b"), (53, "long " * 60_000, "a", 1, "b"), (None, "only here " + prose[3][::-1], "a", 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, verdict int, component string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        kept = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality rules":
            assert not {(None, None), (50, None), (51, "")} & set(kept) and kept.count((0, prose[0])) in (0, 2)
        elif name == "n-gram Jaccard join":
            ids = [k for k, _ in kept]
            assert 52 not in ids and ids.count(0) == 2 and (None, prose[1]) not in kept and (None, "only here " + prose[3][::-1]) in kept
            assert {(None, None), (50, None), (51, "")} <= set(kept)
        elif name == "benchmark decontamination":
            assert (53, "long " * 60_000) in kept and (51, "") in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


def test_maximal_runs(spark):
    long = [f"line {i} with a few words" for i in range(6)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["own", *long[1:3], "", *long[3:5], "own too", long[0]])), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in repeated_runs(docs).collect())
    assert found == [(2, 1, 5, 4, 24)]
    assert sorted(tuple(r) for r in repeated_runs(docs, min_docs=2).collect()) == [(2, 1, 5, 4, 24), (2, 7, 7, 1, 6)]
    assert repeated_runs(docs.limit(0)).count() == 0
