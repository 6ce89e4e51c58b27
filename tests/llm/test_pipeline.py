import os

import numpy as np

import corpus_pipeline
from graphloom.functions.tables import shared_dir
from graphloom.llm.count_rtree import one_of_each
from graphloom.llm.line_crf import judge_text, train_field
from tests.llm.test_count_rtree import brute as brute_classes
from graphloom.llm.qgram_decontam import without_items
from tests.llm.test_short_runs import brute as brute_lines
from tests.llm.test_qgram_decontam import folded

SMALL = "/root/testdata/sf0.001"


def holds(text, item):
    """Whether some place of the text is within one edit in 20 bytes of the item: the whole table of distances.
    Such a place shares one of the pieces that so many edits leave, of 12 bytes at least here."""
    if not any(item[i : i + 12] in text for i in range(len(item) - 11)):
        return False
    data, row = np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(row))
    for c in item:
        below = np.append(row[0] + 1, np.minimum(row[:-1] + (data != c), row[1:] + 1))
        row = np.minimum.accumulate(below - step) + step
    return row.min() <= int(0.05 * len(item))


def test_stages_by_brute_force(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    every = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [folded(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    field = train_field(every, spark.read.parquet(f"{SMALL}/labels.parquet"))
    docs = [(r.doc_id, r.text) for r in every.select("doc_id", "text").collect()]
    docs = [d for d in docs if judge_text(field, d[1], 0.5)[6]]
    docs = [d for d in brute_lines(docs) if d[1].encode().split()]
    docs = [d for d, c in zip(docs, brute_classes(docs)) if c[2] == d[0]]
    clean = [d for d in docs if not any(holds(folded(d[1]), i) for i in items)]
    found = {r.doc_id: (r.token_ids, r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect()}
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert found == {d: (coder.encode(t, add_special_tokens=False).ids, t) for d, t in clean}
    left = [x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("pipeline-")]
    assert all(os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{x}") == ["3"] for x in left)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, SMALL).count() == 0


def test_rows_of_one_id_go_by_their_texts(spark):
    """A clean row stays beside a hit of the same doc_id, null or not; of equal rows one stays."""
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch from the tower."
    clean = ["Nothing of that kind is in here at all, as far as anybody could ever tell.", "Some other words that belong to no benchmark whatsoever, none."]
    rows = [(None, f"so {item} yes"), (None, clean[0]), (None, clean[1]), (7, f"and {item}"), (7, clean[0] + " Seven."), (8, clean[1] + " Eight more words follow here: a b c d e."), (8, clean[1] + " Eight more words follow here: a b c d e.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key_doc string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert text(without_items(docs, benchmark)) == sorted((r for r in rows if item not in r[1]), key=str)
    once = one_of_each(docs.where("doc_id = 8 or doc_id is null").union(docs.where("doc_id is null")))
    assert once.columns == docs.columns
    assert text(once) == sorted({r for r in rows if r[0] in (8, None)}, key=str)
