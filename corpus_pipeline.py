"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import delete, scratch, shared_dir, table
from graphloom.llm.count_rtree import one_of_each
from graphloom.llm.line_crf import keep_documents, train_field
from graphloom.llm.line_runs import dedup_lines
from graphloom.llm.qgram_decontam import without_items
from graphloom.llm.trie_bpe import encode_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# In each stage: a null text counts as an empty one; rows of null doc_id and repeated rows are rows like others; columns
# beside doc_id and text, whatever their names, stay as they are; an empty table gives no rows; texts are worked on whole.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field keeps; it learns from the labelled ones among all ``documents``. Of texts
    without ten words none stays, null and empty ones included. A row's verdict depends on its text alone, so
    repeated rows stay or go together; between two labellings of equal weight lines count as content."""
    return keep_documents(docs, train_field(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of ten words, or of shorter ones that two documents hold; those that lose every line with a word go, and those that
    have none. Of equal runs the one of smallest doc_id stays (null first), then of smallest text hash and line;
    repeated rows are one document and stay together."""
    return dedup_lines(docs, min_docs=2).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest doc_id; rows of null doc_id go where a
    row with an id stays, else that of smallest text hash stays. Rows of the same doc_id and group stay together, but
    of rows of the same doc_id and text one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of the same doc_id stay or go by their own texts."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and the decoded text of each row that is left."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL expresses none of the field, the near-duplicate classes and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to token ids. What a stage wrote is deleted once the next has read it; only
    the last one's input stays, which the result reads."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
