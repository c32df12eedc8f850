"""The corpus pipeline: documents pass through the stages in order, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last return the
columns of ``documents``.

Defined cases: a null or empty text passes the classifier, and is one document an id; a row without an id is no
duplicate and is packed with a null id; of repeated rows the second stage leaves one; an empty table stays empty; further
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docengine.llm import jaccard, mixing, packing, pii, quality
from docengine.llm.queries import TARGETS, domains_of, table, tokenizer_path
from docengine.llm.store import Store, scope


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier, fitted on these, rejects."""
    return quality.keep_good(docs, quality.fit(docs))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return jaccard.keep_first(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix asks for."""
    return mixing.mix(docs, domains_of(table(spark, sf_dir, "labels")), TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, ids included."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", first_of_group),
    ("pii", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express training, tokenising or iteration; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``.  What a stage has kept is deleted when the next has read it, and a
    stage's own tables when it is done; the last but one's stay, as the result reads them."""
    store, docs, before = Store(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = store.put(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
