"""The corpus pipeline: stages over documents, each written as Parquet before the next reads it.

Edge cases: an empty table gives an empty result at every stage. Null and empty
texts have no words, so the first stage rejects them; given to a later one,
null counts as empty for classes, sizes and tokens and stays null in the text.
Of repeated rows the second stage keeps one. Null sources are a source of their
own. All columns of documents, others than the usual ones too and whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import cluster, mixing, ngram_join, packing, pii, weak_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' posterior says good; the others go."""
    return weak_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and similar texts, that of least doc_id."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come to their targets."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Expectation-maximisation, clusters and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = cluster.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cluster.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
