"""A training corpus from raw documents: five stages, each by one operator, each on all that the one before it kept.

Every stage bears empty tables, nulls in any column, repeated rows and columns of any name, as its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import _common as C
from tidegate.llm import decontaminate, jaccard_join, langid, packing, secret_scan

#: SQL cannot express mixture inference, tokenizers or edit distance within a text: the stages are tested by brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, or in several; null and empty texts and those without letters go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    Rows are decided one by one, also those that share a doc_id or have none.
    """
    return jaccard_join.one_of_each(docs, k=5, threshold=(4, 5))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, not even with a few edits; null and empty texts and items hold nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kinds; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null text counts as empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what every other stage keeps is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            C.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
