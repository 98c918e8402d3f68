"""The corpus pipeline: documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblens.llm.common import materialize, read_table
from weblens.llm.decontaminate import without_leaks
from weblens.llm.mixing import mixed_documents
from weblens.llm.near_dedup import one_of_each
from weblens.llm.quality import good_documents, train_quality
from weblens.llm.token_output import token_index


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good."""
    return good_documents(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


#: Similarity of near-duplicates, in hundredths. op8_near_dedup has its own.
NEAR_PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return one_of_each(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document, repeats written out."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files that it writes: doc_id, start, n_tokens, ids_crc32, file."""
    return token_index(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned scores and pseudorandom draws have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
