"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from weblens.llm.common import read_table
from weblens.llm.decontaminate import contaminated
from weblens.llm.exact_dedup import exact_groups
from weblens.llm.html_extract import extract_pages
from weblens.llm.langid import detect_language, train_language
from weblens.llm.mixing import mix
from weblens.llm.near_dedup import near_components
from weblens.llm.quality import score_quality, train_quality
from weblens.llm.secrets import scan_secrets
from weblens.llm.token_output import token_index
from weblens.llm.toxicity import score_toxicity, train_lexicon


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_quality(documents, train_quality(documents, labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_toxicity(documents, train_lexicon(documents, labels))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return detect_language(documents, train_language(documents))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(read_table(spark, sf_dir, "documents"))


SQL_OP7 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

#: Words as the operator takes them: lower case, ASCII punctuation and blanks separate.
_WORDS = r"""list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~]', ' ', 'g'), '[ \t\n\v\f\r]+'), lambda w: w <> '')"""

SQL_OP9 = rf"""
WITH item_words AS (SELECT item_id, {_WORDS.format()} AS w FROM benchmark),
doc_words AS (SELECT doc_id, {_WORDS.format()} AS w FROM documents),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM item_words),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM doc_words),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
common AS (
  SELECT d.doc_id, i.item_id, count(*) AS n_common
  FROM doc_shingles d JOIN item_shingles i ON d.s = i.s GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, n_common, n_item, n_common / n_item AS containment
FROM common JOIN sizes USING (item_id) WHERE n_common >= 0.8 * n_item
"""


def queries():
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_mixing": op3_mixing,
        "op4_language": op4_language,
        "op5_secrets": op5_secrets,
        "op6_html_extraction": op6_html_extraction,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_token_output": op10_token_output,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op7_exact_dedup": SQL_OP7, "op9_decontamination": SQL_OP9}
