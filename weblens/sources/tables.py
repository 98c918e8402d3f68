"""Stored relations of crawls: append, additive schema evolution, reading by crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

CRAWLS = "id long, root_url string, domain string, status string, options string, stats string, robots string, error string, created_at timestamp, started_at timestamp, finished_at timestamp"
CRAWL_PAGES = (
    "id long, crawl_id long, key string, url string, crawl_status string, status_code int, content_type string, depth int, parent string,"
    " via string, in_sitemap boolean, redirect_to string, canonical_url string, title string, meta_description string, word_count int,"
    " language string, render_status string, error string, crawled_at timestamp"
)
PAGE_LINKS = "id long, crawl_id long, src string, dst string, anchor_text string, internal boolean, nofollow boolean, location string"


def append(rows: DataFrame, path: str) -> None:
    """Add rows of one or more crawls, a folder for each crawl."""
    rows.write.mode("append").partitionBy("crawl_id").parquet(path)


def of_crawl(spark: SparkSession, path: str, crawl_id: int) -> DataFrame:
    """One crawl's rows; older files may lack newer columns, which are null then."""
    return spark.read.option("mergeSchema", "true").parquet(path).where(F.col("crawl_id") == crawl_id)


def with_columns_of(rows: DataFrame, schema: str) -> DataFrame:
    """rows with all columns of schema, missing ones null."""
    return rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)


def as_json(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, StructType | ArrayType | MapType)]
    return rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows
