"""Thresholds, from the session's configuration where it has them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Fixed default values; weblens.<name> in the session overrides one."""

    max_html_bytes: int = 10 * 1024 * 1024
    title_min: int = 30
    title_max: int = 60
    meta_desc_min: int = 70
    meta_desc_max: int = 160
    very_thin_words: int = 100
    thin_words: int = 300
    render_min_words: int = 50
    deep_page_depth: int = 4
    sitemap_max_urls: int = 200_000
    sitemap_max_files: int = 1_000

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"weblens.{f.name}", None) for f in fields(cls)}
        return cls(**{k: int(v) for k, v in given.items() if v is not None})
