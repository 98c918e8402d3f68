"""Parsed pages: links classified and deduplicated, counts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.functions import text as T
from weblens.functions import urls as U
from weblens.sources.html import parse_raw

SUMMARY = (
    "url domain title title_length meta_description canonical language h1 h2 h3 images_total images_without_alt"
    " internal_links_count external_links_count word_count main_content_word_count"
).split()


def page_links(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each link, in document order: key, pos, href, absolute_url, text, nofollow, location, type, is_duplicate.

    A link repeats an earlier one of its page when type, normalized target and case-folded text agree.
    """
    return parsed.select(key, F.posexplode("links").alias("pos", "link")).select(key, "pos", "link.*")


def parse_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One wide row per page with all extracted fields, links and counts. Links never leave their row."""
    parsed = parse_raw(pages, key)
    unique = F.filter("links", lambda x: ~x["is_duplicate"])
    level = lambda k: F.transform(F.filter("headings", lambda h: h["level"] == k), lambda h: h["text"])
    count = lambda test: F.size(F.filter(unique, test))
    of_type = lambda k: count(lambda x: x["type"] == k)
    images = lambda test: F.size(F.filter("images", test))
    robots = F.transform(F.split(F.lower(F.coalesce("meta_robots", F.lit(""))), ","), lambda t: F.trim(t))
    spoken = T.detect_language(F.col("language"), U.path(F.col("url")), F.col("body_text"))
    out = parsed.withColumns(
        {
            "domain": U.host(F.col("url")),
            "scheme": U.scheme(F.col("url")),
            "title_length": F.length(F.coalesce("title", F.lit(""))),
            "meta_description_length": F.length(F.coalesce("meta_description", F.lit(""))),
            "noindex": F.arrays_overlap(robots, F.array(F.lit("noindex"), F.lit("none"))),
            "nofollow": F.arrays_overlap(robots, F.array(F.lit("nofollow"), F.lit("none"))),
            **{f"h{k}": level(k) for k in (1, 2, 3)},
            "links_total": F.size(unique),
            "links_raw_total": F.size("links"),
            **{f"{k}_links_count": of_type(k) for k in ("internal", "external", "anchor")},
            "nofollow_links_count": count(lambda x: x["nofollow"]),
            "images_total": F.size("images"),
            "images_without_alt": images(lambda x: x["alt"].isNull()),
            "images_with_empty_alt": images(lambda x: x["alt"] == ""),
            "images_with_alt": images(lambda x: F.coalesce(x["alt"], F.lit("")) != ""),
            "word_count": T.count_words(F.col("body_text")),
            "content_word_count": T.count_words(F.col("content_text")),
            "main_content_word_count": T.count_words(F.col("main_content")),
            "_spoken": spoken,
        }
    )
    words, content = F.col("main_content_word_count"), F.col("content_word_count")
    ratio = F.when(content > 0, F.round(words / content, 2)).otherwise(1.0)
    semantic = F.col("main_content_method") != "body_without_boilerplate"
    low = (content > 0) & ((words == 0) | (semantic & (ratio < 0.5)))
    shown = F.when(F.col("main_content") != "", F.col("main_content")).otherwise(F.col("body_text"))
    thai = F.aggregate(
        F.regexp_extract_all(shown, F.lit(f"[{T.THAI}]+"), F.lit(0)),
        F.lit(0),
        lambda n, t: n + F.ceil(F.length(t) / T.THAI_CHARS_PER_WORD).cast("int"),
    )
    approximate = (F.col("_spoken.language") == "th") | (thai / F.greatest(T.count_words(shown), F.lit(1)) > 0.2)
    return out.withColumns(
        {
            "h1_count": F.size("h1"),
            "h2_count": F.size("h2"),
            "duplicate_links_count": F.col("links_raw_total") - F.col("links_total"),
            "main_content_ratio": ratio,
            "main_content_confidence": F.when(low, "low").otherwise("high"),
            "detected_language": F.col("_spoken.language"),
            "language_signal": F.col("_spoken.signal"),
            "word_count_is_approximate": approximate,
            "word_count_method": F.when(approximate, "whitespace tokens + Thai runs estimated at 5 chars/word").otherwise(
                "whitespace-delimited tokens containing a letter or digit"
            ),
        }
    ).drop("_spoken")


def page_summary(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    return parsed.select(key, *SUMMARY)


def heading_rows(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    return parsed.select(key, F.posexplode("headings").alias("pos", "heading")).select(key, "pos", "heading.level", "heading.text")


def heading_skips(headings: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n_skips): headings more than one level below the one before; the first heading is exempt."""
    before = F.lag("level").over(Window.partitionBy(key).orderBy("pos"))
    return (
        headings.withColumn("skip", F.coalesce((F.col("level") > before + 1).cast("int"), F.lit(0)))
        .groupBy(key)
        .agg(F.sum("skip").cast("long").alias("n_skips"))
    )
