"""Page rules as expressions over parsed pages: issues, score and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.config import Settings
from weblens.functions import text as T
from weblens.operators.rules import GROUPS, SEVERITIES, category_of, grade, penalty, score, severity_of, severity_rank

#: Examples that an issue's value lists.
EXAMPLES = 10


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _checks(s: Settings, rendering: bool) -> dict[str, tuple[Column, Column, Column]]:
    """code -> (fires, count, value as JSON text) for every page rule."""
    one, none = F.lit(1), F.lit(None).cast("string")
    unique = F.filter("links", lambda x: ~x["is_duplicate"])
    title, description = F.col("title_length"), F.col("meta_description_length")
    canonical = F.col("canonical_absolute_url")
    known = F.coalesce(F.col("canonical"), F.lit("")) != ""
    to = F.col("canonical_target")
    web, private = to["web"], to["private"]
    listed = lambda items: F.to_json(F.slice(items, 1, EXAMPLES))
    of = lambda items: (F.size(items) > 0, F.size(items), listed(items))

    levels = F.transform("headings", lambda h: h["level"])
    skips = F.filter(
        F.transform("headings", lambda h, i: F.struct(h["level"].alias("level"), F.coalesce(F.get(levels, i - 1), F.lit(9)).alias("before"))),
        lambda h: h["level"] > h["before"] + 1,
    )
    bad = lambda h: ~F.coalesce(T.valid_hreflang(h["lang"]), F.lit(False)) | ~h["web"]
    inner = lambda h: h["private"]
    langs = F.transform("hreflang", lambda h: F.lower(h["lang"]))
    repeated = F.array_sort(F.array_distinct(F.filter(langs, lambda v: F.size(F.filter(langs, lambda w: w == v)) > 1)))
    low = F.col("main_content_confidence") == "low"
    words = F.when(low, F.col("content_word_count")).otherwise(F.col("main_content_word_count"))
    errors, blocks = F.size("structured_data_errors"), F.col("structured_data_count")
    checks = {
        "TITLE_MISSING": (title == 0, one, none),
        "TITLE_TOO_SHORT": ((title > 0) & (title < s.title_min), one, F.col("title")),
        "TITLE_TOO_LONG": (title > s.title_max, one, F.col("title")),
        "META_DESCRIPTION_MISSING": (description == 0, one, none),
        "META_DESCRIPTION_TOO_SHORT": ((description > 0) & (description < s.meta_desc_min), one, F.col("meta_description")),
        "META_DESCRIPTION_TOO_LONG": (description > s.meta_desc_max, one, F.col("meta_description")),
        "H1_MISSING": (F.col("h1_count") == 0, one, none),
        "MULTIPLE_H1": (F.col("h1_count") > 1, F.col("h1_count"), listed(F.col("h1"))),
        "EMPTY_HEADING": of(F.filter("headings", lambda h: h["text"] == "")),
        "HEADING_ORDER_SKIPPED": of(skips),
        "CANONICAL_MISSING": (~known, one, none),
        "CANONICAL_INVALID": (known & ~web, one, F.col("canonical")),
        "CANONICAL_PRIVATE_IP": (known & web & private, one, canonical),
        "CANONICAL_DOMAIN_MISMATCH": (known & web & ~private & ~to["same_site"], one, canonical),
        "CANONICAL_HTTP_WHEN_PAGE_HTTPS": (known & web & (F.col("scheme") == "https") & (to["scheme"] == "http"), one, canonical),
        "HREFLANG_INVALID": of(F.filter("hreflang", bad)),
        "HREFLANG_PRIVATE_IP": of(F.filter("hreflang", lambda h: ~bad(h) & inner(h))),
        "HREFLANG_DOMAIN_MISMATCH": of(F.filter("hreflang", lambda h: ~bad(h) & ~inner(h) & ~h["same_site"])),
        "HREFLANG_DUPLICATE_LANGUAGE": of(repeated),
        "IMAGE_ALT_MISSING": of(F.filter("images", lambda i: i["alt"].isNull())),
        "EMPTY_LINK": of(F.filter(unique, lambda x: x["text"] == "")),
        "JAVASCRIPT_LINK": of(F.filter(unique, lambda x: x["type"] == "javascript")),
        "INVALID_LINK": of(F.filter(unique, lambda x: x["type"] == "invalid")),
        "NOINDEX_PAGE": (F.col("noindex"), one, F.col("meta_robots")),
        "NOFOLLOW_PAGE": (F.col("nofollow"), one, F.col("meta_robots")),
        "OG_TITLE_MISSING": (_blank("og_title"), one, none),
        "OG_DESCRIPTION_MISSING": (_blank("og_description"), one, none),
        "OG_IMAGE_MISSING": (_blank("og_image"), one, none),
        "TWITTER_CARD_MISSING": (_blank("twitter_card"), one, none),
        "EMPTY_MAIN_CONTENT": (words == 0, one, none),
        "VERY_THIN_CONTENT": ((words > 0) & (words < s.very_thin_words), one, words.cast("string")),
        "THIN_CONTENT": ((words >= s.very_thin_words) & (words < s.thin_words), one, words.cast("string")),
        "STRUCTURED_DATA_INVALID_JSON": (errors > 0, errors, listed(F.col("structured_data_errors"))),
        "STRUCTURED_DATA_NOT_FOUND": (blocks == errors, one, none),
    }
    if rendering:
        sources = F.map_filter("metadata_source", lambda _, v: v == "rendered_dom")
        checks["METADATA_REQUIRES_JS"] = (F.size(sources) > 0, one, F.to_json(F.map_keys(sources)))
        thin = (F.col("source") == "rendered") & (F.col("raw_word_count") < s.render_min_words)
        checks["CONTENT_REQUIRES_JS"] = (thin, one, F.col("raw_word_count").cast("string"))
    return checks


def audit_pages(parsed: DataFrame, settings: Settings | None = None) -> DataFrame:
    """parsed with issues, score, grade and the counts of each severity.

    issues holds (code, category, severity, count, value), passed groups included, by severity, category and code.
    With the columns of a render decision (metadata_source, source, raw_word_count) the rendering group is checked as well.
    """
    rendering = {"metadata_source", "source", "raw_word_count"} <= set(parsed.columns)
    checks = _checks(settings or Settings.of(parsed.sparkSession), rendering)
    groups = [*GROUPS, *(["rendering"] if rendering else [])]
    fired = [
        F.when(
            F.coalesce(fires, F.lit(False)),
            F.struct(
                F.lit(code).alias("code"),
                F.lit(category_of(code)).alias("category"),
                F.lit(severity_of(code)).alias("severity"),
                count.cast("int").alias("count"),
                value.alias("value"),
            ),
        )
        for code, (fires, count, value) in checks.items()
    ]
    out = parsed.withColumn("_fired", F.array_compact(F.array(*fired)))
    touched = F.transform("_fired", lambda x: x["category"])
    passed = F.transform(
        F.array_except(F.array(*map(F.lit, groups)), touched),
        lambda g: F.struct(
            F.concat(F.upper(g), F.lit("_OK")).alias("code"), g.alias("category"), F.lit("passed").alias("severity"),
            F.lit(1).alias("count"), F.lit(None).cast("string").alias("value"),
        ),
    )
    ranked = F.transform(
        F.concat("_fired", passed),
        lambda x: F.struct(severity_rank(x["severity"]).alias("r"), x["category"].alias("g"), x["code"].alias("c"), x.alias("x")),
    )
    issues = F.transform(F.array_sort(ranked), lambda x: x["x"])
    total = F.aggregate("issues", F.lit(0), lambda n, x: n + penalty(x["severity"], x["count"]))
    out = out.withColumn("issues", issues).drop("_fired").withColumn("score", score(total)).withColumn("grade", grade(F.col("score")))
    return out.withColumns(
        {f"{v}_count": _with_severity(v) for v in SEVERITIES}
    )


def _with_severity(severity: str) -> Column:
    return F.size(F.filter("issues", lambda x: x["severity"] == severity)).cast("long")


def issue_rows(audited: DataFrame, *keys: str, passed: bool = False) -> DataFrame:
    """One row for each issue: keys, code, category, severity, count, value."""
    # Every page has issues or passed groups. The outer form keeps the planner from testing the array beforehand, which would
    # have it computed again for that.
    rows = audited.select(*keys, F.explode_outer("issues").alias("issue")).select(*keys, "issue.*")
    return rows if passed else rows.where("severity <> 'passed'")


def pages_with_issue(audited: DataFrame, code: str) -> DataFrame:
    """Rows of audited with an issue of this code. A page has one at most, so the outer explode adds no rows; unlike a
    condition on the array, it doesn't have the array computed again."""
    found = F.filter("issues", lambda x: x["code"] == code)
    return audited.select("*", F.explode_outer(found).alias("_found")).where("_found is not null").drop("_found")
