"""Indexability: the states of every crawled page, counts of them, and the site's issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.functions import text as T
from weblens.functions import urls as U
from weblens.operators.rules import category_of

STATES = ("discovered", "crawlable", "fetchable", "renderable", "indexable", "canonical")
#: Examples that a site issue lists.
EXAMPLES = 20


def page_states(pages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """pages with kind, three-valued states, canonical_status, reasons and soft_404.

    pages: key, url, crawl_status, status_code, content_type, meta_robots, x_robots, canonical_key, canonical_url,
    render_status, title, h1; columns that are missing count as null. targets(key, ok) says which canonical targets are live and
    indexable; by default they are taken from pages, as the reference of one page to another.
    """
    for name, kind in (("x_robots", "string"), ("render_status", "string"), ("title", "string"), ("h1", "string"), ("meta_robots", "string")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    status, code = F.col("crawl_status"), F.col("status_code")
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    blocked = status == "blocked_robots"
    kind = U.resource_type(F.col("url"), F.col("content_type"), code)
    fetchable = (
        F.when(blocked, unknown)
        .when(status == "error", no)
        .when(status == "redirect", yes)
        .when(code >= 400, no)
        .otherwise(yes)
    )
    document = F.col("kind") == "document"
    renderable = (
        F.when(blocked | ~document | (F.col("fetchable") == F.lit(False)) | (status != "ok") | (F.col("render_status") == "skipped"), unknown)
        .when(F.col("render_status") == "failed", no)
        .otherwise(yes)
    )
    meta, header = T.noindex(F.col("meta_robots")), T.noindex(F.col("x_robots"))
    indexable = (
        F.when(blocked, no)
        .when(~document, unknown)
        .when(F.col("fetchable") == F.lit(False), no)
        .when(status == "redirect", no)
        .when(status == "non_html", unknown)
        .when(header | meta, no)
        .otherwise(yes)
    )
    reason = (
        F.when(blocked, "blocked_robots")
        .when(~document, "not_document")
        .when(F.col("fetchable") == F.lit(False), "not_fetchable")
        .when(status == "redirect", "redirect")
        .when(header, "noindex_header")
        .when(meta, "noindex_meta")
        .otherwise("indexable")
    )
    rows = pages.withColumn("kind", kind).withColumn("discovered", yes).withColumn("crawlable", F.when(blocked, no).otherwise(yes))
    rows = rows.withColumn("fetchable", fetchable).withColumn("renderable", renderable)
    rows = rows.withColumn("indexable", indexable).withColumn("index_reason", reason)
    if targets is None:
        live = F.coalesce(code, F.lit(0)) < 400
        targets = rows.groupBy("key").agg(F.max((status == "ok") & live).alias("ok"))
    known = targets.select(F.col("key").alias("canonical_key"), F.col("ok").alias("target_ok"))
    rows = rows.join(known, "canonical_key", "left")
    given = F.coalesce("canonical_url", F.lit("")) != ""
    canonical = (
        F.when(blocked | (status != "ok") | (code >= 400), "not_analyzed")
        .when(~document, "not_applicable")
        .when(~given, "missing_implicit_self")
        .when(~U.is_web_url(F.col("canonical_url")), "invalid")
        .when(F.col("canonical_key") == F.col("key"), "self")
        .when(U.is_private_host(U.host(F.col("canonical_url"))), "private_host")
        .when(F.col("target_ok") == F.lit(False), "target_not_indexable")
        .otherwise("other_url")
    )
    rows = rows.withColumn("canonical_status", canonical)
    self_canonical = (
        F.when(F.col("canonical_status").isin("not_analyzed", "not_applicable"), unknown)
        .when(F.col("canonical_status").isin("missing_implicit_self", "self"), yes)
        .otherwise(no)
    )
    soft = F.when((status == "ok") & (code == 200), T.soft_404(F.col("title"), F.col("h1")))
    return rows.withColumn("canonical", self_canonical).withColumn("soft_404", soft).drop("target_ok")


def state_summary(states: DataFrame) -> DataFrame:
    """(state, true_n, false_n, unknown_n)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("value")) for s in STATES)))
    rows = states.select(pairs.alias("x")).select("x.*")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    value = F.col("value")
    return rows.groupBy("state").agg(
        count(value == F.lit(True)).alias("true_n"), count(value == F.lit(False)).alias("false_n"), count(value.isNull()).alias("unknown_n")
    )


def bucket() -> Column:
    """The one bucket of a crawled URL, first match."""
    status, code = F.col("crawl_status"), F.coalesce("status_code", F.lit(0))
    return (
        F.when(status == "blocked_robots", "blocked_by_robots")
        .when(status == "redirect", "redirects")
        .when(status == "error", "failed_requests")
        .when((F.col("kind") != "document") | (status == "non_html"), F.when(code >= 400, "assets_broken").otherwise("assets_and_non_html_ok"))
        .when(code >= 400, "html_error_pages")
        .otherwise("html_pages_ok")
    )


def url_counts(states: DataFrame) -> DataFrame:
    return states.groupBy(bucket().alias("bucket")).agg(F.count("*").alias("n"))


def missing_from_sitemap(states: DataFrame, sitemap_keys: DataFrame) -> DataFrame:
    """Indexable, self-canonical live documents that no sitemap lists."""
    fit = (F.col("crawl_status") == "ok") & (F.col("indexable") == F.lit(True)) & (F.col("canonical") == F.lit(True))
    return states.where(fit).join(sitemap_keys.select("key").distinct(), "key", "left_anti")


_SITE_TESTS = {
    "SITEMAP_URL_NON_200": "in_sitemap and (crawl_status = 'error' or coalesce(status_code, 0) >= 400)",
    "SITEMAP_URL_REDIRECT": "in_sitemap and crawl_status = 'redirect'",
    "SITEMAP_URL_BLOCKED": "in_sitemap and crawl_status = 'blocked_robots'",
    "SITEMAP_URL_NOINDEX": "in_sitemap and index_reason in ('noindex_meta', 'noindex_header')",
    "SITEMAP_URL_CANONICALIZED": "in_sitemap and canonical = false",
    "NOINDEX_PAGES": "index_reason in ('noindex_meta', 'noindex_header')",
    "BROKEN_PAGES": "fetchable = false and kind = 'document'",
    "ROBOTS_BLOCKED_PAGES": "crawlable = false",
    "RENDER_FAILED_PAGES": "renderable = false",
    "SOFT_404_CANDIDATES": "soft_404",
    "CANONICAL_TO_NON_INDEXABLE": "canonical_status in ('private_host', 'target_not_indexable', 'invalid')",
    "CANONICALIZED_PAGES": "canonical = false and canonical_status not in ('private_host', 'target_not_indexable', 'invalid')",
}


#: Says something only where every sitemap file was read.
_COMPLETE_TESTS = {"PAGES_MISSING_FROM_SITEMAP": "not in_sitemap and crawl_status = 'ok' and indexable and canonical"}


def site_issues(states: DataFrame, use_sitemaps: bool = True, sitemap_complete: bool = False) -> DataFrame:
    """(code, count, examples) of the page-derived site rules, in one pass; only codes that fire. Without use_sitemaps, none is about
    sitemaps; pages that no sitemap lists are an issue only with sitemap_complete."""
    tests = _SITE_TESTS | (_COMPLETE_TESTS if sitemap_complete else {})
    tests = {code: test for code, test in tests.items() if use_sitemaps or category_of(code) != "sitemap"}
    fired = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(code)) for code, test in tests.items())))
    rows = states.select("url", F.explode(fired).alias("code"))
    examples = F.slice(F.array_sort(F.collect_list("url")), 1, EXAMPLES)
    ranked = rows.groupBy("code").agg(F.count("*").alias("count"))
    few = rows.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("url"))).where(F.col("rn") <= EXAMPLES)
    return ranked.join(few.groupBy("code").agg(examples.alias("examples")), "code")


#: Canonical targets that search engines cannot use.
DEFECTS = ("private_host", "target_not_indexable", "invalid")


def canonical_defects(states: DataFrame) -> DataFrame:
    """(canonical_status, n, still_indexable): pages whose canonical cannot be used, and those of them that could be indexed."""
    fine = F.count(F.when(F.col("indexable") == F.lit(True), 1))
    return states.where(F.col("canonical_status").isin(*DEFECTS)).groupBy("canonical_status").agg(F.count("*").alias("n"), fine.alias("still_indexable"))


def recorded_urls(states: DataFrame) -> DataFrame:
    """One row: recorded_urls, html_pages_ok, broken_urls."""
    rows = states.select(bucket().alias("bucket"))
    broken = F.col("bucket").isin("html_error_pages", "assets_broken", "failed_requests")
    return rows.agg(
        F.count("*").alias("recorded_urls"), F.count(F.when(F.col("bucket") == "html_pages_ok", 1)).alias("html_pages_ok"),
        F.count(F.when(broken, 1)).alias("broken_urls"),
    )


def sitemap_issue(status: Column, robots_status: Column, robots_sitemaps: Column, duplicates: Column, urls: Column, complete: Column) -> Column:
    """Codes that a site's robots.txt and sitemap files give, as an array."""
    return F.array_compact(
        F.array(
            F.when(robots_status == "html_response", "ROBOTS_TXT_INVALID"),
            F.when(status.isin("not_found", "fetch_error"), "SITEMAP_NOT_FOUND"),
            F.when(status.isin("html_instead_of_xml", "parse_error", "unsupported_format", "empty"), "SITEMAP_EMPTY_OR_INVALID"),
            F.when((robots_status == "ok") & (robots_sitemaps == 0), "SITEMAP_NOT_IN_ROBOTS"),
            F.when(duplicates > 0, "SITEMAP_DUPLICATE_URLS"),
            F.when((urls > 0) & ~complete, "SITEMAP_ANALYSIS_INCOMPLETE"),
        )
    )
