"""The service's endpoints as functions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.operators import audit, crawl, graph, pages, render, report, rollup, states


def parse_pages(source: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.parse_pages(source, key)


def audit_pages(source: DataFrame, key: str = "page_id") -> DataFrame:
    return audit.audit_pages(pages.parse_pages(source, key))


def reports(source: DataFrame, key: str = "page_id") -> DataFrame:
    return report.markdown(audit_pages(source, key), key)


def extract(fetches: DataFrame, key: str = "page_id", mode: str = "auto") -> DataFrame:
    """Audits of fetched pages: fetches(key, url, status_code, html, rendered_html).

    The rendered parse is looked at where the render decision asks for it and there is one; failed requests and statuses of 400 and above
    are left out, as the endpoint answers them with an error.
    """
    fine = fetches.where("status_code < 400")
    raw = pages.parse_pages(fine.select(key, "url", "html"), key)
    reasons = render.render_reasons(
        F.col("html"), F.col("word_count"), F.size("headings"), F.col("internal_links_count") + F.col("external_links_count")
    )
    asked = raw.select(key, "word_count", "headings", "internal_links_count", "external_links_count").join(fine.select(key, "html"), key)
    asked = asked.where(render.render_required(reasons, mode)).select(key)
    shown = fine.where("rendered_html is not null").join(asked, key, "left_semi")
    rendered = pages.parse_pages(shown.select(key, "url", F.col("rendered_html").alias("html")), key)
    return audit.audit_pages(render.merge(raw, rendered, key))


def crawl_site(fetches: DataFrame, links: DataFrame, start: str, options: crawl.CrawlOptions | None = None, **more: DataFrame) -> DataFrame:
    return crawl.replay(fetches, links, start, options or crawl.CrawlOptions(), **more)


def crawl_result(fetches: DataFrame, links: DataFrame, start: str, options: crawl.CrawlOptions | None = None, **more: DataFrame) -> DataFrame:
    """One row of counters about the crawl."""
    return crawl.diagnostics(crawl.run_crawl(fetches, links, start, options or crawl.CrawlOptions(), **more))


def list_pages(rows: DataFrame, crawl_status: str | None = None, indexable: bool | None = None, issue: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages by depth, sitemap-only ones last, then key. An unknown state matches neither True nor False."""
    if crawl_status is not None:
        rows = rows.where(F.col("crawl_status") == crawl_status)
    if indexable is not None:
        rows = rows.where(F.col("indexable") == F.lit(indexable))
    if issue is not None:
        rows = audit.pages_with_issue(rows, issue)
    return rows.orderBy(F.col("depth").asc_nulls_last(), "key").offset(offset).limit(limit)


def list_links(links: DataFrame, internal: bool | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    rows = links if internal is None else links.where(F.col("internal") == F.lit(internal))
    return rows.orderBy("id").offset(offset).limit(limit)


def site_issues(site: DataFrame, links: DataFrame, use_sitemaps: bool = True, sitemap_complete: bool = False) -> DataFrame:
    """(rn, code, severity, count) of all site rules over pages and links, in the order of the list."""
    of_pages = states.site_issues(states.page_states(site), use_sitemaps, sitemap_complete)
    return rollup.merge_site_issues(of_pages, graph.architecture_issues(site, links, graph.page_flags(site, links)))


def architecture(site: DataFrame, links: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(top pages, flagged pages)."""
    flags = graph.page_flags(site, links)
    return graph.top_pages(flags.select("key", "authority"), k), graph.flagged_pages(flags)


def issue_summary(audited: DataFrame, key: str = "page_id") -> DataFrame:
    issues = audit.issue_rows(audited, key)
    return rollup.issue_rollup(issues, audited.count(), rollup.root_causes(issues, key), key)
