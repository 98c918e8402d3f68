"""Site-wide rollups of page audits: issues, duplicates, root causes, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.functions import urls as U
from weblens.operators.rules import PAGE_RULES, SITE_RULES, advice, category_of, rule_table, severity_rank

EXAMPLES = 5
#: Detections that a missing head explains.
HEAD_CODES = ("CANONICAL_MISSING", "META_DESCRIPTION_MISSING", "OG_TITLE_MISSING", "OG_DESCRIPTION_MISSING")
PRIVATE_CODES = ("CANONICAL_PRIVATE_IP", "HREFLANG_PRIVATE_IP")
ROOT_CAUSES = {"PRIVATE_BASE_URL_CONFIGURATION": "critical", "ROUTE_HEAD_METADATA_MISSING": "warning"}


def duplicates(pages: DataFrame, column: str, key: str = "page_id") -> DataFrame:
    """(key, shared_with): pages whose value of column, trimmed and case-folded, is another page's too."""
    value = F.lower(F.trim(F.col(column)))
    rows = pages.where(F.coalesce(F.col(column), F.lit("")) != "").select(key, value.alias("value"))
    sizes = rows.groupBy("value").agg((F.count("*") - 1).alias("shared_with")).where("shared_with > 0")
    return rows.join(sizes, "value").select(key, "shared_with")


def duplicate_issues(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(code, count): pages that share their title or meta description with another one. No row where none does."""
    parts = (("DUPLICATE_TITLE", "title"), ("DUPLICATE_META_DESCRIPTION", "meta_description"))
    first, second = (duplicates(pages, c, key).groupBy().agg(F.count("*").alias("count")).select(F.lit(code).alias("code"), "count") for code, c in parts)
    return first.unionByName(second).where(F.col("count") > 0)


def root_causes(issues: DataFrame, key: str = "page_id", rendered: Column | None = None) -> DataFrame:
    """(key, code, root_cause): detections that stem from one defect of their page.

    issues holds one row for each page and code; `rendered` says whether the page's final DOM was checked.
    """
    has = lambda code: F.max((F.col("code") == code).cast("int")) == 1
    checked = F.max(rendered.cast("int")) == 1 if rendered is not None else F.lit(False)
    pages = issues.groupBy(key).agg(
        has("CANONICAL_PRIVATE_IP").alias("own"),
        (has("CANONICAL_PRIVATE_IP") | has("HREFLANG_PRIVATE_IP")).alias("private"),
        F.countDistinct(F.when(F.col("code").isin(*HEAD_CODES), F.col("code"))).alias("heads"),
        checked.alias("rendered"),
    )
    rows = issues.select(key, "code").join(pages, key)
    private = F.col("private") & (F.col("code").isin(*PRIVATE_CODES) | ((F.col("code") == "CANONICAL_HTTP_WHEN_PAGE_HTTPS") & F.col("own")))
    head = F.col("rendered") & (F.col("heads") >= 2) & F.col("code").isin(*HEAD_CODES)
    cause = F.when(head, "ROUTE_HEAD_METADATA_MISSING").when(private, "PRIVATE_BASE_URL_CONFIGURATION")
    return rows.select(key, "code", cause.alias("root_cause")).where("root_cause is not null")


def root_cause_rollup(explained: DataFrame) -> DataFrame:
    return explained.groupBy("root_cause", "code").agg(F.count("*").alias("n"))


def root_cause_summary(explained: DataFrame, total: int, key: str = "page_id") -> DataFrame:
    """(root_cause, severity, affected, pct, detections): pages that a cause affects, and how often each code was seen there."""
    codes = root_cause_rollup(explained).groupBy("root_cause").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("detections")
    )
    rows = explained.groupBy("root_cause").agg(F.countDistinct(key).alias("affected")).join(codes, "root_cause")
    severity = F.create_map(*(F.lit(x) for pair in ROOT_CAUSES.items() for x in pair))[F.col("root_cause")]
    return rows.select("root_cause", severity.alias("severity"), "affected", share(F.col("affected"), F.lit(total)).alias("pct"), "detections")


def private_hosts(explained: DataFrame, hosts: DataFrame, key: str = "page_id") -> DataFrame:
    """(host, n): pages that name each private host, of those with that root cause. hosts(key, host)."""
    pages = explained.where("root_cause = 'PRIVATE_BASE_URL_CONFIGURATION'").select(key).distinct()
    return hosts.select(key, "host").distinct().join(pages, key, "left_semi").groupBy("host").agg(F.count("*").alias("n"))


def share(n: Column, total: Column) -> Column:
    """n in percent of total, to two decimals; null without a total."""
    return F.round(100 * n / F.when(total > 0, total), 2)


def audited_documents(pages: DataFrame) -> DataFrame:
    """Rows that rollups are about: documents that were fetched without an error and have an audit."""
    kind = U.resource_type(F.col("url"), F.col("content_type"), F.col("status_code"))
    fine = F.col("status_code").isNull() | (F.col("status_code") < 400)
    return pages.where((F.col("crawl_status") == "ok") & F.col("audit").isNotNull() & fine & (kind == "document"))


def issue_rollup(issues: DataFrame, total: int, explained: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(code, n, independent_n, explained, category, severity, recommendation, pct, drilldown) of all detections, passed groups left out.

    explained says how many detections each root cause accounts for. Ordered by severity, count and code for whoever collects it.
    """
    rows = issues
    if explained is not None:
        rows = rows.join(explained.select(key, "code", "root_cause"), [key, "code"], "left")
    else:
        rows = rows.withColumn("root_cause", F.lit(None).cast("string"))
    by_cause = F.create_map(*(x for c in ROOT_CAUSES for x in (F.lit(c), F.count(F.when(F.col("root_cause") == c, 1)))))
    out = rows.groupBy("code").agg(
        F.count("*").alias("n"), F.sum(F.col("root_cause").isNull().cast("long")).alias("independent_n"), by_cause.alias("explained")
    )
    out = out.withColumn("explained", F.map_filter("explained", lambda _, n: n > 0))
    rules = F.broadcast(rule_table(issues.sparkSession).select("code", "category", "severity", "recommendation"))
    out = out.join(rules, "code").withColumn("pct", F.round(100 * F.col("n") / F.lit(total), 2))
    of_pages = F.col("code").isin(*(code for code, *_ in PAGE_RULES))
    out = out.withColumn("drilldown", F.when(of_pages, drilldown(F.col("code"))))
    return out.orderBy(severity_rank(F.col("severity")), F.desc("n"), "code")


def drilldown(code: Column) -> Column:
    """Where the pages with an issue are listed."""
    return F.concat(F.lit("pages?issue="), code, F.lit("&include_audit=true"))


def merge_site_issues(site: DataFrame, architecture: DataFrame) -> DataFrame:
    """(rn, code, severity, count): site's issues with new ones of the architecture category instead of old ones, by severity; within one,
    site's by category and code come first, then architecture's by code. At most one row for each rule, so one task orders them."""
    rules = F.broadcast(rule_table(site.sparkSession).select("code", "category", "severity"))
    old = site.select("code", "count").join(rules, "code").where("category <> 'architecture'").join(architecture.select("code"), "code", "left_anti")
    new = architecture.select("code", "count").join(rules, "code")
    rows = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    order = Window.orderBy(severity_rank(F.col("severity")), "turn", F.when(F.col("turn") == 0, F.col("category")), "code")
    return rows.select(F.row_number().over(order).alias("rn"), "code", "severity", "count")


def issue_examples(issues: DataFrame, key: str = "page_id", most: int = EXAMPLES) -> DataFrame:
    """(code, rn, key): the first pages of each code."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(key))
    return issues.select("code", key, place.alias("rn")).where(F.col("rn") <= most)


def findings(site: DataFrame, causes: DataFrame, rollup: DataFrame, pages: int | None = None, recorded: int | None = None) -> DataFrame:
    """One list of what to do, most severe and most frequent first: code, root_cause, level, category, severity, affected, affected_unit,
    denominator, percentage, evidence, examples, drilldown, recommendation.

    site(code, severity, affected[, statuses, examples]), causes(root_cause, affected[, detections, examples]) and rollup(code, severity,
    independent_n[, n, explained, examples]). percentage is affected in percent of `pages` or `recorded` URLs, null where the count is of links or of the site
    as a whole, or that number is not given. evidence is JSON. A site issue about canonicals that cannot be used is left out where a
    root cause says the same: statuses, the canonical states of its pages, are private hosts alone. The cause then carries it as evidence.
    """
    site, causes, rollup = (_filled(*x) for x in ((site, _SITE_MORE), (causes, _CAUSE_MORE), (rollup, _ROLLUP_MORE)))
    severity = F.create_map(*(F.lit(x) for pair in ROOT_CAUSES.items() for x in pair))
    # At most one row each: a cause and an issue of that name.
    cause = causes.where("root_cause = 'PRIVATE_BASE_URL_CONFIGURATION'").select(F.lit("CANONICAL_TO_NON_INDEXABLE").alias("code"), F.lit(True).alias("caused"))
    private = F.array_distinct("statuses") == F.array(F.lit("private_host"))
    site = site.join(F.broadcast(cause), "code", "left").withColumn("folded", F.coalesce(F.col("caused") & private, F.lit(False)))
    folded = site.where("folded").select(F.lit("PRIVATE_BASE_URL_CONFIGURATION").alias("root_cause"), F.struct("code", F.col("affected").cast("long").alias("count")).alias("site_level"))
    causes = causes.join(F.broadcast(folded), "root_cause", "left")
    none, long = F.lit(None).cast("string"), lambda c: F.col(c).cast("long").alias("affected")
    parts = [
        site.where("not folded").select(
            "code", none.alias("root_cause"), F.lit("site").alias("level"), "severity", long("affected"),
            F.to_json(F.struct("statuses")).alias("evidence"), "examples", F.lit("issues").alias("drilldown"),
        ),
        causes.select(
            F.col("root_cause").alias("code"), "root_cause", F.lit("page_root_cause").alias("level"), severity[F.col("root_cause")].alias("severity"),
            long("affected"), F.to_json(F.struct("detections", "site_level")).alias("evidence"), "examples",
            drilldown(F.element_at(F.map_keys("detections"), 1)).alias("drilldown"),
        ),
        rollup.where("independent_n > 0").select(
            "code", none.alias("root_cause"), F.lit("page").alias("level"), "severity", long("independent_n"),
            F.to_json(F.struct(F.col("n").alias("detections"), "explained")).alias("evidence"), "examples",
            F.when(F.col("code").isin(*(c for c, *_ in PAGE_RULES)), drilldown(F.col("code"))).alias("drilldown"),
        ),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    look = lambda f: F.create_map(*(F.lit(x) for code, *_ in PAGE_RULES + SITE_RULES for x in (code, f(code))))[F.col("code")]
    of = F.when(F.col("level") == "site", F.coalesce(look(denominator), F.lit(PAGES))).otherwise(PAGES)
    unit = F.when(F.col("level") != "site", "pages").when(of == "site", "site check").when(of == "links", "links").otherwise("URLs")
    base = F.when(of == PAGES, F.lit(pages)).when(of == RECORDED, F.lit(recorded)).cast("long")
    out = out.withColumns(
        {
            "category": F.coalesce(look(category_of), F.lit("root_cause")), "affected_unit": unit,
            "denominator": F.when(~of.isin("site", "links"), of), "percentage": share(F.col("affected"), base),
            "examples": F.slice("examples", 1, EXAMPLES), "recommendation": advice(F.col("code")),
        }
    )
    return out.orderBy(severity_rank(F.col("severity")), F.desc("affected"), "level", "code")


_SITE_MORE = {"statuses": "array<string>", "examples": "array<string>"}
_CAUSE_MORE = {"detections": "map<string, bigint>", "examples": "array<string>"}
_ROLLUP_MORE = {"n": "bigint", "explained": "map<string, bigint>", "examples": "array<string>"}


def _filled(rows: DataFrame, more: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in more.items() if c not in rows.columns})


#: What a finding's count is a share of, by code and else by category.
PAGES, RECORDED = "counts.html_pages_ok", "counts.recorded_urls"
DENOMINATORS = {
    "BROKEN_INTERNAL_LINKS": "links", "BROKEN_RESOURCE_LINKS": "links", "REDIRECTED_INTERNAL_LINKS": "links",
    "BROKEN_PAGES": RECORDED, "ROBOTS_BLOCKED_PAGES": RECORDED, "sitemap": "site", "robots": "site",
}


def denominator(code: str) -> str:
    return DENOMINATORS.get(code) or DENOMINATORS.get(category_of(code)) or PAGES
