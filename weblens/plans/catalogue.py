"""The registered queries of the page and site operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.functions import text as T
from weblens.functions import urls as U
from weblens.operators import audit, crawl, graph, pages, render, report, rollup, states
from weblens.operators.rules import ADVICE, rule_table
from weblens.plans import site as S
from weblens.plans.materialize import materialize
from weblens.sources import sitemaps
from weblens.sources.html import parse_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def _values(rows: list[tuple]) -> str:
    """Rows as the body of a SQL VALUES list."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def _with(rows: str) -> str:
    return f"WITH {S.SQL.strip()}\n{rows}"


# --- URLs

_HOST = "regexp_extract(lower(url), '^https?://([^/?#:]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_NORM_PATH = f"CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE rtrim({_PATH}, '/') END"
_NORM = f"regexp_extract(url, '^(https?)', 1) || '://' || {_HOST} || {_NORM_PATH}"


@_query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS site_key FROM pages")
def site_key(spark, sf):
    return S.pages_table(spark, sf).select("page_id", U.site_key(U.host(F.col("url"))).alias("site_key"))


@_query(f"SELECT page_id, {_NORM} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS normalized_url FROM pages")
def url_normalize(spark, sf):
    return S.pages_table(spark, sf).select("page_id", U.normalize(F.col("url")).alias("normalized_url"))


@_query(f"""
WITH q AS (SELECT page_id, {_NORM} AS base,
  list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS ps FROM pages)
SELECT page_id, base || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(ps, '&') END AS crawl_key FROM q""")
def crawl_key(spark, sf):
    return S.pages_table(spark, sf).select("page_id", U.crawl_key(F.col("url")).alias("crawl_key"))


_RESOURCES = [
    ("https://x.com/a.jpg", "text/html; charset=utf-8", 200, "document"), ("https://x.com/img/1", "image/png", 200, "asset"),
    ("https://x.com/f", "application/pdf", 200, "non_html"), ("https://x.com/f.PDF?x=1", None, None, "asset"),
    ("https://x.com/v1.2/", None, None, "document"), ("https://x.com/a.jpg", "text/html", 404, "asset"),
    ("https://x.com/page", "text/html", 404, "document"), ("https://x.com/s.css", "text/css", 200, "asset"),
    ("https://x.com/d.json", "application/json", 200, "non_html"), ("https://x.com/", "", 200, "document"),
]


@_query(f"SELECT url, coalesce(status::BIGINT, -1) AS status, kind FROM {_values(_RESOURCES)} v(url, content_type, status, kind)")
def resource_type(spark, sf):
    rows = spark.createDataFrame(_RESOURCES, "url string, content_type string, status int, expected string")
    kind = U.resource_type(F.col("url"), F.col("content_type"), F.col("status"))
    return rows.select("url", F.coalesce(F.col("status").cast("long"), F.lit(-1).cast("long")).alias("status"), kind.alias("kind"))


_HREFS = "string_split_regex(html, '<a href=\"')"
_SQL_LINKS = """
l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="', 0)))) AS pos FROM pages),
l1 AS (SELECT *, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, '/') THEN 'internal' ELSE 'other' END AS type FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, type, CASE WHEN href = '/' THEN href ELSE rtrim(href, '/') END, lower(text) ORDER BY pos) > 1 AS is_duplicate FROM l1)"""


@_query(f"WITH {_SQL_LINKS} SELECT page_id, pos::INT AS pos, type FROM l2")
def link_classify(spark, sf):
    return pages.page_links(parse_raw(S.pages_table(spark, sf))).select("page_id", "pos", "type")


@_query(f"""
WITH h AS (SELECT page_id, {_HOST} || {_NORM_PATH} AS host_path FROM pages)
SELECT host_path, min(page_id) AS first_page_id, count(*) AS n FROM h GROUP BY host_path""")
def url_dedupe(spark, sf):
    rows = S.pages_table(spark, sf)
    path = F.regexp_replace(U.path(F.col("url")), "/+$", "")
    rows = rows.select("page_id", F.concat(U.host(F.col("url")), F.when(path == "", "/").otherwise(path)).alias("host_path"))
    return rows.groupBy("host_path").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("n"))


@_query("SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, 'utm_')")
def url_pattern_filter(spark, sf):
    return S.pages_table(spark, sf).where(crawl.allowed_by_patterns(F.col("url"), ("/(en|de)/",), ("utm_",))).select("page_id")


_PRIVATE = [
    ("10.7.45.121", True), ("192.168.1.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("127.0.0.1", True), ("localhost", True),
    ("a.localhost", True), ("printer.local", True), ("::1", True), ("8.8.8.8", False), ("example.com", False), ("169.254.1.1", True),
    ("0.0.0.0", True), ("240.0.0.1", True), ("fe80::1", True), ("2606:4700::1111", False), ("10.example.com", False),
]


@_query(f"SELECT host, is_private FROM {_values(_PRIVATE)} v(host, is_private)")
def private_host(spark, sf):
    rows = spark.createDataFrame(_PRIVATE, "host string, expected boolean")
    return rows.select("host", U.is_private_host(F.col("host")).alias("is_private"))


@_query(f"SELECT coalesce(nullif(lower(regexp_extract({_PATH}, '^/([a-zA-Z]{{2}}([-_][a-zA-Z]{{2}})?)(/|$)', 1)), ''), '(none)') AS segment, count(*) AS n FROM pages GROUP BY 1")
def language_segments(spark, sf):
    return crawl.language_segments(S.pages_table(spark, sf))


# --- Pages

_SQL_TITLE = "trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))"
_SQL_H1 = "trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g'))"
#: Texts of the generated pages: no tag but inline b stays, every tag is a blank, and entities that occur are decoded.
_SQL_TEXT = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
  {}, '<script>.*?</script>', ' ', 'gs'), '<!--.*?-->', '', 'gs'), '<[^>]*>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""
_SQL_BODY = _SQL_TEXT.format("regexp_extract(html, '<body>(.*)$', 1, 's')")
_SQL_MAIN = _SQL_TEXT.format("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")
_SQL_WORDS = "len(list_filter(string_split({}, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))"


@_query(f"""SELECT page_id, {_SQL_TITLE.replace("&", "&")} AS raw_title, length({_SQL_TITLE})::INT AS title_length, {_SQL_H1} AS h1,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {_SQL_WORDS.format(_SQL_BODY)}::INT AS word_count FROM pages""".replace(_SQL_TITLE, _SQL_TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")).replace(_SQL_H1, _SQL_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")))
def page_summary(spark, sf):
    parsed = pages.parse_pages(S.pages_table(spark, sf))
    return pages.page_summary(parsed).select(
        "page_id", F.col("title").alias("raw_title"), "title_length", F.get("h1", 0).alias("h1"), F.col("language").alias("lang"), "word_count"
    )


@_query("SELECT page_id, 1 AS level, len(regexp_extract_all(html, '<h1>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<h1>')) > 0")
def heading_counts(spark, sf):
    rows = pages.heading_rows(parse_raw(S.pages_table(spark, sf)))
    return rows.groupBy("page_id", "level").agg(F.count("*").alias("n"))


@_query(f"WITH {_SQL_LINKS} SELECT page_id, type, count(*) AS n FROM l2 WHERE NOT is_duplicate GROUP BY ALL")
def link_type_counts(spark, sf):
    rows = pages.page_links(parse_raw(S.pages_table(spark, sf))).where("not is_duplicate")
    return rows.groupBy("page_id", "type").agg(F.count("*").alias("n"))


@_query(f"WITH {_SQL_LINKS} SELECT page_id, pos::INT AS pos, is_duplicate FROM l2")
def link_dedupe(spark, sf):
    return pages.page_links(parse_raw(S.pages_table(spark, sf))).select("page_id", "pos", "is_duplicate")


@_query(_with("SELECT location, count(*) AS n FROM links WHERE src <> dst GROUP BY location"))
def link_locations(spark, sf):
    return graph.link_locations(S.site(spark, sf), S.links(spark, sf))


@_query(f"SELECT page_id, {_SQL_WORDS.format(_SQL_MAIN)}::INT AS words FROM pages")
def word_count(spark, sf):
    parsed = parse_raw(S.pages_table(spark, sf))
    return parsed.select("page_id", T.count_words(F.col("main_content")).alias("words"))


@_query(f"""
WITH {_SQL_LINKS}, m AS (SELECT p.page_id, {_SQL_WORDS.format(_SQL_BODY)} AS words, regexp_matches(html, '<h[1-6]>') AS headings,
  (SELECT count(*) FROM l2 WHERE l2.page_id = p.page_id AND NOT is_duplicate AND type IN ('internal', 'external')) AS links,
  regexp_matches(html, '<div[^>]+id="(root|app|__next|__nuxt|svelte)"[^>]*>\\s*</div>') AS root,
  regexp_matches(html, '(?i)data-reactroot|__NEXT_DATA__|react(-dom)?(\\.production)?(\\.min)?\\.js|data-v-app|__NUXT__|vue(\\.runtime)?(\\.global)?(\\.prod)?(\\.min)?\\.js|ng-version|ng-app|<app-root|__sveltekit|svelte-') AS fw FROM pages p)
SELECT page_id, words < 50 OR root OR (fw AND (NOT headings OR links < 3)) AS required FROM m""")
def render_required(spark, sf):
    source = S.pages_table(spark, sf)
    parsed = pages.parse_pages(source)
    rows = parsed.join(source.select("page_id", "html"), "page_id")
    reasons = render.render_reasons(
        F.col("html"), F.col("word_count"), F.size("headings"), F.col("internal_links_count") + F.col("external_links_count")
    )
    return rows.select("page_id", render.render_required(reasons).alias("required"))


# --- Audits. Rules that these pages can fire, in SQL; the others are tested on fixtures.

_SQL_AUDIT = f"""
{_SQL_LINKS.strip()},
m AS (SELECT page_id, length({_SQL_TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title, {_SQL_WORDS.format(_SQL_MAIN)} AS main, {_SQL_WORDS.format(_SQL_TEXT.format("regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<nav>.*?</nav>', ' ', 'gs'), '<footer>.*$', ' ', 'gs')"))} AS content FROM pages),
empties AS (SELECT page_id, count(*) AS n FROM l2 WHERE NOT is_duplicate AND trim(text) = '' GROUP BY page_id),
issues AS (
  SELECT page_id, 'TITLE_MISSING' AS code, 1 AS n FROM m WHERE title = 0
  UNION ALL SELECT page_id, 'TITLE_TOO_SHORT', 1 FROM m WHERE title BETWEEN 1 AND 29
  UNION ALL SELECT page_id, 'TITLE_TOO_LONG', 1 FROM m WHERE title > 60
  UNION ALL SELECT page_id, unnest(['META_DESCRIPTION_MISSING', 'CANONICAL_MISSING', 'OG_TITLE_MISSING', 'OG_DESCRIPTION_MISSING', 'OG_IMAGE_MISSING', 'TWITTER_CARD_MISSING', 'STRUCTURED_DATA_NOT_FOUND']), 1 FROM m
  UNION ALL SELECT page_id, 'EMPTY_LINK', n FROM empties
  UNION ALL SELECT page_id, CASE WHEN w = 0 THEN 'EMPTY_MAIN_CONTENT' WHEN w < 100 THEN 'VERY_THIN_CONTENT' ELSE 'THIN_CONTENT' END, 1
    FROM (SELECT page_id, CASE WHEN content > 0 AND (main = 0 OR round(main / content, 2) < 0.5) THEN content ELSE main END AS w FROM m) WHERE w < 300),
rules AS (SELECT * FROM {{rules}} r(code, category, severity)),
rated AS (SELECT i.*, r.category, r.severity FROM issues i JOIN rules r USING (code)),
scores AS (SELECT m.page_id, greatest(0, least(100, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN least(15 * n, 30) WHEN 'warning' THEN least(5 * n, 10) ELSE 0 END), 0)))::INT AS score
  FROM m LEFT JOIN rated USING (page_id) GROUP BY m.page_id)"""


def _rules_sql() -> str:
    from weblens.operators.rules import PAGE_RULES

    return _values(PAGE_RULES)


def _audit_sql(rest: str) -> str:
    return "WITH " + _SQL_AUDIT.replace("{rules}", _rules_sql()) + "\n" + rest


def audited(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_pages(pages.parse_pages(S.pages_table(spark, sf)))


@_query(_audit_sql("SELECT page_id, score FROM scores"))
def audit_score(spark, sf):
    return audited(spark, sf).select("page_id", "score")


@_query(_audit_sql("""SELECT m.page_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info FROM m LEFT JOIN rated USING (page_id) GROUP BY m.page_id"""))
def audit_counts(spark, sf):
    rows = audited(spark, sf)
    return rows.select("page_id", *(F.col(f"{s}_count").alias(s) for s in ("critical", "warning", "info")))


@_query(_audit_sql("""SELECT CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'needs_improvement' ELSE 'poor' END AS grade,
  count(*) AS n FROM scores GROUP BY 1"""))
def audit_grade(spark, sf):
    return audited(spark, sf).groupBy("grade").agg(F.count("*").alias("n"))


@_query(_audit_sql("""SELECT m.page_id, upper(g) || '_OK' AS code FROM m, (SELECT unnest(['metadata', 'headings', 'canonical', 'hreflang', 'images', 'links', 'robots', 'open_graph', 'twitter', 'content', 'structured_data']) AS g)
  WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r.page_id = m.page_id AND r.category = g)"""))
def passed_groups(spark, sf):
    return audit.issue_rows(audited(spark, sf), "page_id", passed=True).where("severity = 'passed'").select("page_id", "code")


@_query(_audit_sql("SELECT code, category, severity, count(*) AS n FROM rated GROUP BY ALL"))
def issue_rule_join(spark, sf):
    rows = audit.issue_rows(audited(spark, sf), "page_id").groupBy("code").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rule_table(spark)), "code").select("code", "category", "severity", "n")


@_query(_audit_sql("SELECT code, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pages), 2)::DOUBLE AS pct FROM issues GROUP BY code"))
def issue_rollup(spark, sf):
    source = S.pages_table(spark, sf)
    rows = audit.issue_rows(audit.audit_pages(pages.parse_pages(source)), "page_id")
    return rollup.issue_rollup(rows, source.count()).select("code", "n", "pct")


@_query(_audit_sql("""SELECT * FROM (SELECT code, row_number() OVER (PARTITION BY code ORDER BY page_id)::INT AS rn, page_id FROM issues) WHERE rn <= 5"""))
def issue_examples(spark, sf):
    return rollup.issue_examples(audit.issue_rows(audited(spark, sf), "page_id")).select("code", "rn", "page_id")


@_query(_audit_sql("SELECT DISTINCT page_id FROM issues WHERE code = 'TITLE_TOO_SHORT'"))
def pages_with_issue(spark, sf):
    return audit.pages_with_issue(audited(spark, sf), "TITLE_TOO_SHORT").select("page_id")


@_query(_audit_sql("""SELECT s.page_id, printf('**Score:** %d/100 (%s) | critical %d, warning %d', score,
    CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'needs_improvement' ELSE 'poor' END,
    count(*) FILTER (severity = 'critical'), count(*) FILTER (severity = 'warning')) AS header_line
  FROM scores s LEFT JOIN rated USING (page_id) GROUP BY s.page_id, score"""))
def report_markdown(spark, sf):
    text = report.markdown(audited(spark, sf))
    return text.select("page_id", F.regexp_extract("markdown", r"(\*\*Score:\*\* [^\n]*warning \d+)", 1).alias("header_line"))


@_query("""
WITH t AS (SELECT page_id, lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS v FROM pages)
SELECT page_id, count(*) OVER (PARTITION BY v) - 1 AS shared_with FROM t WHERE v <> '' QUALIFY count(*) OVER (PARTITION BY v) > 1""")
def duplicate_title(spark, sf):
    return rollup.duplicates(parse_raw(S.pages_table(spark, sf)).select("page_id", "title"), "title")


@_query("""
WITH t AS (SELECT lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS v FROM pages)
SELECT 'DUPLICATE_TITLE' AS code, count(*) AS count FROM (SELECT 1 FROM t WHERE v <> '' QUALIFY count(*) OVER (PARTITION BY v) > 1)""")
def duplicate_issues(spark, sf):
    return rollup.duplicate_issues(parse_raw(S.pages_table(spark, sf)).select("page_id", "title", "meta_description")).where("code = 'DUPLICATE_TITLE'")


_ADVICE = ", ".join("('{}', '{}')".format(code, text.replace("'", "''")) for code, text in ADVICE.items())


@_query(_audit_sql(f"SELECT code, count(*) AS n, recommendation FROM issues JOIN (VALUES {_ADVICE}) v(code, recommendation) USING (code) GROUP BY ALL"))
def issue_recommendations(spark, sf):
    source = S.pages_table(spark, sf)
    rows = audit.issue_rows(audit.audit_pages(pages.parse_pages(source)), "page_id")
    return rollup.issue_rollup(rows, source.count()).select("code", "n", "recommendation")


_HEADS = [(p, k, v) for p, levels in enumerate(([1, 2, 3], [1, 3, 2, 4], [3, 4, 6], [2], [1, 1, 5, 6], [6, 1, 2])) for k, v in enumerate(levels)]


@_query(f"""SELECT page_id::BIGINT AS page_id, sum((level > before + 1)::INT)::BIGINT AS n_skips FROM (
  SELECT page_id, level, coalesce(lag(level) OVER (PARTITION BY page_id ORDER BY pos), 9) AS before FROM {_values(_HEADS)} v(page_id, pos, level)) GROUP BY page_id""")
def heading_skips(spark, sf):
    return pages.heading_skips(spark.createDataFrame(_HEADS, "page_id long, pos int, level int"))


_SOFT = [("u1", "404 Not Found", ""), ("u2", "Welcome", "Page not found"), ("u3", "ไม่พบหน้า", ""), ("u4", "Model 4040", "Fine"), ("u5", "Sorry, this page doesn't exist", ""), ("u6", "Knot foundry", "")]


@_query(f"SELECT url, regexp_matches(title || ' ' || h1, '(?i)\\b(404|not found|page not found|page doesn.t exist)\\b|ไม่พบ(หน้า)?') AS flag FROM {_values(_SOFT)} v(url, title, h1)")
def soft_404(spark, sf):
    rows = spark.createDataFrame(_SOFT, "url string, title string, h1 string")
    return rows.select("url", T.soft_404(F.col("title"), F.col("h1")).alias("flag"))


_DIRECTIVES = ["noindex, follow", "NONE", "googlebot: noindex", "googlebot:noindex", "index, follow", "noimageindex", "", "max-snippet:20,noindex"]


@_query(f"""SELECT input, len(list_filter(regexp_split_to_array(lower(input), '[,\\s]+'), lambda t: list_last(string_split(t, ':')) IN ('noindex', 'none'))) > 0 AS flag
  FROM {_values([(d,) for d in _DIRECTIVES])} v(input)""")
def noindex_tokens(spark, sf):
    rows = spark.createDataFrame([(d,) for d in _DIRECTIVES], "input string")
    return rows.select("input", T.noindex(F.col("input")).alias("flag"))


# --- Site relations


def page_state_rows(spark: SparkSession, sf: str) -> DataFrame:
    return states.page_states(S.site(spark, sf))


@_query(_with("SELECT key AS page_id, depth::INT AS depth, row_number() OVER (ORDER BY depth NULLS LAST, key) AS rn FROM site WHERE crawl_status = 'ok' ORDER BY 3 LIMIT 50"))
def page_list(spark, sf):
    rows = S.site(spark, sf).where("crawl_status = 'ok'").select(F.col("key").alias("page_id"), "depth")
    rows = rows.orderBy(F.col("depth").asc_nulls_last(), "page_id").limit(50)
    place = F.row_number().over(Window.orderBy(F.col("depth").asc_nulls_last(), "page_id"))
    return rows.withColumn("rn", place.cast("long"))


@_query(_with("SELECT key AS page_id FROM states WHERE indexable"))
def pages_indexable(spark, sf):
    return page_state_rows(spark, sf).where("indexable = true").select(F.col("key").alias("page_id"))


@_query(_with("SELECT key AS page_id FROM site ORDER BY depth NULLS LAST, key LIMIT 25 OFFSET 50"))
def pagination(spark, sf):
    rows = S.site(spark, sf).orderBy(F.col("depth").asc_nulls_last(), "key").offset(50).limit(25)
    return rows.select(F.col("key").alias("page_id"))


@_query(_with("""SELECT CASE WHEN crawl_status = 'blocked_robots' THEN 'blocked_by_robots' WHEN crawl_status = 'redirect' THEN 'redirects' WHEN crawl_status = 'error' THEN 'failed_requests'
  WHEN kind <> 'document' OR crawl_status = 'non_html' THEN CASE WHEN coalesce(status_code, 0) >= 400 THEN 'assets_broken' ELSE 'assets_and_non_html_ok' END
  WHEN coalesce(status_code, 0) >= 400 THEN 'html_error_pages' ELSE 'html_pages_ok' END AS bucket, count(*) AS n FROM site GROUP BY 1"""))
def url_counts(spark, sf):
    return states.url_counts(S.site(spark, sf))


@_query(_with(" UNION ALL ".join(f"SELECT '{s}' AS state, count(*) FILTER ({s}) AS true_n, count(*) FILTER (NOT {s}) AS false_n, count(*) FILTER ({s} IS NULL) AS unknown_n FROM full_states" for s in states.STATES)))
def state_summary(spark, sf):
    return states.state_summary(page_state_rows(spark, sf))


@_query(_with("SELECT canonical_status AS status, count(*) AS n FROM full_states GROUP BY 1"))
def canonical_status(spark, sf):
    return page_state_rows(spark, sf).groupBy(F.col("canonical_status").alias("status")).agg(F.count("*").alias("n"))


@_query(_with("""
, fired AS (SELECT unnest(list_filter([
  CASE WHEN in_sitemap AND (crawl_status = 'error' OR coalesce(status_code, 0) >= 400) THEN 'SITEMAP_URL_NON_200' END,
  CASE WHEN in_sitemap AND crawl_status = 'redirect' THEN 'SITEMAP_URL_REDIRECT' END,
  CASE WHEN in_sitemap AND crawl_status = 'blocked_robots' THEN 'SITEMAP_URL_BLOCKED' END,
  CASE WHEN in_sitemap AND renderable AND NOT indexable THEN 'SITEMAP_URL_NOINDEX' END,
  CASE WHEN in_sitemap AND NOT canonical THEN 'SITEMAP_URL_CANONICALIZED' END,
  CASE WHEN renderable AND NOT indexable THEN 'NOINDEX_PAGES' END,
  CASE WHEN NOT fetchable AND kind = 'document' THEN 'BROKEN_PAGES' END,
  CASE WHEN NOT crawlable THEN 'ROBOTS_BLOCKED_PAGES' END,
  CASE WHEN canonical_status IN ('private_host', 'target_not_indexable', 'invalid') THEN 'CANONICAL_TO_NON_INDEXABLE' END,
  CASE WHEN NOT canonical AND canonical_status NOT IN ('private_host', 'target_not_indexable', 'invalid') THEN 'CANONICALIZED_PAGES' END], lambda c: c IS NOT NULL)) AS code FROM full_states)
SELECT code, count(*) AS n FROM fired GROUP BY code""").replace("\n\n, fired", ", fired"))
def site_issues(spark, sf):
    return states.site_issues(page_state_rows(spark, sf)).select("code", F.col("count").alias("n"))


@_query(_with("SELECT s.key AS page_id, EXISTS (SELECT 1 FROM site m WHERE m.in_sitemap AND m.key = s.key) AS flag FROM site s"))
def in_sitemap(spark, sf):
    rows = S.site(spark, sf)
    listed = rows.where("in_sitemap").select("key", F.lit(True).alias("listed")).distinct()
    return rows.select("key").join(listed, "key", "left").select(F.col("key").alias("page_id"), F.coalesce("listed", F.lit(False)).alias("flag"))


@_query(_with("SELECT key AS page_id FROM full_states WHERE crawl_status = 'ok' AND indexable AND canonical AND NOT in_sitemap"))
def missing_from_sitemap(spark, sf):
    rows = page_state_rows(spark, sf)
    return states.missing_from_sitemap(rows, S.site(spark, sf).where("in_sitemap").select("key")).select(F.col("key").alias("page_id"))


@_query(_with("SELECT key AS page_id FROM site WHERE in_sitemap EXCEPT SELECT key FROM site WHERE crawl_status = 'ok'"))
def pending_sitemap(spark, sf):
    rows = S.site(spark, sf)
    listed = rows.where("in_sitemap").select(F.col("key").alias("page_id"))
    return listed.exceptAll(rows.where("crawl_status = 'ok' and in_sitemap").select(F.col("key").alias("page_id"))).distinct()


_LISTED = ["https://e.com/a", "https://e.com/a/", "https://E.com/a#x", "https://e.com/b?utm_source=q", "https://e.com/b", "https://e.com/c", "https://e.com/d?b=1&a=2", "https://e.com/d?a=2&b=1"]


@_query("SELECT key, n::BIGINT AS n FROM (VALUES ('https://e.com/a', 3), ('https://e.com/b', 2), ('https://e.com/d?a=2&b=1', 2)) v(key, n)")
def sitemap_duplicates(spark, sf):
    rows = spark.createDataFrame([("xml", _LISTED)], "format string, urls array<string>")
    return sitemaps.sitemap_duplicates(rows)


_FILES = [
    ("a", "ok", 3, False, "ok", True, None), ("b", "empty", 0, False, "empty", True, None), ("c", "html", 0, False, "html_instead_of_xml", False, "sitemap_html_response"),
    ("d", "ok", 5, False, "partial", False, "sitemap_parse_error"), ("d", "parse_error", 0, False, None, None, None), ("e", "http_404", 0, False, "not_found", False, "sitemap_http_error"),
    ("f", "ok", 9, True, "partial", False, "sitemap_safety_limit"), ("g", "unsupported_format", 0, False, "unsupported_format", False, "sitemap_unsupported_format"),
    ("h", "fetch_error", 0, False, "html_instead_of_xml", False, "sitemap_html_response"), ("h", "html", 0, False, None, None, None),
]


@_query(f"SELECT case_id, status, read_complete, stop_reason FROM {_values([r for r in _FILES if r[4]])} v(case_id, result, n_urls, limit_hit, status, read_complete, stop_reason)")
def sitemap_status(spark, sf):
    rows = spark.createDataFrame([r[:4] for r in _FILES], "case_id string, result string, n_urls int, limit_hit boolean")
    return sitemaps.site_status(rows, "case_id")


_ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /tmp\n\nUser-agent: SeoAuditBot\nAllow: /admin/help\nDisallow: /admin\nDisallow:\n"
_ASKED = [("https://e.com/", True), ("https://e.com/admin", False), ("https://e.com/admin/help", True), ("https://e.com/admin/x", False), ("https://e.com/private/x", True), ("https://e.com/tmp", True)]


@_query(f"SELECT url, allowed FROM {_values(_ASKED)} v(url, allowed)")
def robots_allowed(spark, sf):
    rules = sitemaps.robots_rules(spark.createDataFrame([("e", _ROBOTS)], "site string, text string"), "SeoAuditBot/1.0")
    urls = spark.createDataFrame([("e", u) for u, _ in _ASKED], "site string, url string")
    return sitemaps.robots_allowed(urls, rules).select("url", "allowed")


@_query(_with("SELECT crawl_status, count(*) AS n FROM site GROUP BY 1"))
def crawl_stats(spark, sf):
    return S.site(spark, sf).groupBy("crawl_status").agg(F.count("*").alias("n"))


_COVER = [
    ("full", False, 100, 0, 0, "ok", 100, 200, 0), ("langs", False, 50, 0, 0, "ok", 50, 200, 2), ("limit", False, 200, 0, 0, "ok", 200, 200, 0),
    ("left", False, 304, 274, 0, "ok", 30, 30, 0), ("deep", False, 40, 0, 7, None, 40, 200, 0), ("gap", False, 40, 0, 0, "partial", 40, 200, 0),
    ("broken", True, 10, 3, 0, None, 7, 200, 0), ("plain", False, 12, 0, 0, "not_found", 12, 200, 0), ("none", False, 0, 0, 0, None, 0, 200, 0),
]
_COVER_COLUMNS = "case_id, failed, discovered, remaining, skipped_depth, sitemap_status, fetched, max_pages, languages_missing"


@_query(f"""
WITH c AS (SELECT * FROM {_values(_COVER)} v({_COVER_COLUMNS})),
s AS (SELECT *, CASE WHEN failed OR remaining > 0 OR skipped_depth > 0 OR sitemap_status = 'partial' THEN 'partial' WHEN fetched >= max_pages THEN 'crawl_limit_reached' ELSE 'full_known_scope' END AS scope FROM c),
v AS (SELECT *, scope = 'full_known_scope' AND coalesce(sitemap_status, '') = 'ok' AND languages_missing = 0 AS verified FROM s)
SELECT case_id, scope, CASE WHEN verified THEN 'high' WHEN scope = 'full_known_scope' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN scope <> 'full_known_scope' THEN scope WHEN languages_missing > 0 THEN 'scoped_complete_other_languages_not_crawled' WHEN verified THEN 'sitemap_verified_complete' ELSE 'scoped_complete' END AS coverage_confidence,
  CASE WHEN discovered > 0 THEN round(100.0 * (discovered - remaining) / discovered, 2) ELSE 0 END::DOUBLE AS pct FROM v""")
def crawl_coverage(spark, sf):
    kinds = "case_id string, failed boolean, discovered int, remaining int, skipped_depth int, sitemap_status string, fetched int, max_pages int, languages_missing int"
    return crawl.coverage(spark.createDataFrame(_COVER, kinds)).select("case_id", "scope", "confidence", "coverage_confidence", F.col("pct").cast("double").alias("pct"))


_ALTERNATES = [("en", "https://e.com/en/a"), ("en", "https://e.com/en/b"), ("th", "http://10.0.0.5/th/a"), ("th", "http://10.0.0.5/th/b"), ("x-default", "https://e.com/"), ("de", "https://e.com/de/a")]
_CRAWLED = ["https://e.com/en/a", "https://e.com/th/a", "https://e.com/"]


@_query("SELECT lang, urls::BIGINT AS urls, crawled::BIGINT AS crawled, private FROM (VALUES ('en', 2, 1, false), ('th', 2, 1, true), ('x-default', 1, 1, false), ('de', 1, 0, false)) v(lang, urls, crawled, private)")
def language_scope(spark, sf):
    rows = spark.createDataFrame(_ALTERNATES, "lang string, url string")
    return crawl.language_scope(rows, spark.createDataFrame([(u,) for u in _CRAWLED], "key string"), "e.com")


# --- Graph


@_query(_with("""SELECT l.src, l.dst, coalesce(s.status_code::VARCHAR, s.crawl_status) AS status FROM links l JOIN site s ON l.dst = s.key
  WHERE l.src <> l.dst AND (s.crawl_status = 'error' OR s.status_code >= 400)"""))
def broken_links(spark, sf):
    return graph.broken_links(S.site(spark, sf), S.links(spark, sf)).select("src", "dst", "status")


@_query(_with("SELECT l.src, l.dst, s.redirect_to FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND s.crawl_status = 'redirect'"))
def redirected_links(spark, sf):
    return graph.redirected_links(S.site(spark, sf), S.links(spark, sf))


@_query(_with("SELECT key AS page_id, final_key AS final_id, hops FROM final"))
def redirect_chain(spark, sf):
    return graph.resolve_redirects(S.site(spark, sf)).select(F.col("key").alias("page_id"), F.col("final_key").alias("final_id"), "hops")


@_query(_with("SELECT key AS page_id, unique_in, unique_out FROM in_out"))
def inlinks_outlinks(spark, sf):
    return graph.inlinks_outlinks(S.site(spark, sf), S.links(spark, sf)).withColumnRenamed("key", "page_id")


@_query(_with("SELECT s.key AS page_id, (SELECT count(*) FROM links l WHERE l.dst = s.key AND l.src <> l.dst) AS n FROM site s"))
def internal_links_in(spark, sf):
    return crawl.internal_links_in(S.site(spark, sf), S.links(spark, sf)).withColumnRenamed("key", "page_id")


@_query(_with("SELECT coalesce(depth::VARCHAR, 'sitemap_only') AS depth_key, count(*) AS n FROM live GROUP BY 1"))
def depth_distribution(spark, sf):
    return graph.depth_distribution(S.site(spark, sf))


_ROUNDS = 10


def _pagerank_sql() -> str:
    steps = ["nodes AS (SELECT l.key, count(e.src) AS degree FROM live l LEFT JOIN edges e ON l.key = e.src GROUP BY l.key)", "size AS (SELECT count(*)::DOUBLE AS m FROM live)",
             "r0 AS (SELECT key, degree, 1.0 / m AS rank FROM nodes, size)"]
    for k in range(1, _ROUNDS + 1):
        steps.append(
            f"""r{k} AS (SELECT n.key, n.degree, 0.15 / m + 0.85 * coalesce((SELECT sum(rank) FROM r{k - 1} WHERE degree = 0), 0) / m + 0.85 * coalesce(g.got, 0) AS rank
  FROM nodes n CROSS JOIN size LEFT JOIN (SELECT e.dst, sum(r.rank / r.degree) AS got FROM edges e JOIN r{k - 1} r ON e.src = r.key GROUP BY e.dst) g ON n.key = g.dst)"""
        )
    return ", " + ", ".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps)


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    site, links = S.site(spark, sf), S.links(spark, sf)
    return graph.pagerank(site.where(graph.live()), graph.edges(site, links), iterations=_ROUNDS, tolerance=0)


_SQL_AUTHORITY = f"{_pagerank_sql()}, auth AS (SELECT key, round(100 * rank / (SELECT max(rank) FROM r{_ROUNDS}), 1) AS authority FROM r{_ROUNDS})"
_SQL_FLAGS = f"""{_SQL_AUTHORITY}, cut AS (SELECT authority AS least FROM auth ORDER BY authority DESC LIMIT 1 OFFSET (SELECT greatest(0, count(*) // 5 - 1) FROM auth)),
flags AS (SELECT key, authority, unnest(list_filter([
  CASE WHEN via <> 'root' AND unique_in = 0 THEN 'orphan_candidate' END, CASE WHEN via <> 'root' AND unique_in = 1 THEN 'weak_internal_linking' END,
  CASE WHEN unique_out = 0 THEN 'dead_end' END, CASE WHEN depth >= 4 THEN 'deep' END,
  CASE WHEN depth >= 4 AND (authority >= least OR in_sitemap) THEN 'important_but_deep' END], lambda f: f IS NOT NULL)) AS flag
  FROM in_out JOIN live USING (key) JOIN auth USING (key), cut)"""


@_query(_with(f"{_pagerank_sql()} SELECT key AS page_id, round(rank, 8) AS rank FROM r{_ROUNDS}").replace("\n, ", ", "))
def pagerank(spark, sf):
    return _ranks(spark, sf).select(F.col("key").alias("page_id"), F.round("rank", 8).alias("rank"))


@_query(_with(f"{_SQL_AUTHORITY} SELECT key AS page_id, authority FROM auth ORDER BY authority DESC, key LIMIT 20").replace("\n, ", ", "))
def top_authority(spark, sf):
    return graph.top_pages(graph.authority(_ranks(spark, sf)), 20).select(F.col("key").alias("page_id"), "authority")


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return graph.page_flags(S.site(spark, sf), S.links(spark, sf), graph.authority(_ranks(spark, sf)))


@_query(_with(f"{_SQL_FLAGS} SELECT key AS page_id, flag FROM flags").replace("\n, ", ", "))
def page_flags(spark, sf):
    return _flags(spark, sf).select(F.col("key").alias("page_id"), F.explode("flags").alias("flag"))


@_query(_with(f"{_SQL_FLAGS} SELECT key AS page_id FROM flags WHERE flag = 'important_but_deep'").replace("\n, ", ", "))
def important_pages(spark, sf):
    return _flags(spark, sf).where(F.array_contains("flags", "important_but_deep")).select(F.col("key").alias("page_id"))


@_query(_with(f"{_SQL_FLAGS} SELECT flag, key AS page_id, row_number() OVER (PARTITION BY flag ORDER BY authority DESC, key)::INT AS rn FROM flags").replace("\n, ", ", "))
def flagged_pages(spark, sf):
    return graph.flagged_pages(_flags(spark, sf)).select("flag", F.col("key").alias("page_id"), "rn")


@_query(_with(f"""{_SQL_FLAGS}
SELECT CASE flag WHEN 'orphan_candidate' THEN 'ORPHAN_PAGE_CANDIDATES' WHEN 'dead_end' THEN 'DEAD_END_PAGES' WHEN 'weak_internal_linking' THEN 'WEAKLY_LINKED_PAGES'
  WHEN 'important_but_deep' THEN 'IMPORTANT_PAGES_TOO_DEEP' ELSE 'DEEP_PAGES' END AS code, count(*) AS n FROM flags GROUP BY 1
UNION ALL SELECT 'REDIRECTED_INTERNAL_LINKS', count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND s.crawl_status = 'redirect'
UNION ALL SELECT 'BROKEN_INTERNAL_LINKS', count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND (s.crawl_status = 'error' OR s.status_code >= 400)""").replace("\n, ", ", "))
def architecture_issues(spark, sf):
    site, links = S.site(spark, sf), S.links(spark, sf)
    return graph.architecture_issues(site, links, _flags(spark, sf)).select("code", F.col("count").alias("n"))


@_query(_with("""SELECT 1""").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT 1", "").rstrip() + """,
reach AS (SELECT 5::BIGINT AS key, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON r.key = e.src WHERE r.depth < 5)
SELECT key AS page_id, min(depth) AS depth FROM reach GROUP BY key""")
def bfs_depth(spark, sf):
    site, links = S.site(spark, sf), S.links(spark, sf)
    start = spark.createDataFrame([(S.ROOT,)], "key long")
    return crawl.click_depth(graph.edges(site, links), start, 5).select(F.col("key").alias("page_id"), "depth")


# --- Findings

_DETECTED = [
    ("/a", "CANONICAL_PRIVATE_IP", True), ("/a", "HREFLANG_PRIVATE_IP", True), ("/a", "CANONICAL_HTTP_WHEN_PAGE_HTTPS", True), ("/a", "TITLE_TOO_SHORT", True),
    ("/b", "HREFLANG_PRIVATE_IP", True), ("/b", "CANONICAL_HTTP_WHEN_PAGE_HTTPS", True), ("/c", "CANONICAL_MISSING", True), ("/c", "OG_TITLE_MISSING", True),
    ("/d", "CANONICAL_MISSING", False), ("/d", "META_DESCRIPTION_MISSING", False), ("/e", "META_DESCRIPTION_MISSING", True),
]
_CAUSES = [
    ("/a", "CANONICAL_PRIVATE_IP", "PRIVATE_BASE_URL_CONFIGURATION"), ("/a", "HREFLANG_PRIVATE_IP", "PRIVATE_BASE_URL_CONFIGURATION"),
    ("/a", "CANONICAL_HTTP_WHEN_PAGE_HTTPS", "PRIVATE_BASE_URL_CONFIGURATION"), ("/b", "HREFLANG_PRIVATE_IP", "PRIVATE_BASE_URL_CONFIGURATION"),
    ("/c", "CANONICAL_MISSING", "ROUTE_HEAD_METADATA_MISSING"), ("/c", "OG_TITLE_MISSING", "ROUTE_HEAD_METADATA_MISSING"),
]


def _detections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DETECTED, "url string, code string, rendered boolean")


@_query(f"""SELECT d.url, d.code, c.root_cause FROM {_values(_DETECTED)} d(url, code, rendered) LEFT JOIN {_values(_CAUSES)} c(url, code, root_cause) USING (url, code)""")
def root_cause_explained(spark, sf):
    rows = _detections(spark)
    found = rollup.root_causes(rows, "url", F.col("rendered"))
    return rows.select("url", "code").join(found, ["url", "code"], "left")


@_query(f"SELECT root_cause, code, count(*) AS n FROM {_values(_CAUSES)} c(url, code, root_cause) GROUP BY ALL")
def root_cause_rollup(spark, sf):
    return rollup.root_cause_rollup(rollup.root_causes(_detections(spark), "url", F.col("rendered")))


#: Of the derived site, pages with an even id were rendered, so that a missing head explains what they lack.
_SQL_FINDINGS = """,
causes AS (SELECT page_id, code FROM issues WHERE page_id % 2 = 0 AND code IN ('CANONICAL_MISSING', 'META_DESCRIPTION_MISSING', 'OG_TITLE_MISSING', 'OG_DESCRIPTION_MISSING')),
of_site AS (
  SELECT 'BROKEN_PAGES' AS code, 'indexability' AS category, 'warning' AS severity, count(*) AS affected FROM full_states WHERE NOT fetchable AND kind = 'document' HAVING count(*) > 0
  UNION ALL SELECT 'NOINDEX_PAGES', 'indexability', 'info', count(*) FROM full_states WHERE renderable AND NOT indexable HAVING count(*) > 0
  UNION ALL SELECT 'ROBOTS_BLOCKED_PAGES', 'indexability', 'info', count(*) FROM full_states WHERE NOT crawlable HAVING count(*) > 0
  UNION ALL SELECT 'CANONICAL_TO_NON_INDEXABLE', 'indexability', 'critical', count(*) FROM full_states WHERE canonical_status IN ('private_host', 'target_not_indexable', 'invalid') HAVING count(*) > 0
  UNION ALL SELECT 'CANONICALIZED_PAGES', 'indexability', 'info', count(*) FROM full_states WHERE NOT canonical AND canonical_status NOT IN ('private_host', 'target_not_indexable', 'invalid') HAVING count(*) > 0
  UNION ALL SELECT 'REDIRECTED_INTERNAL_LINKS', 'architecture', 'warning', count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND s.crawl_status = 'redirect' HAVING count(*) > 0
  UNION ALL SELECT 'BROKEN_INTERNAL_LINKS', 'architecture', 'critical', count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND (s.crawl_status = 'error' OR s.status_code >= 400) HAVING count(*) > 0),
total AS (SELECT count(*) AS t FROM pages)
SELECT code, NULL AS root_cause, 'site' AS level, category, severity, affected, CASE WHEN code LIKE '%LINKS' THEN 'links' ELSE 'URLs' END AS affected_unit,
  CASE WHEN code LIKE '%LINKS' THEN NULL WHEN code IN ('BROKEN_PAGES', 'ROBOTS_BLOCKED_PAGES') THEN 'counts.recorded_urls' ELSE 'counts.html_pages_ok' END AS denominator,
  CASE WHEN code NOT LIKE '%LINKS' THEN round(100.0 * affected / t, 2)::DOUBLE END AS percentage, 'issues' AS drilldown FROM of_site, total
UNION ALL SELECT 'ROUTE_HEAD_METADATA_MISSING', 'ROUTE_HEAD_METADATA_MISSING', 'page_root_cause', 'root_cause', 'warning', count(DISTINCT page_id), 'pages', 'counts.html_pages_ok',
  round(100.0 * count(DISTINCT page_id) / any_value(t), 2)::DOUBLE, 'pages?issue=' || min(code) || '&include_audit=true' FROM causes, total HAVING count(*) > 0
UNION ALL SELECT r.code, NULL, 'page', r.category, r.severity, count(*), 'pages', 'counts.html_pages_ok', round(100.0 * count(*) / any_value(t), 2)::DOUBLE,
  'pages?issue=' || r.code || '&include_audit=true' FROM rated r ANTI JOIN causes c USING (page_id, code), total GROUP BY r.code, r.category, r.severity"""
def _found_issues(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, code) of every detection, and which of them a root cause explains. Both are read more than once, and pages are parsed once."""
    issues = materialize(audit.issue_rows(audited(spark, sf), "page_id").select("page_id", "code"), "issues")
    return issues, materialize(rollup.root_causes(issues, "page_id", F.col("page_id") % 2 == 0), "causes")


_FINDINGS = ("code", "root_cause", "level", "category", "severity", "affected", "affected_unit", "denominator", "percentage", "drilldown")


@_query(_audit_sql("SELECT 1").removesuffix("\nSELECT 1") + ", " + S.SQL.strip() + _SQL_FINDINGS)
def findings_union(spark, sf):
    total = S.pages_table(spark, sf).count()
    issues, causes = _found_issues(spark, sf)
    site, links = materialize(S.site(spark, sf), "site"), S.links(spark, sf)
    of_pages = states.site_issues(materialize(states.page_states(site), "states"), use_sitemaps=False)
    of_links = graph.architecture_issues(site, links, site.limit(0).select("key", F.array().cast("array<string>").alias("flags")))
    # At most a row for each rule or cause from here on; the list names each of them more than once.
    of_site = rollup.merge_site_issues(materialize(of_pages, "of_pages"), materialize(of_links, "of_links")).withColumnRenamed("count", "affected")
    summary = materialize(rollup.root_cause_summary(causes, total), "summary")
    listed = rollup.findings(of_site, summary, rollup.issue_rollup(issues, total, causes), total, total)
    return listed.select(*_FINDINGS)


@_query(_audit_sql("""SELECT 'ROUTE_HEAD_METADATA_MISSING' AS root_cause, code, count(*) AS n FROM issues
  WHERE page_id % 2 = 0 AND code IN ('CANONICAL_MISSING', 'META_DESCRIPTION_MISSING', 'OG_TITLE_MISSING', 'OG_DESCRIPTION_MISSING') GROUP BY code"""))
def root_cause_detections(spark, sf):
    causes = rollup.root_cause_summary(_found_issues(spark, sf)[1], 1)
    return causes.select("root_cause", F.explode("detections").alias("code", "n"))


# --- More of the site's relations


@_query(_with("""SELECT canonical_status, count(*) AS n, count(*) FILTER (indexable) AS still_indexable FROM full_states
  WHERE canonical_status IN ('private_host', 'target_not_indexable', 'invalid') GROUP BY 1"""))
def canonical_defects(spark, sf):
    return states.canonical_defects(page_state_rows(spark, sf))


@_query(_with("""SELECT count(*) AS recorded_urls, count(*) FILTER (crawl_status = 'ok' AND coalesce(status_code, 0) < 400) AS html_pages_ok,
  count(*) FILTER (crawl_status = 'error' OR status_code >= 400) AS broken_urls FROM site"""))
def recorded_urls(spark, sf):
    return states.recorded_urls(S.site(spark, sf))


@_query(_with("SELECT 'PAGES_MISSING_FROM_SITEMAP' AS code, count(*) AS n FROM full_states WHERE crawl_status = 'ok' AND indexable AND canonical AND NOT in_sitemap HAVING count(*) > 0"))
def complete_sitemap_issues(spark, sf):
    rows = page_state_rows(spark, sf)
    whole, none = states.site_issues(rows, sitemap_complete=True), states.site_issues(rows)
    return whole.join(none, "code", "left_anti").select("code", F.col("count").alias("n"))


@_query(_with("""SELECT 'BROKEN_INTERNAL_LINKS' AS code, count(*) AS links, count(DISTINCT l.dst) AS targets FROM links l JOIN site s ON l.dst = s.key
  WHERE l.src <> l.dst AND (s.crawl_status = 'error' OR s.status_code >= 400) HAVING count(*) > 0"""))
def broken_targets(spark, sf):
    return graph.broken_targets(S.site(spark, sf), S.links(spark, sf))


@_query(_with("""SELECT (SELECT count(*) FROM in_out) AS pages, (SELECT round(avg(unique_in), 1) FROM in_out) AS avg_unique_in, (SELECT max(depth) FROM live)::INT AS max_depth,
  (SELECT count(*) FROM followed) AS followed_links"""))
def graph_summary(spark, sf):
    return graph.graph_summary(S.site(spark, sf), S.links(spark, sf))


@_query(_with("""SELECT row_number() OVER (ORDER BY depth NULLS LAST)::INT AS rn, coalesce(depth::VARCHAR, 'sitemap_only') AS depth_key, n
  FROM (SELECT depth, count(*) AS n FROM live GROUP BY depth)"""))
def depth_order(spark, sf):
    return graph.ordered_depths(graph.depth_distribution(S.site(spark, sf)))


@_query(_with("SELECT key AS page_id FROM live WHERE kind = 'document' AND key % 7 <> 0"))
def audited_documents(spark, sf):
    rows = S.site(spark, sf).withColumn("audit", F.when(F.col("key") % 7 != 0, "{}"))
    return rollup.audited_documents(rows).select(F.col("key").alias("page_id"))


_SITE_ORDER = """SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, turn, CASE turn WHEN 0 THEN category END, code)::INT AS rn, code FROM (
  SELECT 0 AS turn, code, category, severity FROM (VALUES ('BROKEN_PAGES', 'indexability', 'warning', (SELECT count(*) FROM full_states WHERE NOT fetchable AND kind = 'document')),
    ('NOINDEX_PAGES', 'indexability', 'info', (SELECT count(*) FROM full_states WHERE renderable AND NOT indexable)),
    ('ROBOTS_BLOCKED_PAGES', 'indexability', 'info', (SELECT count(*) FROM full_states WHERE NOT crawlable)),
    ('CANONICAL_TO_NON_INDEXABLE', 'indexability', 'critical', (SELECT count(*) FROM full_states WHERE canonical_status IN ('private_host', 'target_not_indexable', 'invalid'))),
    ('CANONICALIZED_PAGES', 'indexability', 'info', (SELECT count(*) FROM full_states WHERE NOT canonical AND canonical_status NOT IN ('private_host', 'target_not_indexable', 'invalid'))),
    ('SITEMAP_URL_NON_200', 'sitemap', 'warning', (SELECT count(*) FROM full_states WHERE in_sitemap AND (crawl_status = 'error' OR status_code >= 400))),
    ('SITEMAP_URL_REDIRECT', 'sitemap', 'warning', (SELECT count(*) FROM full_states WHERE in_sitemap AND crawl_status = 'redirect')),
    ('SITEMAP_URL_BLOCKED', 'sitemap', 'warning', (SELECT count(*) FROM full_states WHERE in_sitemap AND crawl_status = 'blocked_robots')),
    ('SITEMAP_URL_NOINDEX', 'sitemap', 'warning', (SELECT count(*) FROM full_states WHERE in_sitemap AND renderable AND NOT indexable)),
    ('SITEMAP_URL_CANONICALIZED', 'sitemap', 'warning', (SELECT count(*) FROM full_states WHERE in_sitemap AND NOT canonical))) v(code, category, severity, n) WHERE n > 0
  UNION ALL SELECT 1, code, 'architecture', severity FROM (VALUES
    ('BROKEN_INTERNAL_LINKS', 'critical', (SELECT count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND (s.crawl_status = 'error' OR s.status_code >= 400))),
    ('REDIRECTED_INTERNAL_LINKS', 'warning', (SELECT count(*) FROM links l JOIN site s ON l.dst = s.key WHERE l.src <> l.dst AND s.crawl_status = 'redirect'))) v(code, severity, n) WHERE n > 0)"""


@_query(_with(_SITE_ORDER))
def site_issue_order(spark, sf):
    site, links = S.site(spark, sf), S.links(spark, sf)
    of_links = graph.architecture_issues(site, links, site.limit(0).select("key", F.array().cast("array<string>").alias("flags")))
    return rollup.merge_site_issues(states.site_issues(page_state_rows(spark, sf)), of_links).select("rn", "code")


# --- Crawl replay over the derived site, whose pages have URLs of their own here

_CRAWL_SITE = "https://site.test/p/"
_CRAWL_OPTIONS = crawl.CrawlOptions(max_pages=10**9, max_depth=3, exclude_patterns=("77$",))
_SQL_CRAWL = """,
hops AS (
  SELECT l.src, l.dst, 1 AS step FROM links l JOIN live s ON l.src = s.key WHERE NOT l.nofollow AND s.meta_robots IS DISTINCT FROM 'none' AND l.dst % 100 <> 77
  UNION ALL SELECT key, redirect_to, 0 FROM moves),
reach AS (SELECT 5::BIGINT AS key, 0 AS depth UNION SELECT h.dst, r.depth + h.step FROM reach r JOIN hops h ON r.key = h.src WHERE r.depth + h.step <= 3),
clicks AS (SELECT key, min(depth) AS depth FROM reach GROUP BY key),
late AS (SELECT key FROM site WHERE in_sitemap AND key % 100 <> 77 AND key NOT IN (SELECT key FROM clicks)
  UNION SELECT h.dst FROM late r JOIN hops h ON r.key = h.src WHERE h.dst NOT IN (SELECT key FROM clicks)),
crawled AS (SELECT key, depth FROM clicks UNION ALL SELECT key, NULL FROM late)"""


def _crawl(spark: SparkSession, sf: str) -> crawl.Crawl:
    address = lambda c: F.concat(F.lit(_CRAWL_SITE), F.col(c).cast("string"))
    site = S.site(spark, sf)
    fetches = site.select(
        address("key").alias("key"), address("key").alias("url"), "status_code", "content_type", address("redirect_to").alias("redirect_to"),
        F.coalesce(F.col("meta_robots") == "none", F.lit(False)).alias("nofollow"),
    )
    pos = F.expr("case location when 'nav' then 1 when 'main' then 2 else 3 end")
    links = S.links(spark, sf).select(address("src").alias("src"), address("dst").alias("dst"), address("dst").alias("url"), pos.alias("pos"), "nofollow")
    listed = site.where("in_sitemap").select(address("key").alias("key"), address("key").alias("url"))
    blocked = site.where("crawl_status = 'blocked_robots'").select(address("key").alias("key"))
    return crawl.run_crawl(fetches, links, f"{_CRAWL_SITE}{S.ROOT}", _CRAWL_OPTIONS, listed, blocked)


def _recursive(rows: str) -> str:
    return "WITH RECURSIVE " + S.SQL.strip() + _SQL_CRAWL + "\n" + rows


@_query(_recursive("SELECT key AS page_id, c.depth::INT AS depth, s.crawl_status, s.in_sitemap FROM crawled c JOIN site s USING (key)"))
def crawl_replay(spark, sf):
    key = F.substring_index("key", "/", -1).cast("long")
    return _crawl(spark, sf).pages.select(key.alias("page_id"), "depth", "crawl_status", "in_sitemap")


@_query(_recursive("""SELECT count(*) AS discovered_urls, count(*) FILTER (s.crawl_status = 'ok') AS crawled_ok, count(*) FILTER (s.crawl_status = 'redirect') AS redirects,
  count(*) FILTER (s.crawl_status = 'non_html') AS non_html, count(*) FILTER (s.crawl_status = 'error') AS failed, count(*) FILTER (s.crawl_status = 'blocked_robots') AS blocked_by_robots,
  (SELECT count(*) FROM hops h JOIN clicks c ON h.src = c.key WHERE h.step = 1 AND c.depth = 3 AND h.dst NOT IN (SELECT key FROM clicks)) AS skipped_depth,
  (SELECT count(*) FROM links l JOIN live v ON l.src = v.key JOIN crawled c ON l.src = c.key WHERE NOT l.nofollow AND v.meta_robots IS DISTINCT FROM 'none' AND l.dst % 100 = 77)
    + (SELECT count(*) FROM site WHERE in_sitemap AND key % 100 = 77) AS skipped_pattern,
  0 AS skipped_max_pages, (SELECT count(*) FROM site WHERE in_sitemap) AS sitemap_urls FROM crawled c JOIN site s USING (key)"""))
def crawl_diagnostics(spark, sf):
    return crawl.diagnostics(_crawl(spark, sf))
