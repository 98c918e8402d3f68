"""A site derived from the pages table by arithmetic on page_id.

The pages table has no statuses, redirects or links between its own pages. This module gives it some, so that
every relation of a crawl exists at any scale and can be stated in SQL as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import urls as U

ROOT = 5


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _count(spark: SparkSession, sf_dir: str) -> int:
    return pages_table(spark, sf_dir).count()


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, url, crawl_status, status_code, content_type, kind, depth, via, in_sitemap, redirect_to, meta_robots, canonical_url, canonical_key)."""
    n = _count(spark, sf_dir)
    pages = pages_table(spark, sf_dir).select(F.col("page_id").alias("key"), "url")
    k = F.col("key")
    status = F.expr("case key % 20 when 0 then 'redirect' when 1 then 'error' when 2 then 'blocked_robots' when 3 then 'non_html' else 'ok' end")
    rows = pages.withColumn("crawl_status", status)
    rows = rows.withColumns(
        {
            "status_code": F.expr("case when crawl_status = 'redirect' then 301 when crawl_status in ('error', 'blocked_robots') then null when key % 20 = 4 then 404 else 200 end"),
            "content_type": F.expr("case crawl_status when 'non_html' then 'application/pdf' when 'ok' then 'text/html' end"),
            "depth": F.expr(f"cast(case when key = {ROOT} then 0 when key % 10 = 9 then null else key % 7 end as int)"),
            "in_sitemap": k % 3 == 0,
            "redirect_to": F.when(F.col("crawl_status") == "redirect", F.when(k % 40 == 0, (k + 20) % n).otherwise((k + 6) % n)),
            "meta_robots": F.expr("case when key % 13 = 0 then 'noindex, follow' when key % 17 = 0 then 'none' end"),
        }
    )
    rows = rows.withColumn("via", F.when(k == ROOT, "root").when(F.col("depth").isNull(), "sitemap").otherwise("link"))
    rows = rows.withColumn("kind", U.resource_type(F.col("url"), F.col("content_type"), F.col("status_code")))
    other = pages.select(((k - 1 + n) % n).alias("key"), F.col("url").alias("next_url"))
    rows = rows.join(other, "key", "left")
    canonical = (
        F.when(k % 6 == 1, F.col("url"))
        .when(k % 6 == 2, F.col("next_url"))
        .when(k % 6 == 3, "http://10.0.0.1/x")
        .when(k % 6 == 4, "ftp://example.com/x")
        .when(k % 6 == 5, F.col("url"))
    )
    target = F.when(k % 6 == 2, (k + 1) % n).when(k % 6 != 0, F.when((k % 6).isin(1, 5), k))
    return rows.withColumn("canonical_url", canonical).withColumn("canonical_key", target).drop("next_url")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, nofollow, location): three links of every page."""
    n = _count(spark, sf_dir)
    rows = pages_table(spark, sf_dir).select(F.col("page_id").alias("src"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    return rows.select(
        "src",
        ((F.col("src") * (F.col("k") + 1) + 13 * F.col("k") + 7) % n).alias("dst"),
        ((F.col("src") + F.col("k")) % 11 == 0).alias("nofollow"),
        F.element_at(F.array(*map(F.lit, ("nav", "main", "footer"))), F.col("k")).alias("location"),
    )


#: The same relations in SQL.
SQL = """
n AS (SELECT count(*) AS n FROM pages),
site AS (
  SELECT p.page_id AS key, p.url,
    CASE p.page_id % 20 WHEN 0 THEN 'redirect' WHEN 1 THEN 'error' WHEN 2 THEN 'blocked_robots' WHEN 3 THEN 'non_html' ELSE 'ok' END AS crawl_status,
    CASE WHEN p.page_id % 20 = 0 THEN 301 WHEN p.page_id % 20 IN (1, 2) THEN NULL WHEN p.page_id % 20 = 4 THEN 404 ELSE 200 END AS status_code,
    CASE WHEN p.page_id % 20 = 3 THEN 'application/pdf' WHEN p.page_id % 20 >= 4 THEN 'text/html' END AS content_type,
    CASE WHEN p.page_id % 20 = 3 THEN 'non_html' ELSE 'document' END AS kind,
    CASE WHEN p.page_id = 5 THEN 0 WHEN p.page_id % 10 = 9 THEN NULL ELSE p.page_id % 7 END AS depth,
    CASE WHEN p.page_id = 5 THEN 'root' WHEN p.page_id % 10 = 9 THEN 'sitemap' ELSE 'link' END AS via,
    p.page_id % 3 = 0 AS in_sitemap,
    CASE WHEN p.page_id % 20 = 0 THEN CASE WHEN p.page_id % 40 = 0 THEN (p.page_id + 20) % n.n ELSE (p.page_id + 6) % n.n END END AS redirect_to,
    CASE WHEN p.page_id % 13 = 0 THEN 'noindex, follow' WHEN p.page_id % 17 = 0 THEN 'none' END AS meta_robots,
    CASE WHEN p.page_id % 6 = 2 THEN (p.page_id + 1) % n.n WHEN p.page_id % 6 IN (1, 5) THEN p.page_id END AS canonical_key
  FROM pages p, n),
links AS (
  SELECT p.page_id AS src, (p.page_id * (k + 1) + 13 * k + 7) % n.n AS dst, (p.page_id + k) % 11 = 0 AS nofollow,
    CASE k WHEN 1 THEN 'nav' WHEN 2 THEN 'main' ELSE 'footer' END AS location
  FROM pages p, n, (VALUES (1), (2), (3)) v(k)),
live AS (SELECT * FROM site WHERE crawl_status = 'ok' AND coalesce(status_code, 0) < 400),
moves AS (SELECT key, redirect_to FROM site WHERE crawl_status = 'redirect'),
hop1 AS (SELECT s.key, coalesce(m.redirect_to, s.key) AS f, (m.key IS NOT NULL)::INT AS hops FROM site s LEFT JOIN moves m ON s.key = m.key),
hop2 AS (SELECT h.key, coalesce(m.redirect_to, h.f) AS f, h.hops + (m.key IS NOT NULL)::INT AS hops FROM hop1 h LEFT JOIN moves m ON h.f = m.key),
hop3 AS (SELECT h.key, coalesce(m.redirect_to, h.f) AS f, h.hops + (m.key IS NOT NULL)::INT AS hops FROM hop2 h LEFT JOIN moves m ON h.f = m.key),
hop4 AS (SELECT h.key, coalesce(m.redirect_to, h.f) AS f, h.hops + (m.key IS NOT NULL)::INT AS hops FROM hop3 h LEFT JOIN moves m ON h.f = m.key),
final AS (SELECT h.key, coalesce(m.redirect_to, h.f) AS final_key, h.hops + (m.key IS NOT NULL)::INT AS hops FROM hop4 h LEFT JOIN moves m ON h.f = m.key),
followed AS (
  SELECT DISTINCT l.src, f.final_key AS dst FROM links l JOIN final f ON l.dst = f.key
  WHERE l.src <> l.dst AND NOT l.nofollow AND l.src <> f.final_key),
edges AS (SELECT f.src, f.dst FROM followed f WHERE f.src IN (SELECT key FROM live) AND f.dst IN (SELECT key FROM live)),
in_out AS (
  SELECT l.key, coalesce(i.n, 0) AS unique_in, coalesce(o.n, 0) AS unique_out FROM live l
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM followed GROUP BY dst) i ON l.key = i.dst
  LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM edges GROUP BY src) o ON l.key = o.src),
states AS (
  SELECT s.key, s.url, s.crawl_status, s.status_code, s.kind, s.depth, s.via, s.in_sitemap, s.canonical_key,
    true AS discovered, s.crawl_status <> 'blocked_robots' AS crawlable,
    CASE WHEN crawl_status = 'blocked_robots' THEN NULL WHEN crawl_status = 'error' OR status_code >= 400 THEN false ELSE true END AS fetchable,
    CASE WHEN crawl_status <> 'ok' OR kind <> 'document' OR status_code >= 400 THEN NULL ELSE true END AS renderable,
    CASE WHEN crawl_status = 'blocked_robots' THEN false WHEN kind <> 'document' THEN NULL
      WHEN crawl_status IN ('error', 'redirect') OR status_code >= 400 THEN false WHEN meta_robots IS NOT NULL THEN false ELSE true END AS indexable
  FROM site s),
canon AS (
  SELECT s.*, CASE WHEN s.crawl_status = 'blocked_robots' OR s.crawl_status <> 'ok' OR s.status_code >= 400 THEN 'not_analyzed'
      WHEN s.key % 6 = 0 THEN 'missing_implicit_self' WHEN s.key % 6 = 4 THEN 'invalid' WHEN s.key % 6 IN (1, 5) THEN 'self'
      WHEN s.key % 6 = 3 THEN 'private_host'
      WHEN NOT (t.crawl_status = 'ok' AND coalesce(t.status_code, 0) < 400) THEN 'target_not_indexable' ELSE 'other_url' END AS canonical_status
  FROM states s LEFT JOIN states t ON s.canonical_key = t.key),
full_states AS (
  SELECT *, CASE WHEN canonical_status = 'not_analyzed' THEN NULL ELSE canonical_status IN ('missing_implicit_self', 'self') END AS canonical FROM canon)
"""
