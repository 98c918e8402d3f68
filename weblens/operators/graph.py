"""The link graph of a site: broken and redirected links, PageRank, flags and architecture issues.

Pages are (key, crawl_status, status_code, kind, depth, via, in_sitemap, redirect_to); links are
(src, dst, nofollow, location). All lookups are equi-joins on keys, so they scale with a shuffle each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.plans.materialize import materialize

DAMPING = 0.85
HOPS = 5
DEEP = 4


def live() -> Column:
    return (F.col("crawl_status") == "ok") & (F.coalesce("status_code", F.lit(0)) < 400)


def known_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links from known pages to other ones."""
    return links.where("src <> dst").join(pages.select(F.col("key").alias("src")), "src", "left_semi")


def with_target(pages: DataFrame, links: DataFrame) -> DataFrame:
    to = pages.select(
        F.col("key").alias("dst"), F.col("crawl_status").alias("to_status"), F.col("status_code").alias("to_code"),
        F.col("kind").alias("to_kind"), F.col("redirect_to"),
    )
    return known_links(pages, links).join(to, "dst", "left")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, status, kind) of every link to a page that failed or answered 400 and above, nofollow ones included."""
    broken = (F.col("to_status") == "error") | (F.col("to_code") >= 400)
    status = F.coalesce(F.col("to_code").cast("string"), F.col("to_status"))
    return with_target(pages, links).where(broken).select("src", "dst", status.alias("status"), F.col("to_kind").alias("kind"))


def redirected_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    return with_target(pages, links).where("to_status = 'redirect'").select("src", "dst", "redirect_to")


def resolve_redirects(pages: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, final_key, hops): where each page leads after at most `hops` redirects; cycles end by the limit."""
    moves = pages.where("crawl_status = 'redirect' and redirect_to is not null").select(
        F.col("key").alias("at"), F.col("redirect_to").alias("next")
    )
    out = pages.select("key", F.col("key").alias("final_key"), F.lit(0).alias("hops"))
    for _ in range(hops):
        out = out.join(moves, F.col("final_key") == F.col("at"), "left").select(
            "key", F.coalesce("next", "final_key").alias("final_key"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops")
        )
    return out


def followed(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): distinct followed links after redirects, without links to oneself."""
    final = resolve_redirects(pages).select(F.col("key").alias("dst"), "final_key")
    rows = known_links(pages, links).where("not nofollow").join(final, "dst", "left")
    rows = rows.select("src", F.coalesce("final_key", "dst").alias("dst")).where("src <> dst")
    return rows.distinct()


def edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Followed links between live pages."""
    alive = pages.where(live()).select("key")
    rows = followed(pages, links).join(alive.withColumnRenamed("key", "src"), "src", "left_semi")
    return rows.join(alive.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst")


def inlinks_outlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(key, unique_in, unique_out) of live pages: linking known pages, and live pages linked to."""
    into = followed(pages, links).groupBy(F.col("dst").alias("key")).agg(F.countDistinct("src").alias("unique_in"))
    out = edges(pages, links).groupBy(F.col("src").alias("key")).agg(F.countDistinct("dst").alias("unique_out"))
    rows = pages.where(live()).select("key").join(into, "key", "left").join(out, "key", "left")
    return rows.select("key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("unique_in", "unique_out")))


def pagerank(nodes: DataFrame, links: DataFrame, iterations: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(key, rank) over nodes(key) and distinct links(src, dst); ranks sum to 1.

    The mass of pages without links is spread over all. Each round is one join and one aggregation whose result is written to the shared
    folder; two numbers come to the driver. The rounds stop when the ranks change by less than tolerance in sum; with
    tolerance 0 all of them run.
    """
    nodes = nodes.select("key").distinct()
    n = nodes.count()
    if not n:
        return nodes.select("key", F.lit(0.0).alias("rank"))
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    out = materialize(links.join(degree, "src"), "edges")
    ranks = materialize(
        nodes.join(degree, nodes["key"] == degree["src"], "left").select(
            "key", F.lit(1.0 / n).alias("rank"), F.col("degree").isNull().alias("dangling")
        ),
        "ranks",
    )
    lost = ranks.where("dangling").count() / n
    for _ in range(iterations):
        base = (1.0 - DAMPING) / n + DAMPING * lost / n
        sent = out.join(ranks, out["src"] == ranks["key"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        moved = ranks.join(sent, F.col("key") == F.col("to"), "left").select(
            "key", (F.lit(base) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"), "dangling", F.col("rank").alias("old")
        )
        moved = materialize(moved, "ranks")
        delta, lost = moved.agg(
            F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
        ).first()
        ranks = moved.drop("old")
        if delta < tolerance:
            break
    return ranks.select("key", "rank")


def authority(ranks: DataFrame) -> DataFrame:
    """(key, authority): ranks in percent of the largest one, to one decimal."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select(  # one row
        "key", F.round(100 * F.col("rank") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0), 1).alias("authority")
    )


def cutoff(scores: DataFrame) -> float | None:
    """The authority that the top fifth of pages reach, ties included."""
    n = scores.count()
    if not n:
        return None
    return scores.select("authority").orderBy(F.desc("authority")).offset(max(0, n // 5 - 1)).limit(1).first()[0]


def page_flags(pages: DataFrame, links: DataFrame, scores: DataFrame | None = None, deep: int = DEEP) -> DataFrame:
    """(key, unique_in, unique_out, authority, flags) of live pages."""
    if scores is None:
        scores = authority(pagerank(pages.where(live()), edges(pages, links)))
    least = cutoff(scores)
    rows = pages.where(live()).select("key", "depth", F.col("via") == "root", "in_sitemap").toDF("key", "depth", "root", "in_sitemap")
    rows = rows.join(inlinks_outlinks(pages, links), "key").join(scores, "key", "left")
    far = F.coalesce(F.col("depth") >= deep, F.lit(False))
    matters = (F.col("authority") >= F.lit(least if least is not None else 0.0)) | F.col("in_sitemap")
    flags = F.array_compact(
        F.array(
            F.when(~F.col("root") & (F.col("unique_in") == 0), "orphan_candidate"),
            F.when(~F.col("root") & (F.col("unique_in") == 1), "weak_internal_linking"),
            F.when(F.col("unique_out") == 0, "dead_end"),
            F.when(far, "deep"),
            F.when(far & matters, "important_but_deep"),
        )
    )
    return rows.select("key", "unique_in", "unique_out", "authority", flags.alias("flags"))


_FLAG_CODES = {
    "orphan_candidate": "ORPHAN_PAGE_CANDIDATES",
    "dead_end": "DEAD_END_PAGES",
    "weak_internal_linking": "WEAKLY_LINKED_PAGES",
    "important_but_deep": "IMPORTANT_PAGES_TOO_DEEP",
    "deep": "DEEP_PAGES",
}


def architecture_issues(pages: DataFrame, links: DataFrame, flagged: DataFrame) -> DataFrame:
    """(code, count) of the architecture rules; only codes that fire."""
    broken = broken_links(pages, links).groupBy(
        F.when(F.col("kind") == "document", "BROKEN_INTERNAL_LINKS").otherwise("BROKEN_RESOURCE_LINKS").alias("code")
    ).agg(F.count("*").alias("count"))
    moved = redirected_links(pages, links).agg(F.count("*").alias("count")).where("count > 0")
    moved = moved.select(F.lit("REDIRECTED_INTERNAL_LINKS").alias("code"), "count")
    codes = F.create_map(*(F.lit(x) for pair in _FLAG_CODES.items() for x in pair))
    flags = flagged.select(F.explode("flags").alias("flag")).groupBy(codes[F.col("flag")].alias("code")).agg(F.count("*").alias("count"))
    return broken.unionByName(moved).unionByName(flags)


def broken_targets(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(code, links, targets): broken links and the distinct URLs that they lead to, of pages and of other resources."""
    code = F.when(F.col("kind") == "document", "BROKEN_INTERNAL_LINKS").otherwise("BROKEN_RESOURCE_LINKS")
    return broken_links(pages, links).groupBy(code.alias("code")).agg(F.count("*").alias("links"), F.countDistinct("dst").alias("targets"))


def graph_summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages, links followed, the mean of unique_in to one decimal, and the largest depth; 0 where there is nothing."""
    rows = pages.where(live()).select("key", "depth").join(inlinks_outlinks(pages, links), "key")
    rows = rows.agg(
        F.count("*").alias("pages"), F.coalesce(F.round(F.avg("unique_in"), 1), F.lit(0.0)).alias("avg_unique_in"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )
    return rows.crossJoin(followed(pages, links).agg(F.count("*").alias("followed_links")))  # one row each


def ordered_depths(distribution: DataFrame) -> DataFrame:
    """(rn, depth_key, n): depths as numbers, sitemap_only last. One row for each depth, so one task orders them."""
    place = F.row_number().over(Window.orderBy(F.expr("try_cast(depth_key as int)").asc_nulls_last(), "depth_key"))
    return distribution.select(place.alias("rn"), "depth_key", "n")


def depth_distribution(pages: DataFrame) -> DataFrame:
    return pages.where(live()).groupBy(F.coalesce(F.col("depth").cast("string"), F.lit("sitemap_only")).alias("depth_key")).agg(F.count("*").alias("n"))


def link_locations(pages: DataFrame, links: DataFrame) -> DataFrame:
    return known_links(pages, links).groupBy(F.coalesce("location", F.lit("body")).alias("location")).agg(F.count("*").alias("n"))


def top_pages(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("authority"), "key").limit(k)


def flagged_pages(flagged: DataFrame) -> DataFrame:
    """(flag, key, authority, rn): pages of each flag by authority."""
    rows = flagged.select(F.explode("flags").alias("flag"), "key", "authority")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("flag").orderBy(F.desc("authority"), "key")))
