import gzip

import pytest
from pyspark.sql import functions as F

from weblens import api
from weblens.operators import crawl, graph, rules, states
from weblens.sources import requests, sitemaps, tables

HOST = "https://ex.com"
PAGES = [
    ("/", 0, "ok", 200, "root", False, None), ("/hub", 1, "ok", 200, "link", False, None), ("/leaf", 2, "ok", 200, "link", False, None),
    ("/orphan", None, "ok", 200, "sitemap", True, None), ("/deep", 5, "ok", 200, "link", True, None), ("/gone", 2, "ok", 404, "link", False, None),
    ("/old", 1, "redirect", 301, "link", False, "/hub"), ("/nf-only", 2, "ok", 200, "link", False, None),
]
LINKS = [("/", "/hub"), ("/", "/old"), ("/hub", "/"), ("/hub", "/leaf"), ("/hub", "/gone"), ("/hub", "/deep"), ("/leaf", "/hub"), ("/deep", "/hub")]


@pytest.fixture
def site(spark):
    rows = [(HOST + p, s, c, "text/html", "document", d, v, m, HOST + r if r else None) for p, d, s, c, v, m, r in PAGES]
    pages = spark.createDataFrame(rows, "key string, crawl_status string, status_code int, content_type string, kind string, depth int, via string, in_sitemap boolean, redirect_to string")
    edges = [(HOST + a, HOST + b, False, "main") for a, b in LINKS] + [(HOST + "/hub", HOST + "/nf-only", True, "nav")]
    return pages, spark.createDataFrame(edges, "src string, dst string, nofollow boolean, location string")


def test_flags(site):
    pages, links = site
    rows = {r["key"].removeprefix(HOST): r for r in graph.page_flags(pages, links).collect()}
    assert "/gone" not in rows and rows["/hub"]["authority"] == 100.0 and rows["/hub"]["unique_in"] == 3
    assert set(rows["/orphan"]["flags"]) == {"orphan_candidate", "dead_end"}
    assert "orphan_candidate" in rows["/nf-only"]["flags"] and "weak_internal_linking" in rows["/leaf"]["flags"]
    assert {"deep", "important_but_deep"} <= set(rows["/deep"]["flags"]) and "orphan_candidate" not in rows["/"]["flags"]
    issues = {r["code"]: r["count"] for r in graph.architecture_issues(pages, links, graph.page_flags(pages, links)).collect()}
    assert issues["BROKEN_INTERNAL_LINKS"] == 1 and issues["REDIRECTED_INTERNAL_LINKS"] == 1


def _pagerank(nodes, edges, rounds=50, tol=1e-8):
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not out[n])
        new = {n: (0.15 + 0.85 * lost) / len(nodes) + sum(0.85 * rank[a] / len(out[a]) for a in nodes if n in out[a]) for n in nodes}
        moved = sum(abs(new[n] - rank[n]) for n in nodes)
        rank = new
        if moved < tol:
            break
    return rank


def test_pagerank(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "b"), ("b", "a"), ("e", "a")]
    nodes = ["a", "b", "c", "d", "e", "f"]
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "key string"), spark.createDataFrame(edges, "src string, dst string"))
    ranks = {r["key"]: r["rank"] for r in got.collect()}
    want = _pagerank(nodes, edges)
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and max(ranks, key=ranks.get) == "b"
    assert all(ranks[n] == pytest.approx(want[n], abs=1e-7) for n in nodes)
    assert graph.pagerank(spark.createDataFrame([], "key string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_redirect_cycles_end(spark):
    rows = [("a", "redirect", "b"), ("b", "redirect", "a"), ("c", "redirect", "d"), ("d", "ok", None)]
    got = graph.resolve_redirects(spark.createDataFrame(rows, "key string, crawl_status string, redirect_to string")).collect()
    assert {r["key"]: (r["final_key"], r["hops"]) for r in got} == {"a": ("b", 5), "b": ("a", 5), "c": ("d", 1), "d": ("d", 0)}


def test_states(spark):
    kind = "key string, url string, crawl_status string, status_code int, content_type string, meta_robots string, x_robots string, canonical_url string, canonical_key string, render_status string, title string, h1 string"
    rows = [
        ("ok", HOST + "/ok", "ok", 200, "text/html", None, None, None, None, None, "Fine", ""),
        ("meta", HOST + "/m", "ok", 200, "text/html", "noindex", None, HOST + "/m", "meta", None, "", ""),
        ("head", HOST + "/h", "ok", 200, "text/html", None, "googlebot: none", HOST + "/gone", "gone", "failed", "", ""),
        ("gone", HOST + "/g", "ok", 404, "text/html", None, None, None, None, None, "", ""),
        ("pdf", HOST + "/p", "non_html", 200, "application/pdf", None, None, None, None, None, None, None),
        ("robots", HOST + "/r", "blocked_robots", None, None, None, None, None, None, None, None, None),
        ("soft", HOST + "/s", "ok", 200, "text/html", None, None, "http://10.0.0.1/", None, None, "Page not found", ""),
    ]
    got = {r["key"]: r for r in states.page_states(spark.createDataFrame(rows, kind)).collect()}
    assert (got["ok"]["indexable"], got["ok"]["canonical_status"], got["ok"]["canonical"]) == (True, "missing_implicit_self", True)
    assert (got["meta"]["index_reason"], got["meta"]["canonical_status"]) == ("noindex_meta", "self")
    assert (got["head"]["index_reason"], got["head"]["canonical_status"], got["head"]["renderable"]) == ("noindex_header", "target_not_indexable", False)
    assert (got["gone"]["fetchable"], got["gone"]["indexable"], got["gone"]["canonical"]) == (False, False, None)
    assert (got["pdf"]["indexable"], got["pdf"]["canonical_status"]) == (None, "not_applicable" if got["pdf"]["crawl_status"] == "ok" else "not_analyzed")
    assert (got["robots"]["crawlable"], got["robots"]["fetchable"], got["robots"]["indexable"]) == (False, None, False)
    assert got["soft"]["soft_404"] and got["soft"]["canonical_status"] == "private_host"


def test_replay(spark):
    pages = ["/", "/a", "/b", "/c", "/only-sitemap"]
    fetches = [(f"https://e.com{p}", f"https://e.com{p}", 200, "text/html", None) for p in pages]
    fetches += [("https://e.com/old", "https://e.com/old", 301, None, "https://e.com/c"), ("https://e.com/f.pdf", "https://e.com/f.pdf", 200, "application/pdf", None), ("https://e.com/err", "https://e.com/err", None, None, None)]
    links = [("/", "/a", 0, False), ("/", "/old", 1, False), ("/", "/f.pdf", 2, False), ("/", "/secret", 3, False), ("/a", "/b", 0, False), ("/a", "/missing", 1, False), ("/a", "/nf", 2, True), ("/b", "/err", 0, False), ("/b", "/", 1, False)]
    f = spark.createDataFrame(fetches, "key string, url string, status_code int, content_type string, redirect_to string")
    e = spark.createDataFrame([("https://e.com" + a, "https://e.com" + b, "https://e.com" + b, p, n) for a, b, p, n in links], "src string, dst string, url string, pos int, nofollow boolean")
    m = spark.createDataFrame([("https://e.com/only-sitemap", "https://e.com/only-sitemap"), ("https://e.com/a", "https://e.com/a")], "key string, url string")
    blocked = spark.createDataFrame([("https://e.com/secret",)], "key string")
    got = {r["key"].removeprefix("https://e.com"): r for r in crawl.replay(f, e, "https://e.com/", crawl.CrawlOptions(), m, blocked).collect()}
    assert {k: (r["crawl_status"], r["depth"]) for k, r in got.items()} == {
        "/": ("ok", 0), "/a": ("ok", 1), "/old": ("redirect", 1), "/f.pdf": ("non_html", 1), "/secret": ("blocked_robots", 1), "/c": ("ok", 1),
        "/b": ("ok", 2), "/missing": ("ok", 2), "/err": ("error", 3), "/only-sitemap": ("ok", None),
    }
    assert got["/missing"]["status_code"] == 404 and got["/a"]["in_sitemap"] and got["/only-sitemap"]["via"] == "sitemap"
    few = crawl.replay(f, e, "https://e.com/", crawl.CrawlOptions(max_pages=3, use_sitemaps=False), None, blocked)
    # Three requests: a redirect's target, /c, comes with the redirect.
    assert {r["key"].removeprefix("https://e.com") for r in few.where("crawl_status <> 'blocked_robots'").collect()} == {"/", "/a", "/old", "/c"}
    shallow = crawl.replay(f, e, "https://e.com/", crawl.CrawlOptions(max_depth=1, use_sitemaps=False))
    assert shallow.agg(F.max("depth")).first()[0] == 1


URLSET = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/a </loc></url><url><loc>https://e.com/b</loc></url></urlset>'
INDEX = b"<sitemapindex><sitemap><loc>https://e.com/s1.xml</loc></sitemap><sitemap><loc>https://e.com/none.xml</loc></sitemap></sitemapindex>"


@pytest.mark.parametrize(
    ("body", "kind", "want"),
    [
        (URLSET, "", "ok"), (b"<urlset/>", "", "empty"), (b"<!DOCTYPE html><p>", "", "html"), (URLSET, "text/html", "html"), (URLSET[:60], "", "parse_error"),
        (b"<other/>", "", "unsupported_format"), (b"<rss><channel><item><link>https://e.com/r</link></item></channel></rss>", "", "ok"), (gzip.compress(URLSET), "", "ok"),
        (b"\x1f\x8bbad", "", "parse_error"), (None, None, "parse_error"),
    ],
)
def test_classify_sitemaps(body, kind, want):
    assert sitemaps.classify(body, kind)[2] == want


def test_sitemap_walk(spark):
    rows = [("https://e.com/sitemap.xml", 200, "text/xml", INDEX), ("https://e.com/s1.xml", 200, "text/xml", gzip.compress(URLSET)), ("https://e.com/feed", 200, "", b'<feed><entry><link href="https://e.com/a"/><link rel="self" href="x"/></entry></feed>')]
    files = sitemaps.read_files(spark.createDataFrame(rows, "url string, status int, content_type string, body binary"))
    read, cut = sitemaps.walk(files, spark.createDataFrame([("https://e.com/sitemap.xml",), ("https://e.com/feed",)], "url string"))
    got = {r["url"].rsplit("/", 1)[1]: (r["result"], r["level"]) for r in read.collect()}
    assert got == {"sitemap.xml": ("ok", 0), "feed": ("ok", 0), "s1.xml": ("ok", 1), "none.xml": ("fetch_error", 1)} and not cut
    urls = {r["key"]: (r["times"], r["listed_again"]) for r in sitemaps.listed_urls(read.where("urls is not null")).collect()}
    assert urls == {"https://e.com/a": (2, False), "https://e.com/b": (1, False)}
    assert sitemaps.walk(files, spark.createDataFrame([("https://e.com/sitemap.xml",)], "url string"), max_files=1)[1]


def test_requests(spark):
    rows = [
        ("u", None, "text/html", "<p>x"), (None, "j", "application/json", '{"url": "https://e.com/a b", "html": "<p>"}'), (None, "s", "application/json", '"{\\"url\\": \\"https://e.com\\", \\"html\\": \\"<p>\\"}"'),
        (None, "f", "application/x-www-form-urlencoded", "url=https%3A%2F%2Fe.com&html=%3Cp%3E+x&url=second"), (None, "bad", "application/json", "[1]"), (None, "text", "", '{"url": "https://e.com", "html": "no tags"}'), (None, "ftp", "", '{"url": "ftp://e.com", "html": "<p>"}'),
    ]
    data = spark.createDataFrame([("https://e.com/q" if a else None, b, c, d) for a, b, c, d in rows], "url_param string, id string, content_type string, body string")
    got = {r["id"] or "u": (r["url"], r["html"], r["error_code"]) for r in requests.read_requests(data).collect()}
    assert got["u"] == ("https://e.com/q", "<p>x", None) and got["j"] == ("https://e.com/ab", "<p>", None) and got["s"] == ("https://e.com", "<p>", None)
    assert got["f"] == ("https://e.com", "<p> x", None)
    assert [got[k][2] for k in ("bad", "text", "ftp")] == ["invalid_body", "not_html", "invalid_url"]


def test_lists(site):
    pages, links = site
    rows = pages.withColumn("indexable", F.when(F.col("status_code") == 200, True))
    got = [r["key"].removeprefix(HOST) for r in api.list_pages(rows, crawl_status="ok", indexable=True, limit=3, offset=1).collect()]
    assert got == ["/hub", "/leaf", "/nf-only"]
    top, flagged = api.architecture(pages, links, 2)
    assert top.count() == 2 and flagged.where("flag = 'deep'").count() == 1


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/links"
    old = spark.createDataFrame([(1, 7, "a", "b")], "id long, crawl_id long, src string, dst string")
    tables.append(old, path)
    tables.append(tables.with_columns_of(old.withColumn("crawl_id", F.lit(8).cast("long")), tables.PAGE_LINKS), path)
    assert tables.of_crawl(spark, path, 7).first()["location"] is None and tables.of_crawl(spark, path, 8).count() == 1
    assert tables.as_json(old.select(F.struct("src", "dst").alias("x"))).first()["x"] == '{"src":"a","dst":"b"}'


def test_rules_are_complete():
    codes = [c for c, *_ in rules.PAGE_RULES + rules.SITE_RULES]
    assert len(codes) == len(set(codes)) == 65 and len(rules.PAGE_RULES) == 36


def test_replay_stays_on_the_site(spark):
    f = spark.createDataFrame([(u, u, 200, "text/html", None) for u in ("https://e.com/", "https://e.com/a", "https://x.org/b")], "key string, url string, status_code int, content_type string, redirect_to string")
    e = spark.createDataFrame([("https://e.com/", u, u, i, False) for i, u in enumerate(("https://e.com/a", "https://x.org/b", "mailto:a@e.com", "https://shop.e.com/c"))], "src string, dst string, url string, pos int, nofollow boolean")
    m = spark.createDataFrame([(u, u) for u in ("https://x.org/s", "https://shop.e.com/s")], "key string, url string")
    keys = lambda **o: {r["key"] for r in crawl.replay(f, e, "https://e.com/", crawl.CrawlOptions(**o), m).collect()}
    assert keys() == {"https://e.com/", "https://e.com/a"}
    assert keys(same_domain_only=False) == {"https://e.com/", "https://e.com/a", "https://shop.e.com/c", "https://shop.e.com/s"}


def test_replay_limits(spark):
    """Redirects cost one request, a page's own nofollow and its duplicates aren't followed, and what stays out is counted."""
    site = "https://e.com"
    fetched = [("/", 200, None, False), ("/old", 301, "/new", False), ("/new", 200, None, False), ("/quiet", 200, None, True), ("/far", 200, None, False), ("/off", 301, None, False)]
    f = spark.createDataFrame([(site + u, site + u, c, "text/html", site + r if r else "https://x.org/" if u == "/off" else None, n) for u, c, r, n in fetched], "key string, url string, status_code int, content_type string, redirect_to string, nofollow boolean")
    edges = [("/", "/old", False), ("/", "/quiet", False), ("/", "/off", False), ("/", "/skip-me", False), ("/", "/twice", True), ("/quiet", "/hidden", False), ("/new", "/far", False)]
    e = spark.createDataFrame([(site + a, site + b, site + b, i, False, "internal", d) for i, (a, b, d) in enumerate(edges)], "src string, dst string, url string, pos int, nofollow boolean, type string, is_duplicate boolean")
    m = spark.createDataFrame([(site + u, site + u) for u in ("/new", "/s1", "/s2")], "key string, url string")

    def run(**o):
        c = crawl.run_crawl(f, e, o.pop("start", site + "/"), crawl.CrawlOptions(exclude_patterns=("skip",), **o), m)
        return {r["key"].removeprefix(site): r["depth"] for r in c.pages.collect()}, crawl.diagnostics(c).first().asDict()

    depths, row = run(max_depth=1)
    assert depths == {"/": 0, "/old": 1, "/quiet": 1, "/off": 1, "/new": 1, "/s1": None, "/s2": None}
    assert row == {
        "discovered_urls": 7, "crawled_ok": 5, "redirects": 2, "non_html": 0, "failed": 0, "blocked_by_robots": 0, "skipped_depth": 1,
        "skipped_pattern": 1, "skipped_max_pages": 0, "sitemap_urls": 3,
    }
    depths, row = run(max_pages=2)
    assert depths == {"/": 0, "/old": 1, "/new": 1} and row["skipped_max_pages"] == 5 and row["discovered_urls"] == 6
    depths, row = run(start=site + "/sitemap.xml", use_sitemaps=False)
    assert depths["/"] == 0 and "/s1" in depths and depths["/far"] == 2
    assert run(use_sitemaps=False)[1]["sitemap_urls"] == 0


def test_rounds_read_links_and_answers_once(spark):
    """A chain of pages takes a round for each; links and answers are worked out before the first."""
    n, reads = 6, {name: spark.sparkContext.accumulator(0) for name in ("links", "fetches")}

    def counted(rows, name):
        def run(batches):
            for batch in batches:
                reads[name].add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    url = lambda k: f"https://e.com/p{k}" if k else "https://e.com/"
    fetches = spark.createDataFrame([(url(k), url(k), 200, "text/html", None) for k in range(n)], "key string, url string, status_code int, content_type string, redirect_to string")
    links = spark.createDataFrame([(url(k), url(k + 1), url(k + 1), 0, False) for k in range(n - 1)], "src string, dst string, url string, pos int, nofollow boolean")
    done = crawl.run_crawl(counted(fetches, "fetches"), counted(links, "links"), url(0), crawl.CrawlOptions(max_depth=9))
    assert {(r["key"], r["depth"]) for r in done.pages.collect()} == {(url(k), k) for k in range(n)}
    assert crawl.diagnostics(done).first()["crawled_ok"] == n
    assert {name: a.value for name, a in reads.items()} == {"links": n - 1, "fetches": n}
    assert sum(f"/level-{k}" in f for f in done.pages.inputFiles() for k in "0123456789abcdef") >= n  # each level's own files
