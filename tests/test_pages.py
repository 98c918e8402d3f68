import tempfile
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weblens import api
from weblens.operators import audit, pages, render, rollup
from weblens.sources.html import _Builder, parse_page, tree

URL = "https://example.com/blog/post"


def html(head="", body="", lang="en"):
    return f'<!DOCTYPE html><html lang="{lang}"><head>{head}</head><body>{body}</body></html>'


WORDS = " ".join(f"word{i}" for i in range(350))
GOOD = html(
    '<meta charset="utf-8"><title>A good title that is long enough here</title><meta name="description" content="' + "d" * 100 + '">'
    f'<link rel="canonical" href="{URL}"><meta property="og:title" content="t"><meta property="og:description" content="d">'
    '<meta property="og:image" content="i"><meta name="twitter:card" content="summary">'
    '<script type="application/ld+json">{"@graph": [{"@type": "Organization"}, {"@type": ["Product", "Thing"]}]}</script>',
    f'<nav><a href="/">Home</a></nav><main><h1>One</h1><h2>Two</h2><h3>Three</h3><p>{WORDS}</p><img src="a.png" alt="x"><a href="/x">More</a></main>',
)


def codes(spark, source, url=URL):
    rows = audit.issue_rows(api.audit_pages(spark.createDataFrame([(1, url, source)], "page_id long, url string, html string")), "page_id")
    return {r["code"]: r["count"] for r in rows.collect()}


def test_good_page(spark):
    row = api.audit_pages(spark.createDataFrame([(1, URL, GOOD)], "page_id long, url string, html string")).first()
    assert (row["score"], row["grade"], row["critical_count"], row["warning_count"]) == (100, "excellent", 0, 0)
    assert row["structured_data_types"] == ["Organization", "Product", "Thing"]
    assert [h["level"] for h in row["heading_order" if "heading_order" in row else "headings"]] == [1, 2, 3]


def test_rules_fire(spark):
    head = (
        '<title>Short</title><link rel="canonical" href="http://10.0.0.1/a"><meta name="robots" content="noindex, nofollow">'
        '<link rel="alternate" hreflang="xx1" href="/a"><link rel="alternate" hreflang="th" href="http://10.0.0.1/th">'
        '<link rel="alternate" hreflang="TH" href="https://other.org/th"><script type="application/ld+json">{bad</script>'
    )
    body = '<h1>a</h1><h1></h1><h4>d</h4><img src=x><img src=y width=1 height=1><a href="javascript:x()">j</a><a href=""></a><a href="/e"><img src=z alt=""></a>'
    found = codes(spark, html(head, body))
    want = {
        "TITLE_TOO_SHORT": 1, "META_DESCRIPTION_MISSING": 1, "MULTIPLE_H1": 2, "EMPTY_HEADING": 1, "HEADING_ORDER_SKIPPED": 1, "CANONICAL_PRIVATE_IP": 1,
        "CANONICAL_HTTP_WHEN_PAGE_HTTPS": 1, "HREFLANG_INVALID": 1, "HREFLANG_PRIVATE_IP": 1, "HREFLANG_DOMAIN_MISMATCH": 1, "HREFLANG_DUPLICATE_LANGUAGE": 1,
        "IMAGE_ALT_MISSING": 1, "EMPTY_LINK": 2, "JAVASCRIPT_LINK": 1, "INVALID_LINK": 1, "NOINDEX_PAGE": 1, "NOFOLLOW_PAGE": 1, "OG_TITLE_MISSING": 1,
        "OG_DESCRIPTION_MISSING": 1, "OG_IMAGE_MISSING": 1, "TWITTER_CARD_MISSING": 1, "VERY_THIN_CONTENT": 1, "STRUCTURED_DATA_INVALID_JSON": 1,
        "STRUCTURED_DATA_NOT_FOUND": 1,
    }
    assert found == want


@pytest.mark.parametrize(
    ("head", "code"),
    [
        ("<title></title>", "TITLE_MISSING"), ("<title>" + "x" * 61 + "</title>", "TITLE_TOO_LONG"),
        ('<meta name="Description" content="short">', "META_DESCRIPTION_TOO_SHORT"), ('<meta name=description content="' + "x" * 161 + '">', "META_DESCRIPTION_TOO_LONG"),
        ('<link rel=canonical href="ftp://x/y">', "CANONICAL_INVALID"), ('<link rel=canonical href="https://other.org/">', "CANONICAL_DOMAIN_MISMATCH"),
        ("", "CANONICAL_MISSING"), ("", "H1_MISSING"), ("", "EMPTY_MAIN_CONTENT"),
    ],
)
def test_single_rules(spark, head, code):
    assert code in codes(spark, html(head))


def test_links(spark):
    body = (
        '<nav><a href="/a">A</a></nav><footer><a href="/a/">a</a></footer><main><a href="https://other.org" rel="nofollow">Out</a>'
        '<a href="#x">Jump</a><a aria-label="Label" href="/b"></a><span id=n>Named</span><a aria-labelledby="n" href="/c"><img alt="i"></a></main>'
    )
    rows = pages.page_links(pages.parse_raw(spark.createDataFrame([(1, URL, html("", body))], "page_id long, url string, html string"))).orderBy("pos")
    got = [(r["type"], r["location"], r["text"], r["nofollow"], r["is_duplicate"]) for r in rows.collect()]
    assert got == [
        ("internal", "nav", "A", False, False), ("internal", "footer", "a", False, True), ("external", "main", "Out", True, False),
        ("anchor", "main", "Jump", False, False), ("internal", "main", "Label", False, False), ("internal", "main", "Named", False, False),
    ]
    wide = pages.parse_pages(spark.createDataFrame([(1, URL, html("", body))], "page_id long, url string, html string")).first()
    assert [x["is_duplicate"] for x in wide["links"]] == [g[4] for g in got]
    assert (wide["links_raw_total"], wide["links_total"], wide["internal_links_count"], wide["nofollow_links_count"]) == (6, 5, 3, 1)


def test_both_classifications_agree(spark):
    from weblens.functions import urls as U
    from weblens.sources.html import link_type, normalized, resolve

    hrefs = ["/a", "b/../c", "https://www.example.com/x?y#z", "https://o.org", "#t", "/blog/post#t", "mailto:x", "TEL:1", "javascript:1", "", "http://[::1", "ftp://e/x", "//e.com/%41é b"]
    got = spark.createDataFrame([(URL, h) for h in hrefs], "u string, h string")
    got = got.select("h", U.classify_link(F.col("u"), F.col("h")).alias("t"), U.normalize(U.resolve(F.col("u"), F.col("h"))).alias("n")).collect()
    for row in got:
        absolute = resolve(URL, row["h"])
        assert row["t"] == link_type(URL, row["h"], absolute), row["h"]
        if row["t"] in ("internal", "external"):
            assert row["n"] == normalized(absolute)


def test_odd_pages():
    broken = parse_page(URL, "<html><head><title>Broken<body><h1>Head<p>text <a href='/x'>link<div></span></html")
    assert [h["level"] for h in broken["headings"]] == [1] and len(broken["links"]) == 1
    assert parse_page(URL, "")["title"] is None and parse_page(None or "", None or "")["links"] == []
    for source in ("<", "<a", "&#0;", "<base href='http://[x'><a href='y'>z</a>", "<p>" * 2000):
        parse_page(URL, source)


def test_large_page():
    start = time.time()
    page = parse_page(URL, html("", "".join(f"<section><h2>H{i}</h2><p>text {i}</p><a href='/p{i}'>l{i}</a></section>" for i in range(20_000))))
    assert len(page["headings"]) == len(page["links"]) == 20_000
    assert time.time() - start < 30


def test_content(spark):
    body = '<header>Site</header><nav>Menu</nav><article><header>By me</header><p>Real words here</p></article><aside>Side</aside><footer>Foot</footer>'
    page = parse_page(URL, html("", body))
    assert page["main_content_method"] == "single_article" and page["main_content"] == "By me Real words here"
    two = parse_page(URL, html("", "<main>one</main><div role=main>two</div><article>x</article>"))
    assert (two["main_content_method"], two["main_content"]) == ("main_elements(2)", "one two")


def test_render_merge(spark):
    kind = "page_id long, url string, status_code int, html string, rendered_html string"
    shell = '<html><head></head><body><div id="root"></div><script src="react.min.js"></script></body></html>'
    small = html("", "<h1>h</h1><p>few words</p><a href=/1>1</a><a href=/2>2</a><a href=/3>3</a>")
    rows = [
        (1, URL, 200, shell, GOOD), (2, URL, 200, GOOD, None), (3, URL, 404, GOOD, None),
        (4, URL, 200, small, small.replace("<head>", "<head><title>From scripts, in the final document</title>")),
    ]
    got = {r["page_id"]: r for r in api.extract(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["source"] == "rendered" and got[1]["word_count"] > 300
    assert any(i["code"] == "CONTENT_REQUIRES_JS" for i in got[1]["issues"])
    assert got[2]["source"] == "raw" and got[2]["render_status"] == "not_needed"
    assert got[4]["source"] == "raw" and got[4]["title"].startswith("From scripts")
    assert got[4]["metadata_source"]["title"] == "rendered_dom"


def test_render_reasons(spark):
    row = spark.createDataFrame([("<div id='app'> </div>", 10, 0, 0)], "html string, w int, h int, l int")
    found = row.select(render.render_reasons(F.col("html"), F.col("w"), F.col("h"), F.col("l")).alias("r")).first()["r"]
    assert len(found) == 4


def test_determinism(spark):
    source = spark.createDataFrame([(i, URL, GOOD) for i in range(20)], "page_id long, url string, html string")
    assert api.reports(source.repartition(5)).select("markdown").distinct().count() == 1


def test_rollup(spark):
    source = spark.createDataFrame([(1, URL, GOOD), (2, URL + "2", html("<title> a GOOD title that is long enough here</title>"))], "page_id long, url string, html string")
    audited = api.audit_pages(source)
    rows = {r["code"]: (r["n"], r["pct"]) for r in api.issue_summary(audited).collect()}
    assert rows["H1_MISSING"] == (1, 50.0)
    assert {r["page_id"]: r["shared_with"] for r in rollup.duplicates(audited, "title").collect()} == {1: 1, 2: 1}


@given(st.text(alphabet="<>a/\"'=! -&;p", max_size=40))
@settings(max_examples=400, deadline=None)
def test_tail_without_tags_reads_as_before(source):
    builder = _Builder()
    builder.feed(source)
    builder.close()

    def shape(root):
        return root.text(), [(e.tag, e.attrs) for e in root.walk()]

    assert shape(tree(source)) == shape(builder.root)


def test_unclosed_tags_take_linear_time():
    began = time.time()
    assert tree("<p>x" + "<a " * 100_000).text().count("<a") == 99_999
    assert time.time() - began < 10


def test_names_need_their_semicolon(spark):
    """A title that was cut inside "&amp;" keeps what is left of it, as page_summary's SQL does."""
    import duckdb
    import pandas as pd

    from weblens.plans.catalogue import ORACLES, QUERIES

    source = '<html lang="en"><head><title>Ores and &amp;&amp</title></head><body><article><h1>Ores and &amp;&amp</h1><p>&copying; x &lt;b&gt;</p></article></body></html>'
    table = pd.DataFrame([(1, URL, source), (2, URL, source.replace("&amp<", "&am<")), (3, URL, GOOD)], columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", table)
    want = con.execute(f"SELECT page_id, raw_title, title_length, word_count FROM ({ORACLES['page_summary']}) ORDER BY page_id").fetchall()
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame(table, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        got = QUERIES["page_summary"](spark, folder).orderBy("page_id").select("page_id", "raw_title", "title_length", "word_count").collect()
    assert [tuple(r) for r in got] == want and got[0]["raw_title"] == "Ores and &&amp"


def test_masked_ampersands_come_back():
    source = '<p title="a&copy=1&amp;b">x &ampx &#38; &eacute; &nosuch; &#x26</p><script>a&amp&&b</script><a&lt href="?a=1&lt">y'
    root = tree(source)
    assert root.text() == "x &ampx & é &nosuch; & y"
    found = {e.tag: e for e in root.walk()}
    assert found["p"].attrs["title"] == "a&copy=1&b" and found["script"].children == ["a&amp&&b"]
    assert found["a&lt"].attrs["href"] == "?a=1&lt"


def test_a_cut_name_is_a_word(spark):
    """What is left of a cut "&quot;" has letters, so word_count counts it, as its SQL does."""
    import duckdb
    import pandas as pd

    from weblens.plans.catalogue import ORACLES, QUERIES

    bodies = ["<h1>One &quot</h1><p>two &amp; three</p>", "<h1>One &quot;</h1><p>two &amp; three</p>"]
    table = pd.DataFrame([(k, URL, html("", f"<article>{b}</article>")) for k, b in enumerate(bodies)], columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", table)
    want = con.execute(f"SELECT page_id, words FROM ({ORACLES['word_count']}) ORDER BY page_id").fetchall()
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame(table, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        got = QUERIES["word_count"](spark, folder).orderBy("page_id").select("page_id", "words").collect()
    assert [tuple(r) for r in got] == want == [(0, 4), (1, 3)]
