import ipaddress

import pytest
from pyspark.sql import functions as F

from weblens.functions import text as T
from weblens.functions import urls as U


def one(spark, value, *args):
    names = [f"c{i}" for i in range(len(args))]
    row = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {'int' if isinstance(a, int) else 'string'}" for n, a in zip(names, args, strict=True)))
    return row.select(value(*map(F.col, names)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.com:443/a/?x=1#f", "https://example.com/a?x=1"),
        ("http://e.com", "http://e.com/"),
        ("http://e.com:8080/a//", "http://e.com:8080/a"),
        ("https://a_b.ex.com:8080/x y?q=1#f", "https://a_b.ex.com:8080/x y?q=1"),
        ("https://e.com/%77%70%2d/%2fa", "https://e.com/wp-/%2Fa"),
        ("https://e.com/คณะ", "https://e.com/%E0%B8%84%E0%B8%93%E0%B8%B0"),
        ("https://e.com/%e0%b8%84%e0%b8%93%e0%b8%b0", "https://e.com/%E0%B8%84%E0%B8%93%E0%B8%B0"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize, url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.com/a/?b=2&utm_source=x&a=1&a=3#frag", "https://ex.com/a?a=1&b=2"),
        ("https://e.com/?gclid=1", "https://e.com/"),
        ("https://e.com/?q=a+b&p=%26~*", "https://e.com/?p=%26~%2A&q=a+b"),
        ("https://e.com/?flag", "https://e.com/?flag="),
        ("https://e.com/x", "https://e.com/x"),
    ],
)
def test_crawl_key(spark, url, want):
    assert one(spark, U.crawl_key, url) == want


PAGE = "https://www.example.com/blog/post"


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/about", "internal"), ("https://example.com/x", "internal"), ("next", "internal"), ("https://blog.example.com/", "external"),
        ("//other.org/a", "external"), ("mailto:a@b.c", "mailto"), ("tel:+1", "tel"), ("JavaScript:void(0)", "javascript"), ("", "invalid"),
        ("http://[::1", "invalid"), ("#top", "anchor"), ("/blog/post#x", "anchor"), ("ftp://e.com/x", "invalid"),
    ],
)
def test_classify_link(spark, href, want):
    assert one(spark, U.classify_link, PAGE, href) == want


def test_resolve_agrees_with_the_standard_library(spark):
    from weblens.sources.html import resolve

    base = "https://e.com/a/b/c?q=1"
    hrefs = ["d", "/d", "./d", "../d", "../../d", "../../../d", "?x", "#f", "//h/p", "http://o/p", "d/..", "d/.", "/x/../y", "", " d ", "d?e=../f"]
    rows = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = {r["h"]: r["v"] for r in rows.select("h", U.resolve(F.col("b"), F.col("h")).alias("v")).collect()}
    assert got == {h: resolve(base, h) for h in hrefs}


def test_private_hosts_agree_with_the_standard_library(spark):
    hosts = [f"{a}.{b}.{c}.7" for a in (0, 1, 9, 10, 11, 100, 127, 169, 172, 192, 198, 203, 224, 239, 240, 255) for b in (0, 15, 16, 18, 31, 32, 51, 168, 254) for c in (0, 2, 100, 113)]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["v"] for r in rows.select("h", U.is_private_host(F.col("h")).alias("v")).collect()}

    def want(h):
        ip = ipaddress.ip_address(h)
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_unspecified

    assert {h: v for h, v in got.items() if v != want(h)} == {}


def test_words(spark):
    assert one(spark, T.count_words, "AI for everyone - !") == 3
    assert one(spark, T.count_words, "ปัญญาประดิษฐ์") == 3
    assert one(spark, T.count_words, "AI ปัญญา x") == 3
    assert one(spark, T.count_words, "") == 0


def test_nulls(spark):
    row = spark.createDataFrame([(None,)], "u string").select(
        U.crawl_key(F.col("u")).alias("k"), U.is_web_url(F.col("u")).alias("w"), U.resource_type(F.col("u"), F.col("u"), F.lit(None).cast("int")).alias("r"),
        U.classify_link(F.lit(PAGE), F.col("u")).alias("c"), T.noindex(F.col("u")).alias("n"),
    ).first()
    assert (row["w"], row["c"], row["n"]) == (False, "invalid", False)
