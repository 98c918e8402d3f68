"""URL algebra as column expressions, without Python on the executors.

URLs are split by the RFC 3986 pattern, because the engine's own URL functions refuse spaces in paths and
underscores in hosts. Nothing here raises on malformed input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# File extensions of assets, content types of assets, tracking parameters.
ASSET_EXTENSIONS = (
    "jpg jpeg png gif webp avif svg ico bmp tif tiff heic pdf zip rar 7z gz mp3 mp4 m4a wav webm mov avi css js json xml txt csv"
    " woff woff2 ttf otf eot doc docx xls xlsx ppt pptx"
).split()
ASSET_TYPES = r"^(image/|font/|video/|audio/|text/css|javascript|application/font|application/vnd\.ms-fontobject)"
TRACKING = "gclid fbclid msclkid dclid yclid mc_cid mc_eid _ga _gl igshid ref_src spm".split()


def _of(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(F.trim(url), F.lit("")), _URI, k)


def scheme(url: Column) -> Column:
    return F.lower(_of(url, 1))


def _authority(url: Column) -> Column:
    return F.regexp_replace(_of(url, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without brackets, port or trailing dots; empty when there is none."""
    name = F.regexp_extract(_authority(url), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"[\[\]]", "")), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return _of(url, 3)


def query(url: Column) -> Column:
    return _of(url, 4)


def fragment(url: Column) -> Column:
    return _of(url, 5)


def valid(url: Column) -> Column:
    """Whether the authority can be read: closed brackets, and a port of digits up to 65535."""
    rest = F.regexp_replace(_authority(url), r"^(\[[^\]]*\]|[^:\[\]]*)", "")
    return rest.rlike(r"^(:(\d{1,4}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d\d|655[0-2]\d|6553[0-5])?)?$")


def site_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.+$", ""), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return (host(a) != "") & (site_key(host(a)) == site_key(host(b)))


def is_web_url(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & valid(url), F.lit(False))


def is_private_host(name: Column) -> Column:
    """Local names, and addresses that are private, loopback, link-local, reserved or unspecified."""
    name = F.lower(F.regexp_replace(name, r"^\[|\]$", ""))
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = name.rlike(rf"^{octet}(\.{octet}){{3}}$")
    a, b, c = (F.when(v4, F.split(name, r"\.")[k].cast("int")) for k in range(3))
    inside = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = name.contains(":") & name.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*|::ffff:(10|127)\..*|::ffff:192\.168\..*)$")
    return (name == "localhost") | name.endswith(".localhost") | name.endswith(".local") | F.coalesce(inside, F.lit(False)) | v6


def _clean_path(text: Column) -> Column:
    """Escaped unreserved characters decoded, other escapes in upper case, non-ASCII percent-encoded."""

    def one(t: Column) -> Column:
        code = F.conv(F.substring(t, 2, 2), 16, 10).cast("int")
        plain = F.char(code)
        escaped = F.when(plain.rlike(r"^[A-Za-z0-9\-._~]$"), plain).otherwise(F.upper(t))
        return F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), escaped).when(t.rlike(r"[^\x00-\x7F]"), F.url_encode(t)).when(t == " ", t).otherwise(t)

    parts = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.when(text.rlike(r"%|[^\x00-\x7F]"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or trailing slash; the query stays."""
    number = port(url)
    default = ((scheme(url) == "http") & (number == "80")) | ((scheme(url) == "https") & (number == "443"))
    name = F.concat(host(url), F.when((number == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number)))
    whole = _clean_path(F.when(path(url) == "", F.lit("/")).otherwise(path(url)))
    whole = F.when(F.length(whole) > 1, F.regexp_replace(whole, "/+$", "")).otherwise(whole)
    asked = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(scheme(url), F.lit("://"), name, whole, asked)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def crawl_key(url: Column) -> Column:
    """normalize() without tracking parameters and repeated keys, the others sorted and encoded again."""
    norm = normalize(url)
    given = F.filter(F.split(query(url), "&"), lambda p: p != "")
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    pairs = F.transform(
        given,
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(p.contains("="), decoded(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )
    wanted = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKING))
    first = F.filter(wanted, lambda p, i: F.array_position(F.transform(wanted, lambda w: w["k"]), p["k"]) == i + 1)
    text = F.array_join(F.transform(F.array_sort(first), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    bare = F.substring_index(norm, "?", 1)
    return F.when(query(url) == "", norm).when(text == "", bare).otherwise(F.concat(bare, F.lit("?"), text))


def is_asset_url(url: Column) -> Column:
    last = _clean_path(F.element_at(F.split(path(url), "/"), -1))
    return last.contains(".") & F.lower(F.element_at(F.split(last, r"\."), -1)).isin(ASSET_EXTENSIONS)


def resource_type(url: Column, content_type: Column, status: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    answered = (kind != "") & (F.coalesce(status, F.lit(0)) < 400)
    by_type = F.when(kind.contains("html"), "document").when(kind.rlike(ASSET_TYPES), "asset").otherwise("non_html")
    return F.when(answered, by_type).when(is_asset_url(url), "asset").otherwise("document")


def language_segment(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"(?i)^/([a-z]{2}(?:[-_][a-z]{2})?)(?:/|$)", 1)
    return F.when(found != "", F.replace(F.lower(found), F.lit("_"), F.lit("-")))


def resolve(base: Column, href: Column) -> Column:
    """href against an absolute base: absolute and scheme-relative URLs, absolute and relative paths, queries and fragments."""
    href = F.trim(href)
    root = F.concat(scheme(base), F.lit("://"), _of(base, 2))
    base_path = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    tail = lambda u: F.regexp_extract(u, r"(?s)^[^?#]*(.*)$", 1)
    bare = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    asked = F.when(query(base) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(base)))
    return (
        F.when(href.isNull() | (href == "") | ~valid(href), F.lit(None).cast("string"))
        .when(_of(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(root, path(base), asked, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("/"), F.concat(root, without_dots(bare), tail(href)))
        .otherwise(F.concat(root, without_dots(F.concat(folder, bare)), tail(href)))
    )


def without_dots(text: Column) -> Column:
    """RFC 3986 removal of "." and ".." segments."""
    parts = F.split(text, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done))
        .otherwise(F.concat(done, F.array(s))),
    )
    dir_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(text.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(dir_end, "/").otherwise(""))).otherwise(text)


def classify_link(page_url: Column, href: Column, absolute: Column | None = None) -> Column:
    """internal, external, anchor, mailto, tel, javascript or invalid. `absolute` is the resolved href, where it is known."""
    raw = F.trim(F.coalesce(href, F.lit("")))
    low, absolute = F.lower(raw), resolve(page_url, raw) if absolute is None else absolute
    same_page = (fragment(absolute) != "") & (normalize(absolute) == normalize(page_url))
    return (
        F.when(raw == "", "invalid")
        .when(low.startswith("#"), "anchor")
        .when(low.startswith("mailto:"), "mailto")
        .when(low.startswith("tel:"), "tel")
        .when(low.startswith("javascript:"), "javascript")
        .when(~is_web_url(absolute), "invalid")
        .when(same_page, "anchor")
        .when(same_site(absolute, page_url), "internal")
        .otherwise("external")
    )


def public_url(url: Column, public_host: Column) -> Column:
    """The same path and query on the site's public host."""
    asked = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(F.lit("https://"), public_host, path(url), asked)


def path_and_query(url: Column) -> Column:
    asked = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(F.when(path(url) == "", F.lit("/")).otherwise(path(url)), asked)
