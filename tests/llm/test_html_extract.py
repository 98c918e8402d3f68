import time

from weblens.llm.html_extract import extract, extract_pages, page_paths

PLAIN = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
    '<div class="ad">Buy now.</div><article><h1>One &amp; two </h1><p><b>First para.<br><p>Second\n  para&nbsp;here.</p></article>'
    "<footer>&copy; me</footer></body></html>"
)

RICH = """<html><body><header class="site-header"><h1>Site</h1><a href=/>home</a></header>
<div class="cookie-notice"><p>We use cookies on this site, please accept all of them now.</p></div>
<div id="wrap"><div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">A story with a long title in the side bar</a></li></ul></div>
<div class="post-content"><h2>Heading</h2><p>Real text, with <a href="/b">a link</a> and more words in it.</p>
<div class="ad-slot"><p>Advert text that is long enough to look real, really.</p></div>
<p>Second<!-- hidden --> paragraph &lt;ok&gt;.</p><form><input name=q><button>Go</button>Search</form>
<ul><li>One</li><li>Two</ul><script>document.write("<p>no</p>")</script><table><tr><td>c1<td>c2</table></div>
<div class="comments"><p>I am a reader and this is my long comment, which goes on and on.</p></div></div>
<footer><p>Footer text that is quite long as well, with an address and so on.</p></footer>"""


def test_plain():
    assert extract(PLAIN, [page_paths(PLAIN)[0]]) == "One & two First para. Second para here."


def test_rich():
    path = page_paths(RICH)[0]
    assert path.endswith("div.post-content")
    assert extract(RICH, [path]) == "Heading Real text, with a link and more words in it. Second paragraph <ok>. One Two c1 c2"


def test_odd_pages():
    for source in ("", "   ", "just text", "<", "<p", "</div>", "<div><div><div>", "<b>x", "<!-- open", "<script>var a", "a < b > c &#x41; &bogus;"):
        extract(source, ["body>article"])
        page_paths(source)
    assert extract("just text", []) == "just text"
    assert extract("<div>" * 300 + "<p>deep</p>", []) == "deep"


def test_deep_and_broken_pages_take_linear_time():
    many = 50_000
    began = time.time()
    assert extract("<div>" * many + "<p>deep</p>", []) == "deep"
    assert extract("<b>" * many + "<p>deep</p>", []) == "deep"
    deep = "<div class=a>" * many + "<p>deep</p>"
    assert extract(deep, [page_paths(deep)[0]]) == "deep"
    for piece in (
        "<a ", '<a "', "<a ><i", "<ul>", "<ul></li>", "<li></li>", "<tr></tr>", "</b>", "<!", "<!--", "<p><b>", "<i><div></i>", "<script>", "<td>", "a<b>c</i>",
    ):
        for end in ("", ">", "'>", '">'):
            page = "<div><table>" + piece * (many // 5) + end
            extract(page, [])
            page_paths(page)
    assert extract("<p>" + "<a " * 1_700_000, []).startswith("<a <a")
    assert time.time() - began < 90


def test_eight_templates_on_one_host(spark):
    promo = "<div class=banner-box><p>The same offer stands on each page of the host, and it is long.</p></div>"
    promo = promo.replace("banner-box", "offer")
    rows, want = [], {}
    for k in range(8):
        for i in range(2 + 10 * (k == 0)):
            page_id, body = 100 * k + i, f"Text {i} of template {k}, which is a good bit longer than the offer that stands beside it."
            if i == 1:
                body = f"Short {k}."
            rows.append((page_id, "http://many.org/x", f"<html><body>{promo}<div class=t{chr(97 + k)}><p>{body}</p></div></body></html>"))
            want[page_id] = body
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_pages(pages).collect()} == want


def test_hosts_vote(spark):
    short = '<html><body><div class="main7"><p>Tiny.</p></div><div class="box"><p>{}</p></div></body></html>'
    full = '<html><body><div class="main{}"><p>{}</p></div><div class="box"><p>Box.</p></div></body></html>'
    rows = [(i, f"http://h.com/{i}", full.format(i, "A long and proper text of the page. " * 5), "x") for i in range(9)]
    rows += [(50, "http://H.com/odd", short.format("A box that happens to be much longer here than the page itself is."), "x")]
    rows += [(60, None, PLAIN, "x"), (61, "http://h2.com", None, "x"), (0, "http://h.com/0", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = extract_pages(pages).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert texts[50] == "Tiny."
    assert texts[61] == "" and texts[60] == "One & two First para. Second para here."
    assert texts[3] == " ".join(["A long and proper text of the page."] * 5)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(pages.where("page_id < 0")).collect() == []
