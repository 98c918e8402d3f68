"""The rule catalogue as data: codes with category and severity, advice, scoring and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (code, category, severity) of the page rules.
PAGE_RULES = [
    ("TITLE_MISSING", "metadata", "critical"),
    ("TITLE_TOO_SHORT", "metadata", "warning"),
    ("TITLE_TOO_LONG", "metadata", "warning"),
    ("META_DESCRIPTION_MISSING", "metadata", "warning"),
    ("META_DESCRIPTION_TOO_SHORT", "metadata", "info"),
    ("META_DESCRIPTION_TOO_LONG", "metadata", "info"),
    ("H1_MISSING", "headings", "warning"),
    ("MULTIPLE_H1", "headings", "warning"),
    ("EMPTY_HEADING", "headings", "warning"),
    ("HEADING_ORDER_SKIPPED", "headings", "info"),
    ("CANONICAL_MISSING", "canonical", "warning"),
    ("CANONICAL_INVALID", "canonical", "critical"),
    ("CANONICAL_PRIVATE_IP", "canonical", "critical"),
    ("CANONICAL_DOMAIN_MISMATCH", "canonical", "warning"),
    ("CANONICAL_HTTP_WHEN_PAGE_HTTPS", "canonical", "warning"),
    ("HREFLANG_INVALID", "hreflang", "warning"),
    ("HREFLANG_PRIVATE_IP", "hreflang", "critical"),
    ("HREFLANG_DOMAIN_MISMATCH", "hreflang", "info"),
    ("HREFLANG_DUPLICATE_LANGUAGE", "hreflang", "warning"),
    ("IMAGE_ALT_MISSING", "images", "warning"),
    ("EMPTY_LINK", "links", "warning"),
    ("JAVASCRIPT_LINK", "links", "info"),
    ("INVALID_LINK", "links", "warning"),
    ("NOINDEX_PAGE", "robots", "warning"),
    ("NOFOLLOW_PAGE", "robots", "info"),
    ("OG_TITLE_MISSING", "open_graph", "info"),
    ("OG_DESCRIPTION_MISSING", "open_graph", "info"),
    ("OG_IMAGE_MISSING", "open_graph", "info"),
    ("TWITTER_CARD_MISSING", "twitter", "info"),
    ("EMPTY_MAIN_CONTENT", "content", "critical"),
    ("VERY_THIN_CONTENT", "content", "warning"),
    ("THIN_CONTENT", "content", "info"),
    ("STRUCTURED_DATA_NOT_FOUND", "structured_data", "info"),
    ("STRUCTURED_DATA_INVALID_JSON", "structured_data", "warning"),
    ("METADATA_REQUIRES_JS", "rendering", "info"),
    ("CONTENT_REQUIRES_JS", "rendering", "warning"),
]
# The same of the site rules.
SITE_RULES = [
    ("SITEMAP_NOT_FOUND", "sitemap", "warning"),
    ("SITEMAP_EMPTY_OR_INVALID", "sitemap", "warning"),
    ("SITEMAP_NOT_IN_ROBOTS", "sitemap", "info"),
    ("SITEMAP_URL_NON_200", "sitemap", "warning"),
    ("SITEMAP_URL_REDIRECT", "sitemap", "warning"),
    ("SITEMAP_URL_NOINDEX", "sitemap", "warning"),
    ("SITEMAP_URL_CANONICALIZED", "sitemap", "warning"),
    ("SITEMAP_URL_BLOCKED", "sitemap", "warning"),
    ("SITEMAP_DUPLICATE_URLS", "sitemap", "info"),
    ("PAGES_MISSING_FROM_SITEMAP", "sitemap", "warning"),
    ("SITEMAP_ANALYSIS_INCOMPLETE", "sitemap", "info"),
    ("DUPLICATE_TITLE", "metadata", "warning"),
    ("DUPLICATE_META_DESCRIPTION", "metadata", "warning"),
    ("NOINDEX_PAGES", "indexability", "info"),
    ("CANONICALIZED_PAGES", "indexability", "info"),
    ("CANONICAL_TO_NON_INDEXABLE", "indexability", "critical"),
    ("SOFT_404_CANDIDATES", "indexability", "warning"),
    ("ROBOTS_BLOCKED_PAGES", "indexability", "info"),
    ("BROKEN_PAGES", "indexability", "warning"),
    ("RENDER_FAILED_PAGES", "indexability", "warning"),
    ("ROBOTS_TXT_INVALID", "robots", "warning"),
    ("BROKEN_INTERNAL_LINKS", "architecture", "critical"),
    ("BROKEN_RESOURCE_LINKS", "architecture", "warning"),
    ("REDIRECTED_INTERNAL_LINKS", "architecture", "warning"),
    ("ORPHAN_PAGE_CANDIDATES", "architecture", "warning"),
    ("DEAD_END_PAGES", "architecture", "info"),
    ("WEAKLY_LINKED_PAGES", "architecture", "info"),
    ("IMPORTANT_PAGES_TOO_DEEP", "architecture", "warning"),
    ("DEEP_PAGES", "architecture", "info"),
]
#: What to do about each.
ADVICE = {
    "TITLE_MISSING": "This page has no title. Write one that says what this page alone is about.",
    "TITLE_TOO_SHORT": "A few more words in the title would tell readers what to expect.",
    "TITLE_TOO_LONG": "Result lists cut titles of this length; move the key words to the front and drop the rest.",
    "META_DESCRIPTION_MISSING": "Sum the page up in one or two sentences in its description tag.",
    "META_DESCRIPTION_TOO_SHORT": "The description is very brief. Say more of what readers find here.",
    "META_DESCRIPTION_TOO_LONG": "Only the first part of such a description is shown; tighten it.",
    "H1_MISSING": "State the page's subject in a first-level heading.",
    "MULTIPLE_H1": "Several first-level headings compete. Keep the main one and lower the level of the others.",
    "EMPTY_HEADING": "Some headings have nothing in them: fill them in or delete them.",
    "HEADING_ORDER_SKIPPED": "Go down one heading level at a time, so that the outline has no gaps.",
    "CANONICAL_MISSING": "Name the address that should stand for this page in a canonical link.",
    "CANONICAL_INVALID": "The canonical address cannot be read; give a full web address.",
    "CANONICAL_PRIVATE_IP": "Nobody outside can reach the canonical address. Set the site's public base address.",
    "CANONICAL_DOMAIN_MISMATCH": "The canonical link leads to another site. Check that this is wanted.",
    "CANONICAL_HTTP_WHEN_PAGE_HTTPS": "The page is served securely but its canonical address is not; change the scheme.",
    "HREFLANG_INVALID": "An alternate has an unknown language code or an unusable address. Correct both against the standard lists.",
    "HREFLANG_PRIVATE_IP": "Alternates lead into the internal network; replace their host by the public one.",
    "HREFLANG_DOMAIN_MISMATCH": "An alternate lives on a different domain. That is fine if that page links back.",
    "HREFLANG_DUPLICATE_LANGUAGE": "A language is listed more than once; leave one alternate for each.",
    "IMAGE_ALT_MISSING": "Describe pictures that carry meaning, and mark the rest as decoration by an empty alt.",
    "EMPTY_LINK": "Screen readers have nothing to say for some links. Give them words or a label.",
    "JAVASCRIPT_LINK": "Links that run scripts lead crawlers nowhere; put an address in them.",
    "INVALID_LINK": "Some links have no usable address. Repair or drop them.",
    "NOINDEX_PAGE": "The page asks to stay out of search. Lift that if visitors should find it there.",
    "NOFOLLOW_PAGE": "No link of this page counts, by its own wish. Lift that unless it is intended.",
    "OG_TITLE_MISSING": "Shared links will lack a headline without og:title.",
    "OG_DESCRIPTION_MISSING": "Shared links will lack a summary without og:description.",
    "OG_IMAGE_MISSING": "Shared links will lack a picture without og:image.",
    "TWITTER_CARD_MISSING": "A card tag would control how the link looks on some networks.",
    "EMPTY_MAIN_CONTENT": "No words could be read from the page at all.",
    "VERY_THIN_CONTENT": "Hardly any words were found; see if visitors get what they came for. (An estimate.)",
    "THIN_CONTENT": "There are rather few words for a page; judge if they are enough. (An estimate.)",
    "STRUCTURED_DATA_NOT_FOUND": "Machine-readable facts in JSON-LD could help search engines here.",
    "STRUCTURED_DATA_INVALID_JSON": "A JSON-LD block does not parse. Mend its syntax.",
    "METADATA_REQUIRES_JS": "Titles or tags show up only once scripts have run. Put them into what the server sends.",
    "CONTENT_REQUIRES_JS": "Without scripts this page is nearly blank; send its text from the server.",
    "SITEMAP_NOT_FOUND": "The site offers no sitemap. Create one and name it in robots.txt.",
    "SITEMAP_EMPTY_OR_INVALID": "What is served as sitemap lists nothing readable; generate it again.",
    "SITEMAP_NOT_IN_ROBOTS": "Crawlers look for the sitemap in robots.txt, which does not mention it.",
    "SITEMAP_URL_NON_200": "Listed addresses fail. Take them off the list or bring the pages back.",
    "SITEMAP_URL_REDIRECT": "Listed addresses lead elsewhere; list where they end.",
    "SITEMAP_URL_NOINDEX": "The list invites search engines to pages that turn them away. Settle on one.",
    "SITEMAP_URL_CANONICALIZED": "Listed pages name others as their originals; list those.",
    "SITEMAP_URL_BLOCKED": "Listed addresses are off limits by robots.txt. Open them or strike them out.",
    "SITEMAP_DUPLICATE_URLS": "Addresses occur repeatedly in the sitemaps; one mention will do.",
    "PAGES_MISSING_FROM_SITEMAP": "Pages fit for search are on no list. Add them.",
    "SITEMAP_ANALYSIS_INCOMPLETE": "Part of the sitemaps could not be read, so their findings are a lower bound.",
    "DUPLICATE_TITLE": "Different pages go by one title; tell them apart.",
    "DUPLICATE_META_DESCRIPTION": "Different pages share a description; write each its own.",
    "NOINDEX_PAGES": "These pages keep themselves out of search. See if that is still meant.",
    "CANONICALIZED_PAGES": "These pages hand their rank to others. See if that is still meant.",
    "CANONICAL_TO_NON_INDEXABLE": "Originals named here are dead or hidden; name pages that live and may be listed.",
    "SOFT_404_CANDIDATES": "These look like error pages but report success. Send the error status, or fill them.",
    "ROBOTS_BLOCKED_PAGES": "Crawlers are kept off these addresses. See if that is still meant.",
    "BROKEN_PAGES": "These addresses fail; repair them and what leads there.",
    "RENDER_FAILED_PAGES": "A browser could not show these pages; look for script errors and missing files.",
    "ROBOTS_TXT_INVALID": "A web page is served in place of robots.txt. Serve text.",
    "BROKEN_INTERNAL_LINKS": "Links within the site end in errors. Correct or delete them.",
    "BROKEN_RESOURCE_LINKS": "Files that pages link to are gone. Put them back or drop the links.",
    "REDIRECTED_INTERNAL_LINKS": "Links take a detour; let them lead to the end straight away.",
    "ORPHAN_PAGE_CANDIDATES": "No page leads here. Link to these pages from fitting places, or retire them.",
    "DEAD_END_PAGES": "Visitors find no way on from here; offer some.",
    "WEAKLY_LINKED_PAGES": "Barely any page leads here; mention these pages where they fit.",
    "IMPORTANT_PAGES_TOO_DEEP": "Pages that matter take many clicks. Bring them nearer to the start.",
    "DEEP_PAGES": "These pages take many clicks; shorten the way by overviews.",
}
# Check groups, penalties as (base, cap), grades, order of severities.
GROUPS = "metadata headings canonical hreflang images links robots open_graph twitter content structured_data".split()
PENALTIES = {"critical": (15, 30), "warning": (5, 10), "info": (0, 0), "passed": (0, 0)}
GRADES = [(90, "excellent"), (75, "good"), (50, "needs_improvement"), (0, "poor")]
SEVERITIES = ["critical", "warning", "info", "passed"]

_OF = {code: (category, severity) for code, category, severity in PAGE_RULES + SITE_RULES}


def category_of(code: str) -> str:
    return _OF[code][0]


def severity_of(code: str) -> str:
    return _OF[code][1]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rule dimension: code, category, severity, recommendation. 65 rows, so it can be broadcast."""
    return spark.createDataFrame([(*rule, ADVICE[rule[0]]) for rule in PAGE_RULES + SITE_RULES], "code string, category string, severity string, recommendation string")


def advice(code: Column) -> Column:
    """What to do about an issue; null for passed groups."""
    return F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))[code]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def penalty(severity: Column, count: Column) -> Column:
    out = F.lit(0)
    for name, (base, cap) in PENALTIES.items():
        out = F.when(severity == name, F.least(count * base, F.lit(cap))).otherwise(out)
    return out


def score(penalties: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalties)).cast("int")


def grade(points: Column) -> Column:
    out = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES[:-1]):
        out = F.when(points >= least, name).otherwise(out)
    return out
