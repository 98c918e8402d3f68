"""Whether a page needs a browser, and which of its two parses counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.config import Settings

# Patterns of empty application roots and of client-side frameworks.
APP_ROOT = r"""(?i)<div[^>]+id=["'](root|app|__next|__nuxt|svelte)["'][^>]*>\s*</div>"""
FRAMEWORKS = (
    r"(?i)data-reactroot|__NEXT_DATA__|react(-dom)?(\.production)?(\.min)?\.js"
    r"|data-v-app|__NUXT__|vue(\.runtime)?(\.global)?(\.prod)?(\.min)?\.js"
    r"|ng-version|ng-app|<app-root|__sveltekit|svelte-"
)
SCRIPTS = r"(?i)<script\b"
HEAD = ("title", "meta_description", "canonical", "hreflang", "og_title", "og_description", "og_image", "twitter_card")
_WITH = {"title": ("title_length",), "meta_description": ("meta_description_length",), "canonical": ("canonical_absolute_url",)}


def render_reasons(html: Column, words: Column, headings: Column, links: Column, settings: Settings | None = None) -> Column:
    """Reasons to render, as an array; empty where the server's HTML is enough."""
    s = settings or Settings()
    root, framework = html.rlike(APP_ROOT), html.rlike(FRAMEWORKS)
    scripts = F.regexp_count(html, F.lit(SCRIPTS))
    reasons = F.array_compact(
        F.array(
            F.when(words < s.render_min_words, F.lit("low visible word count")),
            F.when(headings == 0, F.lit("no headings")),
            F.when(links < 3, F.lit("fewer than 3 meaningful links")),
            F.when(root, F.lit("empty client-side app root element")),
            F.when(framework, F.lit("client-side framework detected")),
            F.when((scripts >= 5) & (words < 2 * s.render_min_words), F.lit("scripts with minimal HTML content")),
        )
    )
    needed = (words < s.render_min_words) | root | (framework & ((headings == 0) | (links < 3)))
    return F.when(needed, reasons).otherwise(F.array().cast("array<string>"))


def render_required(reasons: Column, mode: str = "auto") -> Column:
    return F.lit(mode == "always") | (F.lit(mode == "auto") & (F.size(reasons) > 0))


def use_rendered(raw_words: Column, words: Column, raw_headings: Column, headings: Column, raw_links: Column, links: Column) -> Column:
    return (words >= raw_words * 1.2 + 20) | (headings > raw_headings) | (links > raw_links + 5)


def merge(raw: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """The parse that counts of every page of raw, with source, raw_word_count, render_status and metadata_source.

    Both are parsed pages; pages that rendered lacks were not rendered. Where the raw body counts, head fields that only the
    rendered page has are taken from it.
    """
    other = rendered.select(F.col(key).alias("_key"), F.struct(*(F.col(c) for c in rendered.columns)).alias("r"))
    both = raw.join(other, F.col(key) == F.col("_key"), "left")
    seen = F.col("r").isNotNull()
    pick = seen & use_rendered(
        F.col("word_count"), F.col("r.word_count"), F.size("headings"), F.size("r.headings"), F.col("links_total"), F.col("r.links_total")
    )

    def full(name: str, of: str = "") -> Column:
        c = F.col(of + name)
        return (F.size(c) > 0) if name == "hreflang" else (F.coalesce(c, F.lit("")) != "")

    origin = {
        f: F.when(full(f), "server_html").when(seen & full(f, "r."), "rendered_dom").otherwise("missing") for f in HEAD
    }
    taken = {c: f for f in HEAD for c in (f, *_WITH.get(f, ()))}
    out = []
    for c in raw.columns:
        own = F.when(F.col("_pick"), F.col(f"r.{c}"))
        if c in taken:
            own = own.when(F.col("metadata_source")[taken[c]] == "rendered_dom", F.col(f"r.{c}"))
        out.append(own.otherwise(F.col(c)).alias(c))
    sources = F.create_map(*(x for f, c in origin.items() for x in (F.lit(f), c)))
    both = both.withColumn("metadata_source", sources).withColumn("_pick", F.coalesce(pick, F.lit(False)))
    return both.select(
        *out,
        "metadata_source",
        F.when(F.col("_pick"), "rendered").otherwise("raw").alias("source"),
        F.col("word_count").alias("raw_word_count"),
        F.when(seen, "rendered").otherwise("not_needed").alias("render_status"),
    )
