"""Text expressions of the page rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI = r"฀-๿"
#: Thai has no blanks between words; a run counts one word for so many code points.
THAI_CHARS_PER_WORD = 5
SOFT_404 = r"(?i)\b(404|not found|page not found|page doesn.t exist)\b|ไม่พบ(หน้า)?"


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def count_words(text: Column) -> Column:
    """Blank-separated tokens with a letter or digit, and Thai runs by their length."""
    thai = F.regexp_extract_all(text, F.lit(f"[{THAI}]+"), F.lit(0))
    estimated = F.aggregate(thai, F.lit(0), lambda n, t: n + F.ceil(F.length(t) / THAI_CHARS_PER_WORD).cast("int"))
    other = F.regexp_count(text, F.lit(rf"(?U)[^\s{THAI}]*?[\p{{L}}\p{{N}}&&[^{THAI}]][^\s{THAI}]*"))
    return F.when(text.rlike(f"[{THAI}]"), estimated).otherwise(0) + other


def thai_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(rf"[\p{{L}}&&[{THAI}]]")) / letters)


def soft_404(title: Column, h1: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(h1, F.lit(""))).rlike(SOFT_404)


def noindex(directives: Column) -> Column:
    """Whether a directive list has noindex or none, with or without the name of a robot before it."""
    tokens = F.split(F.lower(F.coalesce(directives, F.lit(""))), r"[,\s]+")
    return F.exists(tokens, lambda t: F.element_at(F.split(t, ":"), -1).isin("noindex", "none"))


def short(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def valid_hreflang(lang: Column) -> Column:
    return lang.rlike(r"(?i)^(x-default|[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|\d{3}))?)$")


def detect_language(html_lang: Column, url_path: Column, text: Column) -> Column:
    """struct(language, signal): the html element's, the URL's first segment, or the script of the text."""
    tag = F.lower(F.element_at(F.split(F.element_at(F.split(html_lang, "-"), 1), "_"), 1))
    segment = F.lower(F.regexp_extract(url_path, r"(?i)^/([a-z]{2})(?:[-_][a-z]{2})?(?:/|$)", 1))
    pick = lambda value, signal: F.struct(value.alias("language"), F.lit(signal).alias("signal"))
    return (
        F.when(F.coalesce(html_lang, F.lit("")) != "", pick(tag, "html_lang"))
        .when(segment != "", pick(segment, "url_segment"))
        .when(thai_share(text) > 0.5, pick(F.lit("th"), "script_ratio"))
        .otherwise(pick(F.lit(""), "unknown"))
    )
