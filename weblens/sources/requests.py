"""Lenient request bodies as rows: raw HTML, forms, JSON, and JSON in a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.config import Settings


def _form(body: Column, name: str) -> Column:
    pairs = F.filter(F.split(body, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.regexp_replace(F.get(pairs, 0), "^[^=]*=", "")
    return F.coalesce(F.try_url_decode(value), value)


def read_requests(requests: DataFrame, settings: Settings | None = None) -> DataFrame:
    """requests(url_param, content_type, body) -> url, html, error_code; rows with an error_code are the quarantine.

    A URL parameter makes the body the HTML; a form gives its first values; otherwise the body is a JSON object or
    a JSON string that holds one.
    """
    limit = (settings or Settings.of(requests.sparkSession)).max_html_bytes
    body = F.coalesce(F.col("body").cast("string"), F.lit(""))
    schema = "struct<url:string,html:string>"
    inner = F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x")
    parsed = F.coalesce(F.when(F.ltrim(body).startswith("{"), F.from_json(body, schema)), F.from_json(inner, schema))
    raw, form = F.col("url_param").isNotNull(), F.coalesce("content_type", F.lit("")).startswith("application/x-www-form-urlencoded")
    url = F.when(raw, F.col("url_param")).when(form, _form(body, "url")).otherwise(parsed["url"])
    html = F.when(raw, body).when(form, _form(body, "html")).otherwise(parsed["html"])
    rows = requests.withColumn("url", F.regexp_replace(url, r"(?U)\s+", "")).withColumn("html", html)
    error = (
        F.when(F.octet_length(body) > 2 * limit + 65536, "body_too_large")
        .when(F.col("url").isNull() | F.col("html").isNull(), "invalid_body")
        .when(~F.col("url").rlike("(?i)^https?://[^/?#]+"), "invalid_url")
        .when(F.trim("html") == "", "blank_html")
        .when(F.octet_length("html") > limit, "html_too_large")
        .when(~F.col("html").contains("<"), "not_html")
    )
    return rows.withColumn("error_code", error)
