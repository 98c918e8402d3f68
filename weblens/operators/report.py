"""Reports: Markdown text of an audited page, and JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.functions.text import short
from weblens.operators.rules import SEVERITIES, advice

#: Characters of an issue's value in a report.
FOUND = 300


def cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))


def header_line() -> Column:
    return F.format_string(
        "**Score:** %d/100 (%s) | critical %d, warning %d, info %d, passed %d",
        "score", "grade", "critical_count", "warning_count", "info_count", "passed_count",
    )


def markdown(audited: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, markdown): page table, score and the issues of each severity."""
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), cell(value), F.lit(" |"))
    table = F.concat_ws(
        "\n",
        F.lit("| Field | Value |\n|---|---|"),
        row("URL", F.col("url")),
        row("Title", F.col("title")),
        row("Meta description", F.col("meta_description")),
        row("Canonical", F.col("canonical")),
        row("Language", F.col("language")),
        row("Words", F.col("word_count").cast("string")),
        row("Main content words", F.col("main_content_word_count").cast("string")),
        row("Images without alt", F.col("images_without_alt").cast("string")),
        row("Internal links", F.col("internal_links_count").cast("string")),
        row("External links", F.col("external_links_count").cast("string")),
    )

    def section(severity: str) -> Column:
        own = F.filter("issues", lambda x: x["severity"] == severity)
        found = lambda x: F.when(x["value"].isNotNull(), F.concat(F.lit(" — Found: "), cell(short(x["value"], FOUND)))).otherwise("")
        todo = lambda x: F.coalesce(F.concat(F.lit("\n  "), advice(x["code"])), F.lit(""))
        lines = F.transform(own, lambda x: F.concat(F.lit("- **"), x["code"], F.lit("** ×"), x["count"].cast("string"), found(x), todo(x)))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"## {severity.capitalize()}\n\n"), F.array_join(lines, "\n")))

    text = F.concat_ws("\n\n", F.concat(F.lit("# Page audit: "), F.col("url")), table, header_line(), *map(section, SEVERITIES))
    return audited.select(key, text.alias("markdown"))


def success(data: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))


def failure(code: str, message: Column, details: Column | None = None) -> Column:
    parts = [F.lit(code).alias("code"), message.alias("message")] + ([details.alias("details")] if details is not None else [])
    return F.to_json(F.struct(F.lit(False).alias("success"), F.struct(*parts).alias("error")))
