"""Event-time operators on Structured Streaming, and the same on batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import urls as U
from weblens.operators import audit, pages


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling or sliding windows; rows later than `late` are left out of streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of activity without a pause of `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_fetches(fetches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Fetched pages with the first fetch of each crawl key within the watermark."""
    rows = fetches.withColumn("crawl_key", U.crawl_key(F.col("url")))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["crawl_key"])


def audit_stream(arriving: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "page_id"):
    """Audit pages(key, url, html) as they arrive; `sink` gets each audited batch and its number. Returns the running query."""

    def each(batch: DataFrame, number: int) -> None:
        sink(audit.audit_pages(pages.parse_pages(batch, key)), number)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> dict:
    """What a crawl's progress endpoint tells: whether it runs, batches and rows so far."""
    last = query.lastProgress
    return {"running": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}
