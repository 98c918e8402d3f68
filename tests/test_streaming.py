import pytest
from pyspark.sql import functions as F

from weblens.streaming import counters, events


def test_windows(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    out = events.windowed_counts(rows)
    assert out.agg(F.sum("n")).first()[0] == rows.count()
    assert events.windowed_counts(rows, "1 hour", "15 minutes").agg(F.sum("n")).first()[0] == 4 * rows.count()
    assert events.sessions(rows).agg(F.sum("n")).first()[0] == rows.count()


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").coalesce(2).write.parquet(f"file://{folder}")
    stream = spark.readStream.schema(schema).parquet(f"file://{folder}")
    query = events.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").count() > 0 and not events.progress(query)["running"]


def test_audit_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/pages.parquet")
    folder = tmp_path / "pages"
    source.write.parquet(f"file://{folder}")
    stream = spark.readStream.schema(source.schema).parquet(f"file://{folder}")
    out = f"file://{tmp_path}/audits"
    query = events.audit_stream(stream, lambda batch, n: batch.select("page_id", "score").write.mode("append").parquet(out), f"file://{tmp_path}/c2")
    query.awaitTermination(120)
    assert spark.read.parquet(out).count() == source.count()


def test_counters(spark, tmp_path):
    pytest.importorskip("pandas")
    rows = [(1, 200, False), (1, 404, False), (2, None, False), (1, 200, True)]
    folder = tmp_path / "f"
    data = spark.createDataFrame(rows, "crawl_id long, status_code int, last boolean")
    data.coalesce(1).write.parquet(f"file://{folder}")
    stream = spark.readStream.schema(data.schema).parquet(f"file://{folder}")
    query = counters.crawl_counters(stream).writeStream.format("memory").queryName("counters").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counters").collect()} == {(1, 3, 1, True), (2, 1, 1, False)}
