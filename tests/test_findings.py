"""Findings: a site issue that a root cause says as well, private hosts, and what is optional."""

import json

from weblens.operators import rollup


def test_folded(spark):
    site = lambda *statuses: spark.createDataFrame([("CANONICAL_TO_NON_INDEXABLE", "critical", 2, list(statuses)), ("BROKEN_PAGES", "warning", 3, None)], "code string, severity string, affected int, statuses array<string>")
    detected = [(1, "CANONICAL_PRIVATE_IP"), (1, "HREFLANG_PRIVATE_IP"), (2, "CANONICAL_PRIVATE_IP"), (3, "TITLE_TOO_SHORT")]
    issues = spark.createDataFrame(detected, "page_id int, code string")
    explained = rollup.root_causes(issues)
    causes, rows = rollup.root_cause_summary(explained, 4), rollup.issue_rollup(issues, 4, explained)
    got = {r["code"]: r for r in rollup.findings(site("private_host", "private_host"), causes, rows, 4, 6).collect()}
    assert set(got) == {"PRIVATE_BASE_URL_CONFIGURATION", "BROKEN_PAGES", "TITLE_TOO_SHORT"}
    cause = got["PRIVATE_BASE_URL_CONFIGURATION"]
    assert (cause["affected"], cause["percentage"], cause["drilldown"]) == (2, 50.0, "pages?issue=CANONICAL_PRIVATE_IP&include_audit=true")
    assert json.loads(cause["evidence"]) == {"detections": {"CANONICAL_PRIVATE_IP": 2, "HREFLANG_PRIVATE_IP": 1}, "site_level": {"code": "CANONICAL_TO_NON_INDEXABLE", "count": 2}}
    assert got["BROKEN_PAGES"]["percentage"] == 50.0 and got["TITLE_TOO_SHORT"]["percentage"] == 25.0
    mixed = {r["code"] for r in rollup.findings(site("private_host", "invalid"), causes, rows).collect()}
    assert "CANONICAL_TO_NON_INDEXABLE" in mixed
    uncaused = rollup.findings(site("private_host"), causes.limit(0), rows).collect()
    assert "CANONICAL_TO_NON_INDEXABLE" in {r["code"] for r in uncaused} and all(r["percentage"] is None for r in uncaused)


def test_private_hosts(spark):
    explained = spark.createDataFrame([(1, "CANONICAL_PRIVATE_IP", "PRIVATE_BASE_URL_CONFIGURATION"), (2, "OG_TITLE_MISSING", "ROUTE_HEAD_METADATA_MISSING")], "page_id int, code string, root_cause string")
    hosts = spark.createDataFrame([(1, "10.0.0.1"), (1, "10.0.0.1"), (2, "10.0.0.2")], "page_id int, host string")
    assert [tuple(r) for r in rollup.private_hosts(explained, hosts).collect()] == [("10.0.0.1", 1)]


def test_pages_are_parsed_once(spark, sf, monkeypatch):
    """The list of findings reads the detections several times, and pages as often as they are parsed."""
    from weblens.operators import pages
    from weblens.plans.catalogue import QUERIES

    parsed, parse = spark.sparkContext.accumulator(0), pages.parse_raw

    def counting(rows, key="page_id"):
        def run(batches):
            for batch in batches:
                parsed.add(batch.num_rows)
                yield batch

        return parse(rows.mapInArrow(run, rows.schema), key)

    monkeypatch.setattr(pages, "parse_raw", counting)
    QUERIES["findings_union"](spark, sf).collect()
    assert parsed.value == spark.read.parquet(f"{sf}/pages.parquet").count()
