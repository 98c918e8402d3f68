"""Every registered query of the page and site operators against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from weblens.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(cells):
    return sorted(tuple("NULL" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in cells)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert rows([tuple(r) for r in got.select(*names).collect()]) == rows([tuple(r[k] for k in order) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
