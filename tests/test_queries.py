from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphwright.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def key(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLES:
        wanted = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
        assert sorted(con.sql(ORACLES[name]).columns) == columns
        assert key(rows) == key(wanted.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_conversions_run_over_all_orders(spark):
    orders, customers, nations = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "customer", "nation"))
    assert QUERIES["instances_reference_orders"](spark, SF).count() == orders + customers + nations
    assert QUERIES["instances_inline_orders"](spark, SF).count() == orders
