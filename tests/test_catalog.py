"""The registered queries: shape of the contract, and a few against DuckDB."""

import os

import pytest

from tidyward.plans.catalog import EXPECTED, QUERIES
from tidyward.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(EXPECTED) <= set(QUERIES)
    assert all(callable(q) for q in QUERIES.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", ["hotspots", "address_parse", "compare_keys", "strata", "kpis"])
def test_equal_to_expected(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(EXPECTED[name])
    columns = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
