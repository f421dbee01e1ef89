"""Every query with SQL gives the same rows in Spark and DuckDB; the others give rows."""

import pytest
from conftest import SF_CHECK
from oracle_check import compare

import __spark_entry__ as entry
from periodica.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    message, rows = compare(spark, duck, SF_CHECK, name, QUERIES[name], SQL.get(name))
    assert message is None, message
    assert rows > 0


def test_ridge_returns_every_season(spark):
    rows = QUERIES["ridge"](spark, SF_CHECK).groupBy("season").agg({"f_ridge": "count"}).collect()
    valued = {r["season"]: r[1] for r in rows}
    first = min(valued)
    assert len(valued) == 6 and valued.pop(first) == 0 and all(valued.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "vor_ppg" in df.columns
