"""Every registered query against its DuckDB oracle (the driver's gate), plus
rows-only smoke runs for the queries without one."""

import pytest

import __spark_entry__ as entry
from conftest import SF_CHECK, SF_SMALL
from oracle_check import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_CHECK)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    ok, msg = compare(df.columns, srows, ocols, cur.fetchall())
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_CHECK).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["report_date", "device_category"]


def test_small_scale_runs(spark):
    for name in ("sessions", "kpis_daily", "customer_rfm", "ab_decision"):
        assert QUERIES[name](spark, SF_SMALL).count() > 0
