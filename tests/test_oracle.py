"""Every registered query against its DuckDB twin (sf0.001 here; the driver uses sf0.01)."""

import re

import pytest

import __spark_entry__ as E
from harness import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    problems, _, _, _ = compare(spark, con, name, SF, QUERIES[name], SQL[name])
    assert not problems, problems


#: Queries without a twin; those of the training-data operators have tests of their own.
ROWS_ONLY = sorted(n for n in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", n))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["month", "month_label", "n"]
    assert df.count() > 0
