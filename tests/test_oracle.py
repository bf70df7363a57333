"""Every registered query against its SQL on DuckDB over whole tables."""

import check_oracle
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(small):
    return check_oracle.connect(small)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, small, name):
    status, _dt, info = check_oracle.compare(spark, con, name, small)
    assert status in ("ok", "rows-only"), f"{name}: {status} {info}"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
