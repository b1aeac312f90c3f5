"""Every registered query that has SQL gives the same rows as its SQL."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def database(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal_to_sql(spark, database, small, name):
    assert differences(queries()[name](spark, small), database, oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["scope"] for r in rows} == {
        "positive_price_rows_before_cap",
        "included_after_iqr_cap",
        "excluded_above_iqr_cap",
    }
