"""Every core query with an SQL twin equals it; the others run and give rows."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from cellwise.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    names, rows = rows_of(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert (names, rows) == rows_of_sql(con, ORACLES[name])
    else:
        assert rows


def test_entry_runs_without_optional_part(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
