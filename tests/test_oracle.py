"""Every registered query against its SQL in DuckDB; the others must run and give rows."""

import pytest

from bookheat.plans.catalog import CHECKS, JOBS
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"
MAY_BE_EMPTY = {"change_points", "portfolio_change_points"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(JOBS))
def test_query(spark, duck, name):
    diff, info = compare(spark, duck, SF, name, JOBS[name], CHECKS.get(name))
    assert diff is None, diff
    if name not in CHECKS and name not in MAY_BE_EMPTY:
        assert " 0 rows" not in info


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 1
    assert 0 <= rows[0]["score"] <= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
