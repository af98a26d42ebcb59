"""Every registered query against its DuckDB text on the test tables."""

import pytest

import check
from conftest import SF_DIR
from sluice.plans.catalog import load

# Too few chunks per queue at the smallest scale to have a failed one.
EMPTY_WHEN_SMALL = {"sqs_isolation_plan"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in load().items() if q.sql])
def test_matches_sql(spark, con, name):
    q = load()[name]
    found = check.compare(spark, con, SF_DIR, q.build, q.sql)
    assert found is None or (found == "empty" and name in EMPTY_WHEN_SMALL), found


def test_entry_runs(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert sum(r["events"] for r in rows) > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
