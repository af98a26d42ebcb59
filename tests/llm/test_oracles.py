"""Queries of the subpackage against their DuckDB text, and the registry."""

import pytest

import check
from odd_rows import SF_DIR  # noqa: F401
from sluice.llm.registry import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert check.compare(spark, con, SF_DIR, QUERIES[name], SQL[name]) is None


def test_all_operators_are_registered():
    import __spark_entry__ as contract

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(QUERIES) <= set(contract.queries())
