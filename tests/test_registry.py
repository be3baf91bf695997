import pytest
from conftest import SMALL
from parity import compare, connect

from radarlake.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    compare(QUERIES[name](spark, SMALL), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_works_without_the_optional_subpackage(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    row = e.entry(spark).first()
    assert row["finite_count"] > 0 and len(row["bins"]) == 256 and sum(row["bins"]) == row["finite_count"]


def test_flagship_takes_the_whole_raster(spark):
    from radarlake import testbed

    row = QUERIES["flagship"](spark, SMALL).first()
    assert row["finite_count"] + row["invalid_count"] == testbed.dense_hhhh(spark, SMALL).count()
