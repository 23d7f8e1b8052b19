"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
BUILT, SQLS = contract.queries(), contract.oracle_sql()
FITTED = {"predictions_certificate"}  # 75 fits at full size: left to tools/compare.py


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(SQLS) - FITTED))
def test_matches_sql(spark, con, name):
    line = compare(spark, con, SF, name, BUILT[name], SQLS[name])
    assert line.startswith("OK"), line


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0].pct_gt50_before <= 1


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(BUILT)
