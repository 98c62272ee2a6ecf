"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 < row.mean_jaccard <= row.mean_dice <= row.mean_overlap <= 1


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)
