import pytest
from oracle import connect, differences

import __spark_entry__ as contract
from sightline.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"svm_report", "logreg_report"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert differences(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_sketched_count_is_near_the_exact_one(spark, con):
    exact = con.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]
    assert abs(QUERIES["distinct_ids_sketch"](spark, FOLDER).first()[0] / exact - 1) <= 0.03  # three deviations


def test_entry(spark):
    assert contract.entry(spark).count() > 0
