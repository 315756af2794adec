"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert oracle.mismatch(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None


def test_compare_sees_a_wrong_value(spark, con):
    wrong = registry.oracle_sql()["rs_month_mean"].replace("avg(value)", "avg(value) + 0.00001")
    assert "rows differ" in oracle.mismatch(registry.queries()["rs_month_mean"](spark, SF), con, wrong)


def test_every_query_has_sql():
    beyond_sql = {"fc_published"}  # bootstrap of searched, iterated fits: tested by its parts
    assert set(registry.QUERIES) == set(registry.ORACLES) | beyond_sql


def test_published_chain_is_whole(spark):
    rows = registry.queries()["fc_published"](spark, SF).toPandas()
    sizes = rows.groupby(["target_id", "tipo"]).size()
    assert (sizes == 12).all() and set(rows["tipo"]) == {"Ridge", "Huber"}
    assert (rows["ic_inferior"] <= rows["ic_superior"]).all()


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 5
