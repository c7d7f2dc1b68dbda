"""Every registered query against its SQL, and its plan against a few rules."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from pairscreen.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries())
    assert all_queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["topk_self", "topk_union", "best_host", "pair_inventory", "hard_negatives", "first_valid_rank"])
def test_no_cross_join_in_plan(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
