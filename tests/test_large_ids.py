"""Cluster ids beyond the key multiplier."""

import duckdb
import pytest

import __spark_entry__ as entry
from pairscreen.functions.numbers import KEY_MULTIPLIER


@pytest.mark.parametrize("name", ["interaction_keys", "largest_cluster"])
def test_ids_beyond_the_multiplier(spark, tmp_path, name):
    path = f"{tmp_path}/lineitem.parquet"
    rows = [(1, 1, 5.0, 9.0, "A", KEY_MULTIPLIER + 7, 3), (1, 2, 5.0, 9.0, "N", 7, 4), (2, 1, 5.0, 9.0, "R", 9 * KEY_MULTIPLIER, 4)]
    names = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(rows, f"{names}, l_partkey long, l_suppkey long").write.parquet(path)
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
