"""Searches for keys and dependencies see every row of tables of any size."""

import os

import duckdb
import pytest

import __spark_entry__
from tablewright.operators import combos, dependencies, features

SF = "/root/testdata/sf0.01"


def test_one_row_in_many_counts(spark):
    """One row repeats a pair, one breaks a dependency of one column and one of two, among 24,003 rows."""
    d = spark.range(24_003).selectExpr("id % 155 as a", "id div 155 as b", "id % 155 % 31 + if(id = 7, 100, 0) as c", "pmod(id % 155 + id div 155, 5) + if(id = 11, 100, 0) as e")
    d = d.union(spark.sql("select 3L, 0L, 3L, 3L")).repartition(3)
    stats, pairs, rows = dependencies.table_statistics(d, "t")
    assert rows == 24_004
    assert [r["cols"] for r in dependencies.find_uccs(stats, pairs, lambda c: combos.combo_distinct(d, c, "t")).collect()] == []
    near = {tuple(r["cols"]) for r in dependencies.find_near_uccs(stats, pairs).collect()}
    assert near == {("a", "b")}
    assert ("a", "c") not in {(r.lhs, r.rhs) for r in dependencies.find_dependencies(stats, pairs).collect()}
    assert ("a", "c") in {(r.lhs, r.rhs) for r in dependencies.find_near_dependencies(stats, pairs).collect()}
    assert features.build_features(d, "t").select("table_sampled", "table_candidate_key_count", "table_near_ucc_count").distinct().collect() == [(0, 0, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_queries_equal_their_sql_on_repeated_tables(spark, tmp_path):
    """Copies of the given customers and orders with shifted keys, more rows than samples were once drawn above; amounts of copies differ, so a column is nearly unique."""
    db = duckdb.connect()
    customer = "c_custkey + k * 1500 AS c_custkey, c_acctbal + k * 20000 AS c_acctbal"
    orders = "o_orderkey + k * 15000 AS o_orderkey, o_custkey + k * 1500 AS o_custkey"
    for table, copies, new in (("customer", 18, customer), ("orders", 2, orders), ("nation", 1, "n_nationkey AS n_nationkey")):
        db.execute(f"COPY (SELECT * EXCLUDE (k) FROM (SELECT * REPLACE ({new}) FROM '{SF}/{table}.parquet', range({copies}) AS r(k))) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    rounded = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    for name in ("uccs_orders", "near_fds", "near_keys", "normal_form_features"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert rounded(got.collect()) == rounded(want), name
