import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", ["fds_customer_nation", "claim_cycle", "error_examples", "latency_sketches", "soft_vote", "rolling_window", "ctfidf_topics", "dq_consistency"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)
