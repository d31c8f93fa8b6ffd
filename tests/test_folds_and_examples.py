"""Balanced folds, first rows of groups, representatives, missing values and type flags."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import evaluation, monitor, profile, text


@pytest.mark.parametrize("deal", [evaluation.DEAL, 60])
def test_balanced_folds_of_skewed_groups(spark, deal):
    """Groups from one row to a fifth of all, most of them of one class: shares differ from 1 / k by the largest group's at most."""
    rng = random.Random(3)
    rows = []
    for g in range(200):
        size, share = max(1, int(600 / (g + 1))), rng.choice([0.02, 0.1, 0.9])
        rows += [(f"g{g}", "yes" if rng.random() < share else "no") for _ in range(size)]
    rows += [(None, "no")] * 40 + [("odd", None)] * 3
    df = spark.createDataFrame(rows, "g string, y string").withColumn("id", F.monotonically_increasing_id())
    got = evaluation.balanced_folds(df, "g", "y", 5, deal).collect()
    again = {r.id: r.fold for r in evaluation.balanced_folds(df, "g", "y", 5, deal).collect()}
    assert len(got) == len(rows) and {r.id: r.fold for r in got} == again
    assert max(Counter(g for g, _ in {(r.g, r.fold) for r in got}).values()) == 1
    every, per = Counter(r.y for r in got), Counter((r.y, r.fold) for r in got)
    largest = Counter()
    for (y, _), n in Counter((r.y, r.g) for r in got).items():
        largest[y] = max(largest[y], n / every[y])
    for y in ("yes", "no"):
        assert all(abs(per[y, f] / every[y] - 0.2) <= largest[y] + (0.05 if deal < 100 else 0) for f in range(5))
    worst = lambda folds: max(abs(n / every[y] - 0.2) for (y, _), n in folds.items() if y)
    dealt = evaluation.grouped_stratified_folds(df.where("g is not null and y is not null").withColumn("pos", (F.col("y") == "yes").cast("int")), "g", "pos", 5).collect()
    assert worst(per) < worst(Counter((r.y, r.fold) for r in dealt))


def test_first_rows_leave_a_task_only_so_many(spark):
    d = spark.range(50_000).selectExpr("id", "if(id % 10 = 0, 'cold', 'hot') AS g", "id % 7 AS v").repartition(4)
    top = evaluation.first_rows(d, ["g"], [F.desc("v"), "id"], 3)
    plan = top._sc._jvm.PythonSQLUtils.explainString(top._jdf.queryExecution(), "formatted")
    assert "WindowGroupLimit" in plan
    assert sorted((r.g, r.rank, r.id) for r in top.collect()) == [("cold", 1, 20), ("cold", 2, 90), ("cold", 3, 160), ("hot", 1, 6), ("hot", 2, 13), ("hot", 3, 27)]


def test_errors_of_all_kinds(spark):
    rows = [(i, i % 2, int(i % 3 == 0), 1 if i % 9 == 0 else None) for i in range(100)]
    d = spark.createDataFrame(rows, "id int, label int, prediction int, other int")
    got = evaluation.error_examples(d, ["id"], 2).collect()
    assert sorted((r.bucket, r.rank, r.id) for r in got) == [("FN", 1, 1), ("FN", 2, 5), ("FP", 1, 0), ("FP", 2, 6), ("TP", 1, 3), ("TP", 2, 9)]
    fp = [r for r in rows if r[1] == 0 and r[2] == 1]
    share = evaluation.other_kind_share(d, ["other"]).first()
    assert (share.n, round(share.other_kind_share, 9)) == (len(fp), round(sum(r[3] == 1 for r in fp) / len(fp), 9))
    assert tuple(evaluation.other_kind_share(d.limit(0), ["other", "label"]).first()) == (0, None)


def test_representatives(spark):
    docs = spark.createDataFrame([(1, "a", "cat cat dog"), (2, "a", "cat"), (3, "a", "cat"), (4, "a", "mouse"), (5, "b", "cat"), (6, "b", None)], "k int, topic string, t string")
    words = spark.createDataFrame([("a", "cat", 0.5), ("a", "dog", 0.2), ("b", "dog", 1.0)], "topic string, term string, weight double")
    got = text.representatives(docs, "k", "topic", text.words(F.col("t")), words, 2).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 0.5, 1), ("a", 3, 0.5, 2)]


def test_missing_values_and_errors(spark):
    d = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    got = {r.column_name: tuple(r)[1:] for r in monitor.missing_values(d, d.limit(0), ["a", "b"]).collect()}
    assert got == {"a": (1, 1 / 3, 0, None), "b": (2, 2 / 3, 0, None)}
    e = spark.createDataFrame([("m", True, "x"), ("m", False, None), ("n", False, "x")], "model string, failed boolean, kind string")
    assert [tuple(r) for r in monitor.error_counts(e, ["model"], F.col("failed"), "kind").collect()] == [("m", "x", 1, 2, 0.5)]


def test_type_flags(spark):
    d = spark.createDataFrame([("INT",), ("decimal(3,1)",), ("bigint",), ("varchar(9)",)], "t string")
    flags = lambda strict, kinds: [tuple(r) for r in d.where("t <> 'INT'").select(*profile.one_hot("t", "t_", kinds, strict)).collect()]
    assert flags(False, profile.KEY_TYPES)[0] == (0, 0, 1, 0, 0, 0) and flags(False, profile.NF_TYPES) == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)]
    with pytest.raises(Exception, match="unknown type"):
        flags(True, ("bigint", *profile.NF_TYPES))


def test_classes_are_split_without_sorting_them_whole(spark):
    rows = [(i, "a" if i % 5 else None) for i in range(500)]
    got = text.stratified_split(spark.createDataFrame(rows, "id int, c string"), "c", ["id"]).groupBy("c", "split").count().collect()
    assert {(r.c, r.split): r["count"] for r in got} == {("a", "test"): 100, ("a", "train"): 300, (None, "test"): 25, (None, "train"): 75}
