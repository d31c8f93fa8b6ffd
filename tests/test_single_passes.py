"""Texts and scans are taken once: few shuffles, and the same results."""

import math

from pyspark.sql import functions as F

from tablewright.operators import scope, text

ROWS = [(1, "x", "a a b"), (2, "x", "b c"), (2, "x", "c c a"), (3, "y", "a d d"), (4, "y", "zz"), (5, None, "a b"), (None, "y", "d"), (6, "y", None)]


def _docs(spark):
    return spark.createDataFrame(ROWS, "k int, topic string, body string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tf_idf_shuffles_texts_alone(spark):
    got = text.tf_idf(_docs(spark), "k", text.words(F.col("body")), min_df=2)
    plan = _plan(got)
    assert plan.count("Exchange hashpartitioning(k#") == 1 and "Exchange hashpartitioning(term#" not in plan
    counts = {}
    for k, _, body in ROWS:
        for w in (body or "").split():
            counts[k, w] = counts.get((k, w), 0) + 1
    df = {w: sum(1 for _, v in counts if v == w) for _, w in counts}
    raw = {(k, w): (1 + math.log(n)) * (math.log((1 + len(ROWS)) / (1 + df[w])) + 1) for (k, w), n in counts.items() if df[w] >= 2}
    norm = {k: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == k)) for k, _ in raw}
    assert {(r.k, r.term): round(r.weight, 9) for r in got.collect()} == {x: round(v / norm[x[0]], 9) for x, v in raw.items()}


def test_representatives_take_texts_once(spark):
    keywords = spark.createDataFrame([("x", "a", 0.5), ("x", "c", 0.25), ("y", "d", 1.0)], "topic string, term string, weight double")
    got = text.representatives(_docs(spark), "k", "topic", text.words(F.col("body")), keywords)
    assert _plan(got).split("Initial Plan")[0].count("Generate explode") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, 0.333333333, 1), ("x", 2, 0.25, 2), ("y", 3, 0.666666667, 1)]


def test_widths_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(d, "s", t, "customer_id", int(t == "customer")) for d in ("d1", "d2") for t in ("customer", "orders")]
    schema = "database string, schema string, table_name string, column_name string, is_unique int"
    df = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    got = scope.scope_augmented_variants(df).collect()
    assert seen.value == len(rows) and len(got) == 3 * len(rows)
