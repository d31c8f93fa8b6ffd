"""Empty tables and samples, and values of any length."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.operators import atomicity, evaluation, monitor, profile, quality, text
from tablewright.sources.tables import discover_columns

EVENTS = "event_id long, ts timestamp, track string, value double"


@pytest.mark.parametrize("sides", ["reference", "current", "both"])
def test_drift_of_empty_samples(spark, sides):
    full = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None)], "v double, k string")
    none = full.limit(0)
    r, c = (none if sides in ("reference", "both") else full), (none if sides in ("current", "both") else full)
    assert monitor.ks_distance(r, c, "v").first().ks is None
    assert monitor.wasserstein(r, c, "v").first().wasserstein is None
    assert monitor.js_distance(r, c, "k").first().js is None
    assert monitor.chi_square(r, c, "k").first().chi_square is None
    assert monitor.ks_distance(full, full, "v").first().ks == 0.0 and monitor.js_distance(full, full, "k").first().js == 0.0


def test_drift_summary_of_nothing(spark):
    d = spark.createDataFrame([], "column string, distance double")
    assert tuple(monitor.drift_summary(d, 0.1).first()) == (0, None)
    d = spark.createDataFrame([("a", 0.2), ("b", 0.05), ("c", None)], "column string, distance double")
    assert tuple(monitor.drift_summary(d, 0.1).first()) == (1, 0.5)


def test_windows_of_no_events(spark):
    e = spark.createDataFrame([], EVENTS)
    assert monitor.share_alert(e, "ts", F.col("value") > 1, 0.5, "1 hour", "1 hour").count() == 0
    assert monitor.latency_quantiles(e, "ts", "value", "1 hour", 0.5).count() == 0
    assert monitor.silent_windows(e, "ts", "1 hour").count() == 0
    assert monitor.target_down(e, "ts", "1 hour", ["track"]).count() == 0
    assert monitor.rolling_report(e, "track", ["ts", "event_id"]).count() == 0
    assert monitor.stratified_sample(e, "track", 10, ["event_id"]).count() == 0
    assert monitor.histogram(e, "value", [1.0, 2.0]).count() == 0


def test_metrics_of_nothing(spark):
    d = spark.createDataFrame([], "track string, label int, prediction int, score double")
    assert evaluation.binary_metrics(d, ("track",), "label", "prediction", "score").count() == 0
    assert evaluation.class_weights(d, "label").count() == 0
    assert quality.schema_check(d, ["track"], []).count() == 3
    assert text.tf_idf(spark.createDataFrame([], "k long, t string"), "k", text.words(F.col("t"))).count() == 0


def test_profile_of_an_empty_table(spark):
    tables = {"t": spark.createDataFrame([], "a int")}
    (row,) = profile.column_stats(discover_columns(spark, tables), tables).collect()
    assert row.number_unique_values == 0 and row.is_unique == 1 and row.null_ratio == 0.0


def test_long_lists(spark):
    rng = random.Random(1)
    values = ["a," * 100_000 + "a", "a, " * 100_000 + "b" * 40, "a, " * 100_000 + "b" * 42, "x" * 1_000_000, "a,b." * 2000, "," * 1000]
    values += ["".join(rng.choice("ab ,;|.") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    values += [",".join("y" * rng.choice([1, 5, 39, 40, 41]) if rng.random() < 0.5 else " " + "z" * rng.choice([0, 40, 41]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    fits = lambda v: bool(re.fullmatch(atomicity.LIST_LIKE[1:-1], v)) if len(v) < 2000 else None
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", atomicity.is_list_like(F.col("v")).alias("got"))
    got = [r.got for r in df.collect()]
    assert got[:6] == [True, True, False, False, False, False]
    assert all(g == fits(v) for g, v in zip(got[5:], values[5:], strict=True))
    short = [r.got for r in spark.createDataFrame([(v,) for v in values[5:]], "v string").select(_by_part(F.col("v")).alias("got")).collect()]
    assert short == got[5:]


def _by_part(v):
    """The judgement of long values, of short ones too."""
    before, atomicity.LONG = atomicity.LONG, -1
    try:
        return atomicity.is_list_like(v)
    finally:
        atomicity.LONG = before
