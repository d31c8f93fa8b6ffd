"""Timers: stale claims and silence, with no event arriving, against the batch answers."""

import datetime
import time

from pyspark.sql import functions as F

from tablewright.operators import changefeed
from tablewright.sources.ledger import Ledger
from tablewright.streaming import timers

STEPS = "database string, schema string, table_name string, track string, run string, kind string, at timestamp"


def wait_for(ready, seconds=60):
    end = time.monotonic() + seconds
    while not ready() and time.monotonic() < end:
        time.sleep(0.5)


def test_stale_claims_are_released_by_a_timer(spark, tmp_path):
    now = datetime.datetime.now(datetime.timezone.utc)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    step = lambda t, run, kind, at, track="nf": ("d", "s", t, track, run, kind, at)
    rows = [
        step("old", "r1", "claim", ago(500)), step("done", "r1", "claim", ago(500)), step("done", "r1", "complete", ago(400)), step("other", "r1", "claim", ago(500)), step("other", "r9", "complete", ago(300)),
        step("again", "r1", "claim", ago(500)), step("again", "r1", "release", ago(450)), step("again", "r2", "claim", ago(90)), step("held", "r1", "claim", ago(500)), step("held", "r2", "claim", ago(1)),
        step("soon", "r1", "claim", ago(-4)), step("late", "r1", "claim", ago(-3000)), step("old", "r1", "claim", ago(-3000), "keys"), step("nothing", "r1", "complete", ago(500)),
    ]
    spark.createDataFrame(rows, STEPS).write.parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream = spark.readStream.schema(STEPS).parquet(str(tmp_path / "in"))
    released = lambda: {(r.table_name, r.track, r.run) for r in ledger.read("released", timers.RELEASES).collect()}
    q = timers.start(timers.stale_claims(stream, minutes=0.1), ledger, "released")
    try:
        wait_for(lambda: len(released()) >= 5)  # nothing arrives after the first micro-batch
        assert q.exception() is None
    finally:
        q.stop()
    pending = [("d", "s", t, run, at, done) for t, run, at, done in [
        ("old", "r1", ago(500), None), ("done", "r1", ago(500), ago(400)), ("other", "r1", ago(500), None), ("again", "r2", ago(90), None), ("held", "r1", ago(500), None), ("soon", "r1", ago(-4), None), ("late", "r1", ago(-3000), None)]]
    table = spark.createDataFrame(pending, "database string, schema string, table_name string, nf_claimed_by string, nf_claimed_at timestamp, nf_completed_at timestamp")
    batch = changefeed.release_stale(table, F.lit(now + datetime.timedelta(seconds=65)), 1, ["nf"]).where("nf_claimed_by is null and nf_completed_at is null")
    assert {t for t, *_ in released()} == {r.table_name for r in batch.collect()} == {"old", "other", "again", "held", "soon"}
    assert {x for x in released() if x[0] in ("again", "held")} == {("again", "nf", "r2"), ("held", "nf", "r1")}


def test_silence_is_reported_by_a_timer(spark, tmp_path):
    now = datetime.datetime.now(datetime.timezone.utc)
    at = lambda s: now + datetime.timedelta(seconds=s)
    schema = "track string, ts timestamp"
    spark.createDataFrame([("a", at(-50)), ("a", at(-30)), ("b", at(4)), ("c", at(5000)), ("a", None), (None, at(0))], schema).repartition(1).write.parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = lambda: sorted((r.track, r.last_seen.timestamp()) for r in ledger.read("silent", "track string, last_seen timestamp, due_at timestamp").collect())
    q = timers.start(timers.silent_tracks(stream, 3), ledger, "silent")
    try:
        wait_for(lambda: len(got()) >= 2)
        assert [t for t, _ in got()] == ["a", "b"]
        spark.createDataFrame([("a", at(20))], schema).write.mode("append").parquet(str(tmp_path / "in"))  # heard of again, and silent again
        wait_for(lambda: len(got()) >= 3)
        assert q.exception() is None
    finally:
        q.stop()
    assert [(t, round(s - now.timestamp())) for t, s in got()] == [("a", -30), ("a", 20), ("b", 4)]
