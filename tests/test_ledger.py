"""Batches that come again, crashes between two writes, writers that meet, and streams over a ledger."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import monitor
from tablewright.sources.ledger import ConflictError, Ledger, Put
from tablewright.streaming import feeds, reports
from tests.test_catalog import due_reports


def add(n):
    return lambda view: {"sums": Put(view.read("sums", "x long").agg((F.coalesce(F.sum("x"), F.lit(0)) + n).alias("x")))}


def total(ledger):
    return [r.x for r in ledger.read("sums", "x long").collect()]


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.once("a", 0, add(1)) and not ledger.once("a", 0, add(1)) and ledger.once("b", 0, add(10)) and ledger.once("a", 5, add(100))
    assert not Ledger(spark, str(tmp_path)).once("a", 4, add(1)) and total(ledger) == [111]
    assert ledger.view().batches == {"a": 5, "b": 0}


@pytest.mark.parametrize("where", ["work", "rows", "commit", "after"])
def test_crashes(spark, tmp_path, monkeypatch, where):
    """A crash in the work, between two tables' rows, before the commit, or after it and before the stream knows."""
    spark.range(3).write.parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    broken = {"now": True}

    def fail(at):
        if broken["now"] and where == at:
            broken["now"] = False
            raise OSError("crash")

    def work(batch, view):
        fail("work")
        return {"sums": Put(view.read("sums", "x long").unionByName(batch.select(F.col("id").alias("x"))).agg(F.sum("x").alias("x"))), "log": Put(batch, append=True)}

    commit, once = Ledger._commit, Ledger.once
    monkeypatch.setattr(Ledger, "_commit", lambda self, view: (fail("commit"), commit(self, view))[1])
    monkeypatch.setattr(Ledger, "once", lambda self, *a: (once(self, *a), fail("after"))[0])
    if where == "rows":
        real = Put.__init__
        monkeypatch.setattr(Put, "__init__", lambda self, rows, append=False: (real(self, rows, append), fail("rows") if append else None)[0])
    with pytest.raises(Exception, match="crash"):
        ledger.stream(stream, "s", work)
    for k in range(2):
        Ledger(spark, ledger.path).stream(stream, "s", work)
        assert total(ledger) == [3 + 12 * k] and ledger.read("log", "id long").count() == 3 + 3 * k
        spark.range(3, 6).write.mode("append").parquet(str(tmp_path / "in"))
    assert ledger.vacuum(1) > 0 and ledger.vacuum(1) == 0 and total(ledger) == [15]


def test_writers_that_meet(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    met = []

    def work(view):
        if not met:  # the other commits in between, once
            met.append(other.once("other", 0, add(1000)))
        return add(1)(view)

    assert ledger.once("mine", 0, work) and met == [True] and total(ledger) == [1001]
    tries = iter(range(100))
    with pytest.raises(ConflictError):
        ledger.once("mine", 1, lambda view: (other.once("other", 1 + next(tries), add(0)), add(1)(view))[1])
    assert total(ledger) == [1001]


def test_notifications_and_what_was_seen_are_one(spark, tmp_path, monkeypatch):
    spark.range(1).write.parquet(str(tmp_path / "notes"))
    notes = spark.readStream.schema("id long").parquet(str(tmp_path / "notes"))
    ledger, rows = Ledger(spark, str(tmp_path / "ledger")), {"n": 5}
    snapshot = lambda: spark.createDataFrame([("d", "s", "t", rows["n"], 2)], feeds.SEEN)
    commit, crash = Ledger._commit, [True]

    def crashing(self, view):
        if crash:
            crash.pop()
            raise OSError("crash")
        return commit(self, view)

    monkeypatch.setattr(Ledger, "_commit", crashing)
    with pytest.raises(Exception, match="crash"):
        feeds.recorded_notifications(notes, ledger, snapshot, "ingest")
    pending = lambda: [r.change_type for r in ledger.read("pending", "change_type string").orderBy("detected_at").collect()]
    rows["n"] = 7  # the tables have moved on before the batch comes again
    feeds.recorded_notifications(notes, ledger, snapshot, "ingest")
    assert pending() == ["new_table"] and ledger.read("seen", feeds.SEEN).first().row_count == 7
    for n, want in ((7, 1), (9, 2)):
        rows["n"] = n
        spark.range(1).write.mode("append").parquet(str(tmp_path / "notes"))
        feeds.recorded_notifications(notes, ledger, snapshot, "ingest")
        assert len(pending()) == want
    assert pending() == ["new_table", "row_count_changed"]


def test_rolling_reports_over_micro_batches(spark, tmp_path):
    rng = random.Random(2)
    ledger, seen = Ledger(spark, str(tmp_path / "ledger")), []
    for k, n in enumerate((3, 25, 60)):
        part = [(rng.choice(["hot", "hot", "hot", "cold", None]), 1000 * k + i, float(rng.randrange(50))) for i in range(n)]
        seen += part
        df = spark.createDataFrame(part, "track string, event_id long, value double").withColumn("ts", (F.col("event_id") * 700).cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        got = reports.rolling_reports(stream, ledger, 10, 4).collect()
        want = []
        for track in ("hot", "cold", None):
            e = [x for x in seen if x[0] == track]
            for r, at in enumerate(range(10, len(e) + 1, 4)):
                w = e[at - 10 : at]
                want.append((track, r, 10, w[0][1], w[-1][1], sum(v for *_, v in w) / 10))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(want) > 9


@pytest.mark.parametrize("block", [17, reports.BLOCK])
def test_class_reports_over_micro_batches_and_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    ledger, seen, last = Ledger(spark, str(tmp_path / "ledger")), [], 0
    for k, n in enumerate((30, 7, 90)):
        part = [(rng.choice(["a", "a", "b"]), 1000 * k + i, rng.choice([None, 1, 1, 0]) if (i // 25) % 2 else 0, rng.choice([0, 1, 1, None])) for i in range(n)]
        seen += part
        df = spark.createDataFrame(part, "track string, event_id long, target int, prediction int").withColumn("ts", F.col("event_id").cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        got = reports.classification_reports(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ledger, 10, 5, block).collect()
        for track in "ab":
            want = due_reports([(i, t, p) for c, i, t, p in seen if c == track and t is not None and p is not None], 10, 5)
            mine = sorted((r for r in got if r.track == track), key=lambda r: r.report)
            assert [tuple(r)[2:] for r in mine] == want and [r.report for r in mine] == list(range(len(want)))
        last = len(got)
    assert last > 4


def test_numbers_without_a_task_for_a_track(spark):
    rows = [(k, "hot" if k % 10 else None, None if k % 40 == 0 else k * 997 % 5000) for k in range(600)]
    df = spark.createDataFrame(rows, "event_id long, track string, at long").withColumn("ts", F.col("at").cast("timestamp"))
    got = {r.event_id: (r.n, r.total) for r in monitor.numbered(df, "track", "ts", ["event_id"], seconds=60).collect()}
    for track in ("hot", None):
        order = sorted((r for r in rows if r[1] == track), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in order] == [(i, len(order)) for i in range(1, len(order) + 1)]


def exact(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))


def test_quantiles(spark):
    rng = random.Random(9)
    rows = [(g, h, v) for g, n in (("a", 1), ("b", 2), ("c", 3000)) for h in range(3) for v in ([rng.lognormvariate(0, 3) * rng.choice([1, 1, 1, -1]) for _ in range(n)])]
    rows += [("c", 0, 0.0)] * 40 + [("d", 0, None), ("e", 1, 7.5)] + [("f", 0, 1.0)] * 1000
    df = spark.createDataFrame(rows, "g string, h int, v double")
    values = {g: [v for k, _, v in rows if k == g and v is not None] for g in "abcdef"}
    ps = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    got = {r.g: r for r in monitor.exact_quantiles(df, "v", ps, ["g"]).collect()}
    assert set(got) == set("abcef")
    for g, r in got.items():
        assert all(abs(r[f"p{p * 100:g}"] - exact(values[g], p)) < 1e-9 for p in ps)
    fine = monitor.quantile_sketch(df, "v", ["g", "h"], 0.01)
    merged = monitor.merge_sketches(fine, ["g"])
    whole = monitor.quantile_sketch(df, "v", ["g"], 0.01)
    key = lambda d: sorted((r.g, r.sign, r.number, r.n, round(r.total, 6)) for r in d.collect())
    assert key(merged) == key(whole) and fine.count() < 6500
    for r in monitor.sketch_quantiles(merged, ps, ["g"], 0.01).collect():
        v = sorted(values[r.g])
        assert r.n == len(v) and abs(r["mean"] - sum(v) / len(v)) < 1e-6
        for p in ps:
            at = v[int(p * (len(v) - 1))]
            assert abs(r[f"p{p * 100:g}"] - at) <= 0.010001 * abs(at)


def test_samples_without_a_sorted_class(spark):
    rows = [(k, "big" if k % 50 else "small", k % 7) for k in range(4000)] + [(1, "same", 0)] * 300
    df = spark.createDataFrame(rows, "k long, target string, x int")
    quota = spark.createDataFrame([("big", 3920, 50), ("small", 80, 80), ("same", 300, 7), ("gone", 5, 5)], "target string, _n long, _quota long")
    got = monitor.lowest_hashes(df, "target", ["k"], quota).groupBy("target").count().collect()
    assert {r.target: r["count"] for r in got} == {"big": 50, "small": 80, "same": 7}
