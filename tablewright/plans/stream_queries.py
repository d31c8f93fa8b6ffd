"""Queries of streams that keep state: batches applied once, timers, and sketches that are merged upwards. All read events whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import monitor
from tablewright.sources.ledger import Put, View, new_ledger
from tablewright.streaming import feeds, timers

TOTALS = "event_type string, n long, total double"
ERROR = 0.01


def exactly_once_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each event type from four batches, each of which is delivered twice, the second time after the next one."""
    events, ledger = spark.read.parquet(f"{sf_dir}/events.parquet"), new_ledger(spark)

    def deliver(batch: int) -> None:
        def work(view: View) -> dict[str, Put]:
            new = events.where(F.pmod("event_id", F.lit(4)) == batch).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            return {"totals": Put(view.read("totals", TOTALS).unionByName(new).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))}

        ledger.once("events", batch, work)

    for batch in (0, 1, 0, 2, 1, 3, 2, 3):
        deliver(batch)
    return ledger.read("totals", TOTALS).withColumn("total", F.round("total", 4))


def timed_out_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that timers release, from a stream of steps: users' events claim 40 tables, complete or release them."""
    e = feeds.event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("purchase", "error"), "complete").when(F.col("event_id") % 7 == 0, "release").otherwise("claim")
    steps = e.select(F.lit("lake").alias("database"), F.lit("star").alias("schema"), F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("table_name"), F.lit("nf").alias("track"), F.lit("r").alias("run"), kind.alias("kind"), F.col("ts").alias("at"))
    ledger = new_ledger(spark)
    timers.run_overdue(timers.stale_claims(steps, 120), ledger, "released")
    out = ledger.read("released", timers.RELEASES)
    return out.select("table_name", "run", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("claimed_at", "due_at")))


def timed_out_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that have been silent for 15 minutes, reported by timers: all of them, as the events are of the past."""
    ledger = new_ledger(spark)
    timers.run_overdue(timers.silent_tracks(feeds.event_stream(spark, sf_dir).select(F.col("event_type").alias("track"), "ts"), 900), ledger, "silent")
    out = ledger.read("silent", "track string, last_seen timestamp, due_at timestamp")
    return out.select("track", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "due_at")))


def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each day and event type from sketches of each hour, merged; within 1 % of the values at their ranks."""
    e = monitor.windows(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour")
    hours = monitor.quantile_sketch(e, "value", ["window_start", "event_type"], ERROR)
    days = monitor.merge_sketches(hours.withColumn("day", F.date_trunc("day", "window_start").cast("timestamp_ntz")), ["day", "event_type"])
    q = monitor.sketch_quantiles(days, (0.5, 0.95, 0.99), ["day", "event_type"], ERROR)
    return q.select("day", "event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


QUERIES = {f.__name__: f for f in (exactly_once_totals, timed_out_claims, timed_out_tracks, latency_sketches)}

_GAMMA = f"((1 + {ERROR}::DOUBLE) / (1 - {ERROR}::DOUBLE))"
_AT = lambda p: f"round(min_by(middle, upto) FILTER (upto >= floor({p}::DOUBLE * (total_n - 1)) + 1), 6)"

ORACLE_SQL = {
    "exactly_once_totals": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "timed_out_claims": """
        WITH s AS (SELECT 't' || CAST(user_id % 40 AS VARCHAR) AS table_name, date_trunc('milliseconds', ts) AS m,
                   CASE WHEN event_type IN ('purchase', 'error') THEN 'complete' WHEN event_id % 7 = 0 THEN 'release' ELSE 'claim' END AS kind FROM events),
        l AS (SELECT table_name, max(m) AS m FROM s WHERE kind <> 'claim' GROUP BY 1)
        SELECT s.table_name, 'r' AS run, min(s.m) AS claimed_at, min(s.m) + INTERVAL 120 MINUTE AS due_at
        FROM s LEFT JOIN l ON l.table_name = s.table_name WHERE s.kind = 'claim' AND (l.m IS NULL OR s.m > l.m) GROUP BY 1""",
    "timed_out_tracks": "SELECT event_type AS track, max(date_trunc('milliseconds', ts)) AS last_seen, max(date_trunc('milliseconds', ts)) + INTERVAL 900 SECOND AS due_at FROM events GROUP BY 1",
    "latency_sketches": f"""
        WITH b AS (SELECT date_trunc('day', ts) AS day, event_type, value, CAST(sign(value) AS INT) AS sign, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / ln({_GAMMA})) END AS number FROM events WHERE value IS NOT NULL),
        s AS (SELECT day, event_type, sign, number, count(*) AS n, sum(value) AS total, CASE WHEN sign = 0 THEN 0.0::DOUBLE ELSE sign * 2 * pow({_GAMMA}, number) / ({_GAMMA} + 1) END AS middle FROM b GROUP BY 1, 2, 3, 4),
        u AS (SELECT *, sum(n) OVER (PARTITION BY day, event_type ORDER BY sign, sign * number) AS upto, sum(n) OVER (PARTITION BY day, event_type) AS total_n FROM s)
        SELECT day, event_type, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS mean, {_AT(0.5)} AS p50, {_AT(0.95)} AS p95, {_AT(0.99)} AS p99 FROM u GROUP BY 1, 2""",
}
