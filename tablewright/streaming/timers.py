"""What happens when nothing happens: claims that are never completed are released, and silent tracks reported, by timers of keyed state."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tablewright.sources.ledger import Ledger, Put
from tablewright.sources.tables import REF

# The process that sets up keyed state on the driver doesn't see files that were added to the session: the processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASES = "database string, schema string, table_name string, track string, run string, claimed_at timestamp, due_at timestamp"
SILENCES = "track string, last_ms long, due_ms long"


class ClaimTimeout(StatefulProcessor):
    """Keyed by table and track: the run that holds it and since when, and a timer for the end of its time."""

    def __init__(self, minutes: float) -> None:
        self.span = round(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "run string, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, touched = (self.held.get() if self.held.exists() else None), False
        for r in sorted(rows, key=lambda r: (r.at, r.kind != "claim", r.run)):  # the few steps of one table
            if r.kind == "claim" and held is None:
                held, touched = (r.run, r.at), True
            elif r.kind in ("complete", "release") and held is not None and held[0] == r.run:
                held, touched = None, True
        if touched:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if held is None:
                self.held.clear()
            else:
                self.held.update(tuple(held))
                self.handle.registerTimer(held[1] + self.span)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            run, at = self.held.get()
            self.held.clear()
            yield Row(database=key[0], schema=key[1], table_name=key[2], track=key[3], run=run, claimed_ms=at, due_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Keyed by track: when it was last heard of, and a timer for the end of the time in which it must be heard of again."""

    def __init__(self, milliseconds: int) -> None:
        self.span = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = max(r.last_ms for r in rows)
        if not self.last.exists() or self.last.get()[0] < now:
            self.last.update((now,))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now + self.span)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            yield Row(track=key[0], last_ms=self.last.get()[0], due_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def stale_claims(steps: DataFrame, minutes: float = 120) -> DataFrame:
    """A stream of the claims that are released, each when its time is over, though nothing else arrives.

    steps: a stream of REF, track, run, kind (claim, complete, release) and at. A claim of what is held already is none; a run completes
    or releases only what it holds. Time is that of the cluster's clocks. In state: the open claims, a row for each.
    """
    s = steps.where("at is not null").select(*REF, "track", "run", "kind", F.unix_millis(F.col("at").cast("timestamp")).alias("at"))
    out = "database string, schema string, table_name string, track string, run string, claimed_ms long, due_ms long"
    d = s.groupBy(*REF, "track").transformWithState(ClaimTimeout(minutes), out, "append", "processingTime")
    return d.select(*REF, "track", "run", F.timestamp_millis("claimed_ms").alias("claimed_at"), F.timestamp_millis("due_ms").alias("due_at"))


def latest_of_batches(events: DataFrame) -> DataFrame:
    """track, last_ms: of each Arrow batch one row a track, so that a hot track sends few rows to its state. Null tracks and times go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby("track", as_index=False)["last_ms"].max()

    e = events.where("track is not null and ts is not null").select("track", F.unix_millis(F.col("ts").cast("timestamp")).alias("last_ms"))
    return e.mapInPandas(run, "track string, last_ms long")


def silent_tracks(events: DataFrame, seconds: float) -> DataFrame:
    """A stream of silences: for a track whose last event (track, ts) is longer ago than that, one row when the time is over, though nothing
    arrives. The next event ends the silence. In state: a row for each track."""
    d = latest_of_batches(events).groupBy("track").transformWithState(Silence(round(seconds * 1000)), SILENCES, "append", "processingTime")
    return d.select("track", F.timestamp_millis("last_ms").alias("last_seen"), F.timestamp_millis("due_ms").alias("due_at"))


def start(stream: DataFrame, ledger: Ledger, name: str, every: str = "1 second") -> StreamingQuery:
    """Add a stream's rows to the ledger's table of that name, each micro-batch once, in the given rhythm: micro-batches run for the timers'
    sake where nothing arrives. Timers need state in RocksDB, which is asked for while the query starts."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)

    def add(rows: DataFrame, n: int) -> None:
        ledger.once(name, n, lambda view: {} if (kept := view.written(rows)).isEmpty() else {name: Put(kept, append=True)})

    try:
        return stream.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{ledger.path}/checkpoint-{name}").trigger(processingTime=every).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_overdue(stream: DataFrame, ledger: Ledger, name: str) -> None:
    """Take all that the stream has now, and stop once a micro-batch ran in which nothing arrived: timers that are due have fired by then."""
    q = start(stream, ledger, name, every="0 seconds")
    try:
        while q.isActive and not any(p["numInputRows"] == 0 and p["batchId"] > 0 for p in q.recentProgress):
            time.sleep(0.1)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
