"""Rolling reports over streams. What a track has seen is kept in a ledger's tables, each micro-batch is applied once, by DataFrame jobs:
events are numbered by prefix sums over time, and no task takes a track whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.monitor import due_windows, numbered
from tablewright.sources.ledger import Ledger, Put, View
from tablewright.sources.shared import ship

TAIL = "track string, n long, event_id long, value double"
REPORTS = "track string, report long, n long, first long, last long, mean_value double"


def _continued(batch: DataFrame, tail: DataFrame, columns: list[str]) -> DataFrame:
    """The tail's rows (old) and the batch's, numbered on from what the track had; and seen, the number that it had."""
    had = tail.groupBy(F.col("track").alias("_t")).agg(F.max("n").alias("seen"))
    new = numbered(batch, "track", "ts", ["event_id"]).drop("total").join(had, F.col("track").eqNullSafe(F.col("_t")), "left").drop("_t")
    new = new.withColumn("seen", F.coalesce("seen", F.lit(0).cast("long"))).withColumn("n", F.col("n") + F.col("seen"))
    old = tail.join(had, F.col("track").eqNullSafe(F.col("_t"))).drop("_t")
    return old.select("track", "n", *columns, "seen").unionByName(new.select("track", "n", *columns, "seen"))


def _with_total(latest: DataFrame) -> DataFrame:
    total = latest.groupBy(F.col("track").alias("_t")).agg(F.max("n").alias("total"))
    return latest.join(total, F.col("track").eqNullSafe(F.col("_t"))).drop("_t")


def report_step(batch: DataFrame, view: View, size: int, every: int) -> dict[str, Put]:
    """What a micro-batch of events (track, ts, event_id, value) adds to the reports, and the tail of each track after it. Within a
    micro-batch events are taken in the order of time."""
    latest = _with_total(view.written(_continued(batch, view.read("tail", TAIL), ["event_id", "value"])))
    due = due_windows(latest, size, every, after=F.col("seen"))
    made = due.groupBy("track", "report").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.avg("value").alias("mean_value"))
    return {"reports": Put(made, append=True), "tail": Put(latest.where(F.col("n") > F.col("total") - size).select("track", "n", "event_id", "value"))}


def rolling_reports(stream: DataFrame, ledger: Ledger, size: int = 60, every: int = 30) -> DataFrame:
    """For each track a report over the latest `size` events, at `size` events and after each `every` more: all that the stream has now,
    added to what the ledger has. stream: track, ts, event_id, value."""
    ledger.stream(stream, "rolling_reports", lambda batch, view: report_step(batch, view, size, every))
    return ledger.read("reports", REPORTS)


# --- reports that wait for both classes -------------------------------------------------------------------------------

LABELLED_TAIL = "track string, n long, event_id long, target int, prediction int"
DUE = "track string, due long, made long"
CLASS_REPORTS = "track string, report long, first long, last long, tp long, fp long, fn long, tn long"
#: Events of a block, the unit that a task looks at.
BLOCK = 10_000


def _fits(target: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of `size` targets that ends at each event holds both classes; events before a whole window have none."""
    ones = np.concatenate(([0], np.cumsum(target)))
    held = np.full(len(target), -1)
    held[size - 1 :] = ones[size:] - ones[:-size]
    return (held > 0) & (held < size)


def _next(fits: np.ndarray) -> np.ndarray:
    """For each place the first place from there on that fits; its length where there is none."""
    at = np.where(fits, np.arange(len(fits)), len(fits))
    return np.minimum.accumulate(at[::-1])[::-1]


def transfer(fits: np.ndarray, span: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block, for each place 0, ..., span at which a report may be due as the block begins: the place, counted from the block's end, at
    which the next one is due after it, and how many are made in it. A report that is still waiting is due at once."""
    n = len(fits)
    upcoming = _next(fits)
    due, made = np.zeros(n + span + 1, np.int64), np.zeros(n + span + 1, np.int64)
    due[n:] = np.arange(span + 1)
    for i in range(n - 1, -1, -1):
        j = upcoming[i]
        if j < n:
            after = j + every
            due[i], made[i] = (due[after], made[after] + 1) if after <= n + span else (after - n, 1)
    return due[: span + 1], made[: span + 1]


def class_report_step(batch: DataFrame, view: View, size: int, every: int, block: int = BLOCK) -> dict[str, Put]:
    """What a micro-batch of events (track, ts, event_id, target, prediction; 0 or 1) adds to the confusion reports.

    When a report is due depends on when the one before was made. So each block of a track's events first states, for every place at which
    one may be due as it begins, where the next is due as it ends; these are chained block by block, and then each block, knowing its
    first due place, makes its reports.
    """
    ship(batch.sparkSession)
    span = max(size, every)
    block = max(block, span)
    labelled = batch.where("target is not null and prediction is not null")
    latest = view.written(_continued(labelled, view.read("labelled_tail", LABELLED_TAIL), ["event_id", "target", "prediction"]))
    number = F.floor((F.col("n") - 1) / block)
    copies = latest.withColumn("block", F.explode(F.array_distinct(F.array(number, F.floor((F.col("n") + size - 2) / block)))))
    copies = copies.withColumn("inside", (F.col("block") == number) & (F.col("n") > F.col("seen")))

    def whole(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("n", ignore_index=True)
        places = np.flatnonzero(pdf["inside"])
        fits = _fits(pdf["target"].to_numpy(), size)
        return pdf, places, fits[places] & (pdf["n"].to_numpy()[places] >= size)

    def state(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, places, fits = whole(pdf)
        if not len(places):
            return pd.DataFrame(columns=["track", "block", "start", "length", "due", "made"])
        due, made = transfer(fits, span, every)
        return pd.DataFrame({"track": [key[0]], "block": [key[1]], "start": [int(pdf["n"][places[0]])], "length": [len(places)], "due": [due.tolist()], "made": [made.tolist()]})

    # a row for each block; blocks of a track are chained in one task
    states = view.written(copies.groupBy("track", "block").applyInPandas(state, "track string, block long, start long, length long, due array<long>, made array<long>"))

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", ignore_index=True)
        due, made, rows = int(pdf["first_due"][0]), int(pdf["had"][0]), []
        for b, start, length, to, more in pdf[["block", "start", "length", "due", "made"]].itertuples(index=False):
            rows.append((key[0], b, due, made, None, None))
            place = max(due - start, 0)
            due, made = start + length + int(to[place]), made + int(more[place])
        rows.append((key[0], -1, None, None, due, made))
        return pd.DataFrame(rows, columns=["track", "block", "due", "made", "next_due", "now"])

    before = view.read("due", DUE).select(F.col("track").alias("_t"), F.col("due").alias("first_due"), F.col("made").alias("had"))
    starts = states.join(before, F.col("track").eqNullSafe(F.col("_t")), "left").drop("_t").fillna({"first_due": size, "had": 0})
    chained = view.written(starts.groupBy("track").applyInPandas(chain, "track string, block long, due long, made long, next_due long, now long"))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, places, fits = whole(pdf)
        upcoming, out = _next(fits), []
        if len(places):
            n, ids, pairs = pdf["n"].to_numpy(), pdf["event_id"].to_numpy(), (2 * pdf["target"] + pdf["prediction"]).to_numpy()
            place, made = max(int(pdf["due"][0]) - int(n[places[0]]), 0), int(pdf["made"][0])
            while place < len(places) and upcoming[place] < len(places):
                at = places[upcoming[place]]
                window = slice(at + 1 - size, at + 1)
                out.append((key[0], made, ids[window].min(), ids[window].max(), *(int((pairs[window] == k).sum()) for k in (3, 1, 2, 0))))
                place, made = upcoming[place] + every, made + 1
        return pd.DataFrame(out, columns=["track", "report", "first", "last", "tp", "fp", "fn", "tn"])

    entries = chained.where("block >= 0").select(F.col("track").alias("_t"), F.col("block").alias("_b"), "due", "made")
    known = copies.join(entries, F.col("track").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")
    reports = known.groupBy("track", "block").applyInPandas(make, CLASS_REPORTS)
    due = chained.where("block < 0").select("track", F.col("next_due").alias("due"), F.col("now").alias("made"))
    kept = view.read("due", DUE).join(due.select(F.col("track").alias("_t")), F.col("track").eqNullSafe(F.col("_t")), "left_anti")
    tail = _with_total(latest).where(F.col("n") > F.col("total") - size).select("track", "n", "event_id", "target", "prediction")
    return {"class_reports": Put(reports, append=True), "due": Put(due.unionByName(kept)), "labelled_tail": Put(tail)}


def classification_reports(stream: DataFrame, ledger: Ledger, size: int = 60, every: int = 30, block: int = BLOCK) -> DataFrame:
    """Confusion counts of each track over its latest `size` labelled events, due at `size` events and after each `every` more.

    stream: track, ts, event_id, target, prediction (0 or 1); events that lack one of the two are passed over. A report that is due
    while the window's targets are of one class waits for the next event, and the count to the following report starts when it is made.
    """
    ledger.stream(stream, "classification_reports", lambda batch, view: class_report_step(batch, view, size, every, block))
    return ledger.read("class_reports", CLASS_REPORTS)
