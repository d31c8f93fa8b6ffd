"""Drift, quality and alert windows over prediction events, in batch; streaming/ has the same over streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.evaluation import binary_metrics
from tablewright.operators.ranked import running_sums


def md5_percent(columns: Sequence[str]) -> Column:
    """The MD5 of the values joined by '|' as a 128-bit number, modulo 100: from its halves, as 2**64 mod 100 is 16."""
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % 100
    return ((half(1) * 16 + half(17)) % 100).cast("int")


def hash_split(df: DataFrame, columns: Sequence[str], percent: int) -> DataFrame:
    """reference or holdout, from the row's identity alone."""
    return df.withColumn("bucket", md5_percent(columns)).withColumn("split", F.when(F.col("bucket") < percent, "reference").otherwise("holdout"))


def lowest_hashes(df: DataFrame, by: str, identity: Sequence[str], quota: DataFrame) -> DataFrame:
    """Of each group the quota of rows whose identity has the lowest hash.

    quota: by, _n (rows of the group), _quota. Rows above a hash that leaves a margin over the quota (six deviations) are dropped where they
    are; only the others are ranked, so that no task sorts a whole group. Where a group's hashes are so uneven that too few are left, as with
    rows that repeat an identity, the group is ranked whole.
    """
    place = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in identity)).cast("binary"))
    share = (F.col("_quota") + 6 * F.sqrt(F.col("_quota").cast("double")) + 6) / F.col("_n")
    d = df.join(quota.select(by, "_quota", share.alias("_share")), by).withColumn("_place", place)
    low = d.where(F.conv(F.substring("_place", 1, 8), 16, 10).cast("double") < F.col("_share") * 2.0**32)
    enough = low.groupBy(by).agg(F.count("*").alias("_left"))
    short = quota.join(enough, by, "left").where(F.coalesce("_left", F.lit(0)) < F.least("_quota", "_n")).select(by)
    kept = low.join(short, by, "left_anti").unionByName(d.join(short, by, "left_semi"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_place")))
    return ranked.where("_rank <= _quota").drop("_quota", "_share", "_place", "_rank")


def stratified_sample(df: DataFrame, target: str, limit: int, identity: Sequence[str]) -> DataFrame:
    """Of each class max(1, round(n * limit / N)) rows, halves to even, picked by a hash of their identity."""
    n = df.groupBy(target).agg(F.count("*").alias("_n"))
    n = n.withColumn("_quota", F.greatest(F.lit(1), F.bround(F.col("_n") * limit / F.sum("_n").over(Window.partitionBy()))).cast("long"))
    return lowest_hashes(df, target, identity, n)


def _both(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Of each value how often the reference (r) and the current sample (c) have it, with running sums."""
    one = lambda d, k: d.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias(k))
    d = one(reference, "r").withColumn("c", F.lit(0)).unionByName(one(current, "c").withColumn("r", F.lit(0)))
    return running_sums(d.groupBy(value).agg(F.sum("r").alias("r"), F.sum("c").alias("c")), value, ["r", "c"])


def ks_distance(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples of a number: the largest gap of their distribution functions. Values are counted
    before they are ranked. Nulls are left out; null if either sample has no value."""
    gap = F.abs(F.try_divide("r_upto", "r_all") - F.try_divide("c_upto", "c_all"))
    return _both(reference, current, value).agg(F.max(gap).alias("ks"))


def wasserstein(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Area between the two distribution functions; null if either sample has no value. The last value of a range is followed by the first of the next that has any."""
    d = _both(reference, current, value)
    starts = d.groupBy("range").agg(F.min(value).alias("low"))
    after = starts.select("range", F.lead("low").over(Window.orderBy("range")).alias("next_low"))  # a row for each range
    next_value = F.coalesce(F.lead(value).over(Window.partitionBy("range").orderBy(value)), F.col("next_low"))
    gap = F.abs(F.try_divide("r_upto", "r_all") - F.try_divide("c_upto", "c_all"))
    return d.join(after, "range").select((gap * (next_value - F.col(value))).alias("area")).agg(F.sum("area").alias("wasserstein"))


def category_shares(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    each = lambda d, k: d.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias(k))
    d = each(reference, "r").join(each(current, "c"), value, "full_outer").fillna(0, ["r", "c"])
    every = Window.partitionBy()
    return d.select(value, "r", "c", F.try_divide("r", F.sum("r").over(every)).alias("p"), F.try_divide("c", F.sum("c").over(every)).alias("q"), F.sum("c").over(every).alias("n_current"))


def js_distance(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Jensen-Shannon distance (base 2) of two samples of a category; null if either sample has no value."""
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).when(m.isNotNull(), 0.0)
    return category_shares(reference, current, value).agg(F.sqrt(F.greatest(F.sum(term("p") + term("q")) / 2, F.sum(m) * 0)).alias("js"))


def chi_square(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Statistic and degrees of freedom of the current counts against the reference's shares; null if either sample has no value."""
    expected = F.col("p") * F.col("n_current")
    d = category_shares(reference, current, value).where("p > 0")
    return d.agg(F.sum(F.try_divide(F.pow(F.col("c") - expected, F.lit(2)), expected)).alias("chi_square"), F.nullif(F.count("*") - 1, F.lit(-1)).alias("degrees"))


def missing_values(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, and how many values are missing in the reference and in the current sample, with their shares (null of an empty sample)."""

    def one(df: DataFrame, side: str) -> DataFrame:
        counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)))
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias(f"{side}_missing"), F.try_divide(F.col(f"m{i}"), "n").alias(f"{side}_share")) for i, c in enumerate(columns)]
        return counts.select(F.inline(F.array(*cells)))

    return one(reference, "reference").join(one(current, "current"), "column_name")


def error_counts(requests: DataFrame, by: Sequence[str], failed: Column, kind: str) -> DataFrame:
    """How many requests of each group failed, by kind of error, and which share of the group's requests that is."""
    every = requests.groupBy(*by).agg(F.count("*").alias("requests"))
    d = requests.where(failed).groupBy(*by, kind).agg(F.count("*").alias("errors")).join(every, list(by))
    return d.withColumn("share", F.col("errors") / F.col("requests"))


def drift_summary(distances: DataFrame, threshold: float) -> DataFrame:
    """How many columns drift, and which share of those that have a distance (null if none has). distances: column, distance (null: not measured)."""
    return distances.agg(F.count_if(F.col("distance") >= threshold).alias("drifted_columns_count"), F.try_divide(F.count_if(F.col("distance") >= threshold), F.count("distance")).alias("drifted_columns_share"))


def numbered(events: DataFrame, track: str, ts: str, order: Sequence[str], seconds: int = 3600) -> DataFrame:
    """`events` with n, their number from 1 on within each track by time and then `order`, and total, how many the track has.

    Events are counted by track and time bucket of so many seconds, the counts are summed up bucket by bucket, and only within a bucket is
    there an order to find: no task takes a track whole. Null times come first; a null track is a track.
    """
    bucket = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)), F.lit(-(2**62))).cast("long")
    d = events.withColumn("_bucket", bucket)
    counts = d.groupBy(track, "_bucket").agg(F.count("*").alias("_k"))
    buckets = Window.partitionBy(track).orderBy("_bucket")
    starts = counts.select(F.col(track).alias("_track"), F.col("_bucket").alias("_at"), (F.sum("_k").over(buckets) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(track)).alias("total"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy(track, "_bucket").orderBy(ts, *order)))
    d = d.join(starts, F.col(track).eqNullSafe(F.col("_track")) & (F.col("_bucket") == F.col("_at")))
    return d.withColumn("n", F.col("n") + F.col("_before")).drop("_bucket", "_track", "_at", "_before")


def due_windows(numbered: DataFrame, size: int, every: int, after: Column | None = None) -> DataFrame:
    """One row for each event of each report that is due: at `size` events of a track and after each `every` more, over the latest `size`.
    numbered: n, total; reports due at number `after` or before are left out."""
    first = F.ceil((F.greatest(F.col("n"), F.lit(size)) - size) / every).cast("long")
    last = F.floor((F.col("n") - 1) / every).cast("long")
    d = numbered.withColumn("report", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    due = F.col("report") * every + size
    return d.where(due <= F.col("total")).where(due > after if after is not None else F.lit(True))


def rolling_report(events: DataFrame, track: str, order: Sequence[str], size: int = 60, every: int = 30) -> DataFrame:
    """For each track the events at which a report is due: at `size` events, then after each `every` more; and each report's
    window of the latest `size` events. One row for each event of each report; the first column of `order` is the time."""
    return due_windows(numbered(events, track, order[0], order[1:]), size, every).drop("n", "total")


def positive_probability(prediction: str, probability: str) -> Column:
    """The probability of class 1 from that of the predicted class."""
    return F.when(F.col(prediction) == 1, F.col(probability)).otherwise(1 - F.col(probability))


def reference_hash(df: DataFrame) -> DataFrame:
    """A hash of a table's content that doesn't depend on the order of rows or columns."""
    return df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.hex(F.expr("bit_xor(h)")).alias("xor"), F.hex(F.sum(F.pmod("h", F.lit(2**31 - 1)))).alias("sum"), F.count("*").alias("rows"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of values up to each bound."""
    d = df.select(*by, value, F.explode(F.array(*map(F.lit, bounds))).alias("le"))
    return d.groupBy(*by, "le").agg(F.count_if(F.col(value) <= F.col("le")).alias("n"))


def windows(df: DataFrame, ts: str, size: str, slide: str | None = None) -> DataFrame:
    return df.withColumn("w", F.window(ts, size, slide) if slide else F.window(ts, size)).withColumn("window_start", F.col("w.start")).drop("w")


def share_alert(df: DataFrame, ts: str, bad: Column, above: float, size: str, slide: str) -> DataFrame:
    """Sliding windows in which more than that share of rows is bad."""
    d = windows(df.withColumn("_bad", bad), ts, size, slide).groupBy("window_start").agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad"))
    return d.withColumn("share", F.col("bad") / F.col("n")).where(F.col("share") > above)


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles of each group, interpolated between neighbours, from values that are counted before they are ranked: no task sees all
    values of a group. Columns p50, p95, ...; nulls are no values, and a group without any has no row."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    d = running_sums(counted, value, ["_k"], by)
    at = lambda p: F.lit(p) * (F.col("_k_all") - 1)
    reached = lambda place: F.min(F.when(F.col("_k_upto") > place, F.col(value)))
    ends = [x for p in quantiles for x in (reached(F.floor(at(p))).alias(f"_low_{p}"), reached(F.ceil(at(p))).alias(f"_high_{p}"))]
    d = d.groupBy(*by).agg(F.max("_k_all").alias("_k_all"), *ends)
    between = lambda p: F.col(f"`_low_{p}`") + (F.col(f"`_high_{p}`") - F.col(f"`_low_{p}`")) * (at(p) - F.floor(at(p)))
    return d.select(*by, *(between(p).alias(f"p{p * 100:g}") for p in quantiles))


def latency_quantiles(df: DataFrame, ts: str, value: str, size: str, limit: float) -> DataFrame:
    """p50, p95 and p99 of each window, and the share within the limit."""
    w = windows(df, ts, size)
    whole = w.groupBy("window_start").agg(F.avg((F.col(value) <= limit).cast("double")).alias("within_limit"), F.avg(value).alias("mean"))
    return exact_quantiles(w, value, (0.5, 0.95, 0.99), ["window_start"]).join(whole, "window_start")


def sketch_bucket(value: Column, error: float) -> Column:
    """The logarithmic bucket of a value, as sign and number: all values of a bucket are within `error` of its middle, relatively."""
    gamma = (1 + error) / (1 - error)
    return F.struct(F.signum(value).cast("int").alias("sign"), F.when(value != 0, F.ceil(F.log(F.abs(value)) / math.log(gamma))).otherwise(0).cast("int").alias("number"))


def quantile_sketch(df: DataFrame, value: str, by: Sequence[str], error: float = 0.01) -> DataFrame:
    """How many values of each group fall into each logarithmic bucket: by, sign, number, n, total (of the values). Nulls are no values.

    A group has as many rows as its values span buckets (of positive doubles between 1e-9 and 1e9 some 2,100 at an error of 1 %), however
    many values it has. Sketches of several groups are merged by merge_sketches().
    """
    d = df.where(F.col(value).isNotNull()).withColumn("_b", sketch_bucket(F.col(value), error))
    return d.groupBy(*by, F.col("_b.sign").alias("sign"), F.col("_b.number").alias("number")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def merge_sketches(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketch of coarser groups, or of sketches that were put together: equal to the sketch of all their values."""
    return sketch.groupBy(*by, "sign", "number").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def sketch_quantiles(sketch: DataFrame, quantiles: Sequence[float], by: Sequence[str], error: float = 0.01) -> DataFrame:
    """Quantiles of each group from its sketch, each within the relative error of the value at that rank: by, n, mean, p50, p95, ..."""
    gamma = (1 + error) / (1 - error)
    place = F.col("sign") * F.col("number")
    upto = Window.partitionBy(*by).orderBy("sign", place).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    middle = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("number")) / (gamma + 1))
    d = sketch.select(*by, "sign", "n", "total", place.alias("_place"), middle.alias("_middle"), F.sum("n").over(upto).alias("_upto"), F.sum("n").over(every).alias("_all"))
    at = lambda p: F.floor(F.lit(p) * (F.col("_all") - 1)) + 1
    found = lambda p: F.min_by("_middle", F.when(F.col("_upto") >= at(p), F.col("_upto"))).alias(f"p{p * 100:g}")
    return d.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), *(found(p) for p in quantiles))


def request_rate(df: DataFrame, ts: str, by: Sequence[str], size: str, seconds: int) -> DataFrame:
    return windows(df, ts, size).groupBy("window_start", *by).agg((F.count("*") / seconds).alias("per_second"))


def silent_windows(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Windows between the first and the last event that have none."""
    seen = windows(df, ts, size).select("window_start").distinct()
    span = seen.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {size}"))).alias("window_start")).join(seen, "window_start", "left_anti")


def one_class(df: DataFrame, ts: str, model: str, predicted: str, more_than: int, size: str) -> DataFrame:
    """Windows in which a model with enough predictions gives but one class."""
    d = windows(df, ts, size).groupBy("window_start", model).agg(F.count("*").alias("n"), F.count_distinct(predicted).alias("classes"))
    return d.where((F.col("classes") == 1) & (F.col("n") > more_than))


def low_confidence(df: DataFrame, ts: str, probability: str, below: float, size: str, by: Sequence[str] = ()) -> DataFrame:
    return windows(df, ts, size).groupBy("window_start", *by).agg(F.avg(probability).alias("mean")).where(F.col("mean") < below)


def held(conditions: DataFrame, at: str, condition: Column, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Evaluations at which the condition has held for `steps` evaluations in a row, this one included: gaps and islands."""
    w = Window.partitionBy(*by).orderBy(at)
    d = conditions.withColumn("_c", F.coalesce(condition, F.lit(False)))
    d = d.withColumn("_island", F.row_number().over(w) - F.sum(F.col("_c").cast("int")).over(w))
    d = d.where("_c").withColumn("held", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(at)))
    return d.where(F.col("held") >= steps).drop("_c", "_island")


def infer_column_roles(reference: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """column_name, role: booleans, and numbers of at most two values, are categorical; other numbers numerical; the rest skipped.
    Nulls are no value; a column without any value is categorical. Two scans, a row each."""
    kinds = {f.name: f.dataType for f in reference.schema if f.name not in skip}
    numbers = [n for n, t in kinds.items() if isinstance(t, T.NumericType)]
    c = lambda n: F.col(f"`{n}`")
    ends = reference.agg(*(F.min(c(n)).alias(f"low_{i}") for i, n in enumerate(numbers)), *(F.max(c(n)).alias(f"high_{i}") for i, n in enumerate(numbers))) if numbers else None
    first = ends.first() if numbers else None
    # two values at most: nothing lies between the least and the greatest
    between = [F.count_if((c(n) > F.lit(first[f"low_{i}"])) & (c(n) < F.lit(first[f"high_{i}"]))).alias(f"between_{i}") for i, n in enumerate(numbers) if first[f"low_{i}"] is not None]
    inner = reference.agg(*between).first().asDict() if between else {}
    role = {n: "categorical" if inner.get(f"between_{i}", 0) == 0 else "numerical" for i, n in enumerate(numbers)}
    rows = [(n, role.get(n, "categorical" if isinstance(t, T.BooleanType) else "skipped")) for n, t in kinds.items()]
    return reference.sparkSession.createDataFrame(rows, "column_name string, role string")


def backtest(labelled: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, identity: Sequence[str], limit: int) -> DataFrame:
    """Replay a stratified holdout through a scorer: quality over what it scored, how many failed, and whether all did.

    score: adds prediction (0 or 1; null: failed) and probability (of that prediction). An empty holdout has failed.
    """
    d = score(stratified_sample(labelled, target, limit, identity))
    counts = d.agg(F.count("*").alias("replayed"), F.count_if(F.col("prediction").isNull()).alias("failed"))
    good = d.where("prediction is not null").withColumn("p1", positive_probability("prediction", "probability"))
    quality = binary_metrics(good, (), target, "prediction", "p1")
    return counts.join(quality, F.lit(True), "left").withColumn("all_failed", F.col("replayed") == F.col("failed"))  # two rows of aggregates


def served_quality(served: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each served model version the metrics and the estimator of its latest run; null where it has none.
    served: model, version; runs: model, version, run_at, estimator, metric, the later of equals by metric."""
    latest = runs.groupBy("model", "version").agg(F.max_by(F.struct("estimator", "metric", "run_at"), F.struct("run_at", "metric")).alias("r"))
    return served.join(latest, ["model", "version"], "left").select("model", "version", "r.estimator", "r.metric", "r.run_at")


def gauge_alert(gauge: DataFrame, ts: str, value: str, above: float, size: str, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Windows whose greatest value of the gauge has been above the limit for `steps` windows in a row."""
    d = windows(gauge, ts, size).groupBy("window_start", *by).agg(F.max(value).alias("peak"))
    return held(d, "window_start", F.col("peak") > above, steps, by)


def target_down(gauge: DataFrame, ts: str, size: str, by: Sequence[str]) -> DataFrame:
    """Windows, from the first to the last of all targets, in which a target reports nothing."""
    seen = windows(gauge, ts, size).select("window_start", *by).distinct()
    span = seen.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {size}"))).alias("window_start"))
    return every.join(seen.select(*by).distinct(), F.lit(True)).join(seen, ["window_start", *by], "left_anti")  # windows x targets


def error_rate(requests: DataFrame, ts: str, by: Sequence[str], error: Column, size: str, seconds: int, above: float) -> DataFrame:
    """Windows in which a model and type has more errors a second than the limit."""
    d = request_rate(requests.where(error), ts, by, size, seconds)
    return d.where(F.col("per_second") > above)
