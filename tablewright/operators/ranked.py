"""Running sums in the order of a number, without one task that sees all its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values are cut into, for each partition of the sums.
RANGES = 64


def running_sums(counted: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """`counted` with <s>_upto (of the values up to and with the row's own) and <s>_all for each of `sums`, and `range`: values fall into
    ranges of about equally many, a later range has the larger values (the smaller ones if descending).

    counted: one row for each value (within `by`), no null values. Ranges are cut at approximate quantiles; sums of ranges are few
    rows, and the order within a range is a task's work. The order of ranges and values is that of one sort.
    """
    b, sign = list(by), -1 if descending else 1
    cuts = counted.agg(F.percentile_approx(F.col(value).cast("double"), [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted({sign * c for c in cuts})
    bounds = F.array(*map(F.lit, cuts)).cast("array<double>")
    d = counted.withColumn("range", F.size(F.filter(bounds, lambda c: c < sign * F.col(value).cast("double"))))
    parts = d.groupBy(*b, "range").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    before = Window.partitionBy(*b).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*b)
    parts = parts.select(*b, "range", *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums), *(F.sum(f"_{s}").over(every).alias(f"{s}_all") for s in sums))
    order = F.desc(value) if descending else F.asc(value)
    within = Window.partitionBy(*b, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *(F.sum(s).over(within).alias(f"_{s}_within") for s in sums)).join(parts, [*b, "range"])
    d = d.withColumns({f"{s}_upto": F.col(f"_{s}_before") + F.col(f"_{s}_within") for s in sums})
    return d.drop(*(f"_{s}_{k}" for s in sums for k in ("before", "within")))
