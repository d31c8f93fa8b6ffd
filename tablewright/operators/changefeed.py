"""Change feed, work list and prediction queue: every step takes the tables as they are and returns them as they become."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.tables import REF

TRACKS = ("keys", "nf", "subject_area")


def snapshot_tables(tables: dict[str, DataFrame], database: str = "lake", schema: str = "star") -> DataFrame:
    """Rows and columns of each table. Counting a table reads no column; a table whose schema can't be read is left out."""
    out = None
    for name, df in sorted(tables.items()):
        try:
            width = len(df.columns)
        except Exception:  # noqa: BLE001  any failure of a source means: not there this time
            continue
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(database).alias("database"), F.lit(schema).alias("schema"), F.lit(name).alias("table_name"), "row_count", F.lit(width).alias("column_count"))
        out = one if out is None else out.union(one)
    return out


def diff_snapshots(now: DataFrame, before: DataFrame) -> DataFrame:
    """new_table, else schema_changed, else row_count_changed; tables that are gone are not reported."""
    b = before.select(*REF, F.col("row_count").alias("_rows"), F.col("column_count").alias("_columns"))
    kind = F.when(F.col("_rows").isNull(), "new_table").when(F.col("_columns") != F.col("column_count"), "schema_changed").when(F.col("_rows") != F.col("row_count"), "row_count_changed")
    return now.join(b, REF, "left").withColumn("change_type", kind).where("change_type is not null").select(*REF, "change_type")


def record_changes(pending: DataFrame, changes: DataFrame, source: str, at: Column) -> DataFrame:
    """The work list with the changes added, open on every track; duplicates are allowed."""
    new = changes.select(*REF, "change_type", F.lit(source).alias("source"), at.cast("timestamp").alias("detected_at"))
    return pending.unionByName(new, allowMissingColumns=True)


def is_open(track: str) -> Column:
    return F.col(f"{track}_claimed_by").isNull() & F.col(f"{track}_completed_at").isNull()


def claim(pending: DataFrame, track: str, run: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the work list with its open rows claimed by the run, the distinct tables that the run holds). Repeating a claim changes
    nothing and returns the same tables."""
    mine = is_open(track)
    new = pending.withColumn(f"{track}_claimed_at", F.when(mine, at.cast("timestamp")).otherwise(F.col(f"{track}_claimed_at"))).withColumn(f"{track}_claimed_by", F.when(mine, F.lit(run)).otherwise(F.col(f"{track}_claimed_by")))
    return new, new.where((F.col(f"{track}_claimed_by") == run) & F.col(f"{track}_completed_at").isNull()).select(REF).distinct()


def complete(pending: DataFrame, track: str, run: str, at: Column) -> DataFrame:
    mine = (F.col(f"{track}_claimed_by") == run) & F.col(f"{track}_completed_at").isNull()
    return pending.withColumn(f"{track}_completed_at", F.when(mine, at.cast("timestamp")).otherwise(F.col(f"{track}_completed_at")))


def release(pending: DataFrame, track: str, mine: Column) -> DataFrame:
    mine = F.coalesce(mine & F.col(f"{track}_completed_at").isNull(), F.lit(False))
    for c, kind in (("claimed_by", "string"), ("claimed_at", "timestamp")):
        pending = pending.withColumn(f"{track}_{c}", F.when(mine, F.lit(None).cast(kind)).otherwise(F.col(f"{track}_{c}")))
    return pending


def release_run(pending: DataFrame, track: str, run: str) -> DataFrame:
    return release(pending, track, F.col(f"{track}_claimed_by") == run)


def release_stale(pending: DataFrame, now: Column, minutes: int = 120, tracks: Sequence[str] = TRACKS) -> DataFrame:
    """Open again what has been claimed for longer than that and was never completed."""
    for t in tracks:
        pending = release(pending, t, F.col(f"{t}_claimed_at") < now.cast("timestamp") - F.expr(f"interval {minutes} minutes"))
    return pending


def count_unclaimed(pending: DataFrame, tracks: Sequence[str] = TRACKS) -> DataFrame:
    """Rows that some track may still claim."""
    some = F.lit(False)
    for t in tracks:
        some = some | is_open(t)
    return pending.agg(F.count_if(some).alias("n_open"))


def enqueue(queue: DataFrame, staged: DataFrame, requeue: DataFrame | None = None, key: Sequence[str] = (*REF, "column_name"), order: Sequence[str] = (*REF, "ordinal_position")) -> DataFrame:
    """The queue with the staged rows added that have no unprocessed row, and were never processed or belong to a table in requeue.

    New ids go on from the largest, in that order. They are dense, so one task numbers the new rows: metadata, a row for each column.
    """
    k = list(key)
    new = staged.join(queue.where("not processed").select(k).distinct(), k, "left_anti")
    never = new.join(queue.where("processed").select(k).distinct(), k, "left_anti")
    if requeue is not None:
        again = new.join(queue.where("processed").select(k).distinct(), k, "left_semi").join(requeue.select(REF).distinct(), REF, "left_semi")
        never = never.unionByName(again)
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    never = never.withColumn("n", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(top))
    never = never.withColumn("id", (F.col("top") + F.col("n")).cast("long")).withColumn("processed", F.lit(False)).drop("n", "top")
    return queue.unionByName(never, allowMissingColumns=True)


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("total"), F.count_if(~F.col("processed")).alias("unprocessed"), F.count_if("processed").alias("processed"))


def fetch_batch(queue: DataFrame, limit: int) -> DataFrame:
    """The oldest unprocessed rows."""
    return queue.where("not processed").orderBy("id").limit(limit)


def mark_processed(queue: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mark the rows for which all models answered. answers: id, model."""
    done = answers.where(F.col("model").isin(*models)).groupBy("id").agg(F.count_distinct("model").alias("n")).where(F.col("n") == len(models)).select("id", F.lit(True).alias("_done"))
    return queue.join(done, "id", "left").withColumn("processed", F.col("processed") | F.coalesce("_done", F.lit(False))).drop("_done")


def fully_queued_tables(columns: DataFrame, queue: DataFrame) -> DataFrame:
    """Tables of which every column is in the queue."""
    key = [*REF, "column_name"]
    q = queue.select(key).distinct().withColumn("_there", F.lit(1))
    return columns.select(key).join(q, key, "left").groupBy(REF).agg(F.count_if(F.col("_there").isNull()).alias("missing")).where("missing = 0").select(REF)


def leftover_for_tables(queue: DataFrame, tables: DataFrame) -> DataFrame:
    """Unprocessed rows of the given tables: none means that a run over them succeeded."""
    return queue.where("not processed").join(tables.select(REF).distinct(), REF, "left_semi").agg(F.count("*").alias("leftover"))


def processed_tables(results: DataFrame) -> DataFrame:
    return results.select(REF).distinct()
