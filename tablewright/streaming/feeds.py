"""Streams: notifications that wake a diff, windowed counts with late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.changefeed import diff_snapshots
from tablewright.sources.ledger import Ledger, Put, View
from tablewright.sources.shared import shared_dir

SEEN = "database string, schema string, table_name string, row_count long, column_count int"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files; time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    s = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder, and read it. In update and complete mode the
    last batch's rows count."""
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(spark.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(0)).schema).parquet(f"{at}/out/*")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch_id").alias("batch_id"))), "batch_id")
    return out.drop("batch_id")


def windowed_counts(stream: DataFrame, ts: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts of each window; rows later than the watermark are left out once their window is closed."""
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def notification_stream(notes: DataFrame, diff: Callable[[], DataFrame], record: Callable[[DataFrame, int], None], watermarks: Callable[[], None], checkpoint: str):
    """Each micro-batch of notifications, however many, wakes one diff; its changes are recorded first and the watermarks moved after,
    so that a crash in between repeats changes and loses none. record() gets the batch id; recorded_notifications() leaves out what it has."""

    def wake(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            record(diff(), n)
            watermarks()

    return notes.writeStream.foreachBatch(wake).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded_notifications(notes: DataFrame, ledger: Ledger, snapshot: Callable[[], DataFrame], source: str) -> None:
    """Each micro-batch of notifications wakes one diff of the tables as they are against those last seen. Its changes and what was seen
    are one commit of the ledger (tables pending and seen), so a batch that comes again, after a crash anywhere, changes nothing twice and
    loses nothing."""

    def work(batch: DataFrame, view: View) -> dict[str, Put]:
        if batch.isEmpty():
            return {}
        now = view.written(snapshot())
        changes = diff_snapshots(now, view.read("seen", SEEN)).withColumns({"source": F.lit(source), "detected_at": F.current_timestamp()})
        return {"pending": Put(changes, append=True), "seen": Put(now)}

    ledger.stream(notes, "notifications", work)
