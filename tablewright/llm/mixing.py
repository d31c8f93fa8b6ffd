"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import NOT_SPACE, stash, unused

#: Hash buckets of a source (hexadecimal digits), whose sums give every document its place in the source's seeded order.
DIGITS = 3


def water_levels(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """target of each source: its share by weight, clamped at `epochs` times its size, the excess reshared until none is above.

    sources: source_key (null-safe), source, source_size; one row a source. Weights repeat over the sources by code point, null
    last. Clamping, and resharing what is cut off, ends at a common level: target = min(epochs * size, level * weight). Sources
    ordered by epochs * size / weight are clamped up to the first that the level of those after it leaves uncut.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * epochs).cast("double"))
    rise = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(every))
    return s.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document a mix takes, so that each source comes to its target.

    docs: doc_id, text, source; other columns, whatever their names, are not read. Size: words of the text, null: 0. The targets
    share the total of all sizes. A source is taken floor(target / size) times whole; for the fraction that is left,
    documents are taken in a seeded order (md5 of seed and doc_id) until it is full, the last of them in part. So every
    source's taken words are its target rounded down, and a document is taken `epochs` times at most. A null source is a source of
    its own; rows that repeat a doc_id are documents of their own; an empty table gives no rows.
    Returns doc_id, size, source_size, target, taken, extra (what of taken is beyond the whole repetitions), repeats and source.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    sized = stash(sized)  # counted once; narrow
    sized = sized.withColumn("bucket", F.substring("place", 1, DIGITS)).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    buckets = sized.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    levels = water_levels(sources, weights, epochs).select("source_key", "source_size", "target")
    up_to = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0))).select("source_key", "bucket", "start")
    plan = starts.join(levels, "source_key")

    within = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, ["source_key", "bucket"])
    at = at.withColumn("wanted", F.floor("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("wanted") - whole * F.col("source_size") - F.col("start") - F.col("ahead")
    at = at.withColumn("repeats", whole).withColumn("extra", F.least(F.col("size"), F.greatest(left, F.lit(0))).cast("long"))
    return at.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats") + F.col("extra")).alias("taken"), "extra", "repeats", "source")


def expand(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as taken, with all its columns. Of a part, at least half is a whole document, less
    is none, so that no text is cut; it concerns one document a source. Rows that repeat doc_id and source are taken equally often, as often as
    the least taken of them."""
    plan = mix(docs, weights, epochs, seed)
    times = (F.col("repeats") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)).cast("int")
    key, of, n, copy = unused(docs, "plan_id", "plan_source", "plan_times", "plan_copy")
    plan = plan.groupBy(F.col("doc_id").alias(key), F.col("source").alias(of)).agg(F.min(times).alias(n)).where(F.col(n) > 0)
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(plan[key]) & docs["source"].eqNullSafe(plan[of]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(f"`{c}`" for c in docs.columns))
