"""Queries of folds, examples, representatives, missing values, errors and durations, and of tables that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import evaluation, monitor, text
from tablewright.plans import run_queries, text_quality_queries
from tablewright.plans.run_queries import _events, _scored
from tablewright.plans.star import star
from tablewright.sources import tables
from tablewright.sources.shared import shared_dir

BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0]


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of labelled documents, by source, with both classes spread evenly."""
    return evaluation.balanced_folds(_scored(spark, sf_dir), "source", "label").select("doc_id", "source", "fold")


def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_examples(_scored(spark, sf_dir), ["doc_id"]).select("bucket", "rank", "doc_id", "source")


def other_kind_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives of the quality label that carry the other label."""
    return evaluation.other_kind_share(_scored(spark, sf_dir), ["toxic"]).withColumn("other_kind_share", F.round("other_kind_share", 9))


def topic_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents that stand for each language's keywords."""
    docs, terms = text_quality_queries._docs(spark, sf_dir), text.words(F.col("text"))
    keywords = text.topic_keywords(docs, "lang", terms)
    return text.representatives(docs, "doc_id", "lang", terms, keywords)


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of the first and the second half of the events; values of errors, and every ninth user, are taken as missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("user_id", F.when(F.col("user_id") % 9 > 0, F.col("user_id")))
    old = F.dayofmonth("ts") <= 15
    d = monitor.missing_values(e.where(old), e.where(~old), ["value", "user_id", "event_type"])
    return d.select("column_name", "reference_missing", "current_missing", *(F.round(c, 9).alias(c) for c in ("reference_share", "current_share")))


def errors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed requests of each model, by the kind of user that sent them."""
    e = _events(spark, sf_dir).withColumn("kind", F.when(F.col("user_id") % 5 == 0, "timeout").when(F.col("user_id") % 5 == 1, "refused").otherwise("bad_input"))
    return monitor.error_counts(e, ["model"], F.col("event_type") == "error", "kind").withColumn("share", F.round("share", 9))


def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts of each model's durations."""
    return monitor.histogram(_events(spark, sf_dir), "value", BOUNDS, ["model"])


def staged_and_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation, staged twice (the second time counts) and appended on two days (both count)."""
    c, at = spark.read.parquet(f"{sf_dir}/customer.parquet"), _new(spark)
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    tables.write_staging(counts.where("n < 0"), f"{at}/staging")
    tables.write_staging(counts, f"{at}/staging")
    staged = spark.read.parquet(f"{at}/staging")
    for day in ("2024-01-01", "2024-01-02"):
        tables.append_results(staged.withColumn("run_date", F.lit(day)), f"{at}/results")
    results = spark.read.schema(T.StructType([*staged.schema.fields, T.StructField("run_date", T.StringType())])).parquet(f"{at}/results")
    return tables.materialise(results.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.count_distinct("run_date").alias("days")), f"{at}/table", ["c_nationkey", "n", "days"])


def labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels, written with a header and read back under their schema."""
    labels, at = spark.read.parquet(f"{sf_dir}/labels.parquet"), _new(spark)
    labels.write.option("header", True).csv(at)
    return tables.read_labelled_csv(spark, at, "doc_id long, quality int, toxic int")


def resumed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the star's tables, one part each; the first run is broken off, the second builds what is missing."""
    at, counted = _new(spark), star(spark, sf_dir)
    units = {t: (lambda df=df: df.agg(F.count("*").alias("row_count"))) for t, df in counted.items()}

    def broken() -> DataFrame:
        raise OSError("broken off")

    try:
        tables.resumable_build(spark, {t: make if i < 3 else broken for i, (t, make) in enumerate(units.items())}, at)
    except OSError:
        pass
    again = {t: broken if i < 3 else make for i, (t, make) in enumerate(units.items())}
    return tables.resumable_build(spark, again, at).select(F.col("unit").alias("table_name"), "row_count")


QUERIES = {
    f.__name__: f
    for f in (
        balanced_folds, error_examples, other_kind_errors, topic_representatives, missing_values, errors_by_type, duration_histogram, staged_and_appended, labelled_csv, resumed_build,
    )
}

_S, _E, _TOPICS = run_queries._S, run_queries._E, text_quality_queries._TOPICS
_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_COST = " + ".join(f"(2 * {c}l[x + 1] + {c}) * {c} / ({c}t * {c}t)" for c in "pq")

ORACLE_SQL = {
    "balanced_folds": f"""
        WITH RECURSIVE {_S}, g AS (SELECT source, count(*) FILTER (label = 0)::DOUBLE AS p, count(*) FILTER (label = 1)::DOUBLE AS q, row_number() OVER (ORDER BY count(*) DESC, md5(coalesce(source, ''))) AS i FROM s GROUP BY 1),
        t AS (SELECT sum(p) AS pt, sum(q) AS qt FROM g),
        r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, 0::BIGINT AS fold, [0, 0, 0, 0, 0]::DOUBLE[] AS pl, [0, 0, 0, 0, 0]::DOUBLE[] AS ql UNION ALL
              SELECT i, source, f, list_transform(range(5), lambda x: pl[x + 1] + CASE WHEN x = f THEN p ELSE 0 END), list_transform(range(5), lambda x: ql[x + 1] + CASE WHEN x = f THEN q ELSE 0 END)
              FROM (SELECT *, list_position(c, list_min(c))::BIGINT - 1 AS f FROM (SELECT g.*, pl, ql, list_transform(range(5), lambda x: {_COST}) AS c FROM r JOIN g ON g.i = r.i + 1, t)))
        SELECT s.doc_id, s.source, CAST(r.fold AS INTEGER) AS fold FROM s JOIN r ON r.i > 0 AND r.source IS NOT DISTINCT FROM s.source""",
    "error_examples": f"""WITH {_S}, z AS (SELECT *, CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN prediction = 1 THEN 'FP' WHEN label = 1 THEN 'FN' END AS bucket FROM s),
        y AS (SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS INTEGER) AS rank, doc_id, source FROM z WHERE bucket IS NOT NULL) SELECT * FROM y WHERE rank <= 30""",
    "other_kind_errors": f"WITH {_S} SELECT count(*) AS n, round(avg(CAST(coalesce(toxic, 0) = 1 AS DOUBLE)), 9) AS other_kind_share FROM s WHERE label = 0 AND prediction = 1",
    "topic_representatives": f"""WITH {_TOPICS}, k AS (SELECT * FROM (SELECT w.lang, w.term, w.weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS n FROM w) WHERE n <= 8),
        d AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), n AS (SELECT doc_id, lang, term, count(*) AS tf FROM d GROUP BY 1, 2, 3), z AS (SELECT doc_id, lang, sum(tf) AS size FROM n GROUP BY 1, 2),
        h AS (SELECT n.doc_id, n.lang, sum(n.tf * k.weight) AS hit FROM n JOIN k USING (lang, term) GROUP BY 1, 2), v AS (SELECT h.lang, h.doc_id, round(hit / size, 9) AS score FROM h JOIN z USING (doc_id, lang)),
        y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM v) SELECT * FROM y WHERE rank <= 3""",
    "missing_values": """WITH e AS (SELECT dayofmonth(ts) <= 15 AS old, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN user_id % 9 > 0 THEN user_id END AS user_id, event_type FROM events),
        m AS (SELECT old, count(*) AS n, count(*) - count(value) AS a, count(*) - count(user_id) AS b, count(*) - count(event_type) AS c FROM e GROUP BY 1),
        u AS (SELECT old, 'value' AS column_name, a AS m, a / n::DOUBLE AS s FROM m UNION ALL SELECT old, 'user_id', b, b / n::DOUBLE FROM m UNION ALL SELECT old, 'event_type', c, c / n::DOUBLE FROM m)
        SELECT column_name, max(m) FILTER (old) AS reference_missing, max(m) FILTER (NOT old) AS current_missing, round(max(s) FILTER (old), 9) AS reference_share, round(max(s) FILTER (NOT old), 9) AS current_share FROM u GROUP BY 1""",
    "errors_by_type": f"""WITH {_E}, n AS (SELECT model, count(*) AS requests FROM e GROUP BY 1), x AS (SELECT model, CASE user_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' ELSE 'bad_input' END AS kind, count(*) AS errors FROM e WHERE event_type = 'error' GROUP BY 1, 2)
        SELECT model, kind, errors, requests, round(errors / requests::DOUBLE, 9) AS share FROM x JOIN n USING (model)""",
    "duration_histogram": f"WITH {_E} SELECT model, le, count(*) FILTER (value <= le) AS n FROM e, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}) AS b(le) GROUP BY 1, 2",
    "staged_and_appended": "SELECT c_nationkey, 2 * count(*) AS n, 2::BIGINT AS days FROM customer GROUP BY 1",
    "labelled_csv": "SELECT doc_id, quality, toxic FROM labels",
    "resumed_build": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _STAR),
}
