"""Queries of votes, folds, metrics and monitors.

Predictions are derived from the given tables by fixed arithmetic: documents with a quality label get a score, events a model, class
and probability. Events are about 14 an hour at the smallest scale, so windows are hours where a service would take minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import evaluation, monitor


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    d = labels.join(docs.select("doc_id", "source", "lang"), "doc_id").withColumn("label", F.col("quality").cast("int"))
    d = d.withColumn("score", F.round((F.col("doc_id") * 37 % 61) / 100 + F.col("label") * 0.35, 2)).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return d.select("doc_id", "source", "lang", "label", "toxic", "score", "prediction")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = (F.col("event_id") * 13 % 50 + 50) / 100
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.when(F.col("user_id") % 3 == 2, 1).otherwise(F.col("event_id") % 2).cast("int").alias("predicted"), p.alias("probability"))


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column predictions: tables are users, columns their events; each 7th is not scored, each 5th lacks class 3."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 200).cast("string").alias("table_name"))
    w = [(F.col("event_id") * k % m + 1).cast("double") for k, m in ((3, 11), (5, 13), (7, 17), (11, 19))]
    total = w[0] + w[1] + w[2] + w[3]
    pairs = [x for k in range(3) for x in (F.lit(str(k)), w[k] / total)]
    three, four = F.create_map(*pairs), F.create_map(*pairs, F.lit("3"), w[3] / total)
    return e.select("table_name", "event_id", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, three).otherwise(four).alias("probabilities"))


def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.soft_vote(_distributions(spark, sf_dir))


def rule_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 200).cast("string").alias("table_name")).agg(F.count("*").alias("row_count"))
    t = F.col("table_name").cast("int")
    rules = rules.select("table_name", (t % 4).alias("rule_normal_form"), F.when(t % 10 == 0, F.lit(29)).otherwise(F.col("row_count")).alias("row_count"), F.when(t % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("constant_columns"))
    d = evaluation.rule_cross_check(evaluation.soft_vote(_distributions(spark, sf_dir)), rules)
    return d.select("table_name", "prediction", "rule_normal_form", "rule_agrees", "needs_review", "review_reason")


def hard_vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of each source's documents on quality against the majority label."""
    s = _scored(spark, sf_dir)
    votes = evaluation.hard_vote(s, ["source"]).join(evaluation.hard_vote(s.select("source", F.col("label").alias("prediction")), ["source"]).withColumnRenamed("vote", "truth"), "source")
    return votes.agg(F.count("*").alias("n"), F.avg((F.col("vote") == F.col("truth")).cast("double")).alias("accuracy"))


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 4 <> 1")
    reason = F.concat(F.element_at(F.array(F.lit("No such model"), F.lit("Connection refused by"), F.lit("alias unset for"), F.lit("bad input for")), (F.col("event_id") % 4 + 1).cast("int")), F.lit(" "), F.col("event_type"))
    return evaluation.failure_report(e.select(reason.alias("reason"))).select("kind", "n", "reasons", "rank")


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grouped_stratified_folds(_scored(spark, sf_dir), "source", "label").select("doc_id", "source", "fold")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_weights(_scored(spark, sf_dir), "label").withColumn("weight", F.round("weight", 9))


def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts that hang together through large, dear lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 49 and l_discount >= 0.09")
    return evaluation.split_groups(li.select(F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("p")), "o", "p")


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.curve(_scored(spark, sf_dir), ["lang"])
    return c.select("lang", "score", "tp", "predicted", "positives", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(_scored(spark, sf_dir), ["lang"]).withColumn("average_precision", F.round("average_precision", 9))


def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_threshold(_scored(spark, sf_dir), ["lang"]).withColumn("f1", F.round("f1", 9))


def binary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("p", F.least("score", F.lit(1.0)))
    return evaluation.binary_metrics(d, ["lang"], probability="p").select("lang", "n", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "log_loss")))


def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _classes(spark, sf_dir)
    out = evaluation.averaged_metrics(evaluation.class_metrics(d))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as classes, taken for the next one by every sixth document."""
    langs = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    at = (F.array_position(langs, F.col("lang")) + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0) - 1) % 4
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return d.select("doc_id", F.col("lang").alias("label"), F.get(langs, at.cast("int")).alias("prediction"))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.class_metrics(_classes(spark, sf_dir))
    return c.select("class", "support", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_classes(spark, sf_dir))


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.grouped_stratified_folds(_scored(spark, sf_dir), "source", "label")
    out = evaluation.fold_summary(evaluation.binary_metrics(d, ["fold"]))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("is_english", (F.col("lang") == "en").cast("int"))
    e = evaluation.error_buckets(d, ["toxic", "is_english"])
    return e.select("bucket", "n", *(F.round(c, 9).alias(c) for c in ("toxic_rate", "is_english_rate")))


def top_missed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_names(_scored(spark, sf_dir), (F.col("label") == 1) & (F.col("prediction") == 0), "source")


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-offs as candidates, by their mean F1 over languages."""
    d = _scored(spark, sf_dir).withColumn("candidate", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7)))))
    m = evaluation.binary_metrics(d.withColumn("prediction", (F.col("score") >= F.col("candidate")).cast("int")), ["lang", "candidate"])
    return evaluation.best_candidate(m.withColumn("track", F.lit("quality")), ["track"], "candidate").withColumn("mean", F.round("mean", 9))


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as models: development scores on even, production on odd documents; some have no version, metric or change."""
    s = _scored(spark, sf_dir)
    m = lambda r, v: evaluation.binary_metrics(s.where(F.col("doc_id") % 2 == r), ["lang"]).select(F.col("lang").alias("model"), F.lit(v).alias("version"), F.when(F.col("lang") != "fr", F.round("f1", 9)).alias("metric"), F.when(F.col("lang") != "fr", F.round("accuracy", 9)).alias("fallback"))
    dev, prod = m(0, 2).where("model <> 'es'"), m(1, 1).where("model <> 'de'")
    return evaluation.promotion_gate(dev, prod, "fallback").select("model", "verdict")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return monitor.hash_split(d, ["event_id", "user_id", "event_type"], 80)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return monitor.stratified_sample(d, "event_type", 101, ["event_id"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'")


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.ks_distance(*_halves(spark, sf_dir), "value").select(F.round("ks", 9).alias("ks"))


def wasserstein_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.wasserstein(*_halves(spark, sf_dir), "user_id").select(F.round("wasserstein", 6).alias("wasserstein"))


def js_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.js_distance(*_halves(spark, sf_dir), "event_type").select(F.round("js", 9).alias("js"))


def chi_square_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chi_square(*_halves(spark, sf_dir), "event_type").select(F.round("chi_square", 6).alias("chi_square"), "degrees")


def drifted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    d = monitor.ks_distance(a, b, "value").select(F.lit("value").alias("column"), F.col("ks").alias("distance")).unionByName(monitor.ks_distance(a, b, "event_id").select(F.lit("event_id").alias("column"), F.col("ks").alias("distance")))
    return monitor.drift_summary(d, 0.5)


def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over the latest 60 events of each type, at 60 events and then at each 30 more."""
    r = monitor.rolling_report(_events(spark, sf_dir), "event_type", ["ts", "event_id"], 60, 30)
    return r.groupBy("event_type", "report").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.avg("value"), 6).alias("mean_value"))


def positive_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.round(monitor.positive_probability("predicted", "probability"), 6).alias("p"))


def prediction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("model", "predicted").agg(F.count("*").alias("n"))


def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.histogram(_events(spark, sf_dir), "probability", [0.55, 0.7, 0.85, 1.0], ["model"])


def error_share_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.share_alert(_events(spark, sf_dir), "ts", F.col("event_type") == "error", 0.25, "6 hours", "1 hour").withColumn("share", F.round("share", 9))


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = monitor.latency_quantiles(_events(spark, sf_dir), "ts", "value", "1 day", 50.0)
    return q.select("window_start", *(F.round(c, 6).alias(c) for c in q.columns[1:]))


def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.request_rate(_events(spark, sf_dir), "ts", ["model"], "6 hours", 21600).withColumn("per_second", F.round("per_second", 9))


def silent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.silent_windows(_events(spark, sf_dir), "ts", "15 minutes")


def one_class_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.one_class(_events(spark, sf_dir), "ts", "model", "predicted", 50, "1 day")


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.low_confidence(_events(spark, sf_dir), "ts", "probability", 0.72, "3 hours", ["model"]).withColumn("mean", F.round("mean", 6))


def hold_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the error share has been above 19 percent for three days in a row."""
    d = monitor.windows(_events(spark, sf_dir), "ts", "1 day").groupBy("window_start").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"))
    return monitor.held(d, "window_start", F.col("share") > 0.19, 3).select("window_start", F.round("share", 9).alias("share"), F.col("held").cast("long").alias("held"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.reference_hash(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        soft_vote, rule_cross_check, hard_vote_accuracy, failure_report, group_folds, class_weights, split_groups, pr_curve, average_precision, threshold_f1, binary_quality, weighted_metrics, class_metrics, confusion,
        fold_summary, error_buckets, top_missed_sources, candidate_selection, promotion, hash_split, stratified_sample, ks_drift, wasserstein_drift, js_drift, chi_square_drift, drifted_columns, rolling_window,
        positive_probability, prediction_counters, probability_histogram, error_share_alert, latency_quantiles, request_rate, silent_windows, one_class_models, low_confidence, hold_period, content_hash,
    )
}

_S = """s AS (SELECT doc_id, source, lang, CAST(quality AS INTEGER) AS label, toxic, round((doc_id * 37 % 61) / 100.0 + quality * 0.35, 2)::DOUBLE AS score,
    CAST(round((doc_id * 37 % 61) / 100.0 + quality * 0.35, 2) >= 0.5 AS INTEGER) AS prediction FROM labels JOIN documents USING (doc_id))"""
_E = """e AS (SELECT event_id, ts, user_id, event_type, value, 'm' || user_id % 3 AS model, CAST(CASE WHEN user_id % 3 = 2 THEN 1 ELSE event_id % 2 END AS INTEGER) AS predicted, (event_id * 13 % 50 + 50) / 100.0::DOUBLE AS probability FROM events)"""
_VOTE = """w AS (SELECT CAST(user_id % 200 AS VARCHAR) AS table_name, event_id, [event_id * 3 % 11 + 1, event_id * 5 % 13 + 1, event_id * 7 % 17 + 1, event_id * 11 % 19 + 1] AS w FROM events WHERE event_id % 7 <> 0),
    x AS (SELECT table_name, event_id, unnest(range(4)) AS class, unnest(w) / list_sum(w)::DOUBLE AS p FROM w), y AS (SELECT * FROM x WHERE NOT (event_id % 5 = 0 AND class = 3)),
    m AS (SELECT table_name, class, avg(p) AS p FROM y GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY round(p, 12) DESC, class) AS k FROM m),
    c AS (SELECT table_name, count(DISTINCT event_id) AS n_columns FROM y GROUP BY 1), v AS (SELECT table_name, round_even(p, 4) AS confidence, n_columns, CAST(class AS INTEGER) AS prediction, class = 3 AS normalized FROM r JOIN c USING (table_name) WHERE k = 1)"""
_CURVE = """a AS (SELECT lang, score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT *, sum(pos) OVER u AS tp, sum(n) OVER u AS predicted, sum(pos) OVER (PARTITION BY lang) AS positives FROM a WINDOW u AS (PARTITION BY lang ORDER BY score DESC)),
    c AS (SELECT lang, score, pos, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, CAST(positives AS BIGINT) AS positives, tp / predicted::DOUBLE AS precision, coalesce(tp / nullif(positives, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(predicted + positives, 0)::DOUBLE, 0) AS f1 FROM b)"""
_BIN = "count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)"
_FOLDS = """g AS (SELECT source, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1), t AS (SELECT source, (row_number() OVER (ORDER BY pos DESC, n DESC, md5(source)) - 1) % 10 AS t FROM g),
    f AS (SELECT s.*, CAST(CASE WHEN t < 5 THEN t ELSE 9 - t END AS INTEGER) AS fold FROM s JOIN t USING (source))"""
_CLS = """k AS (SELECT doc_id, lang AS label, (['de', 'en', 'es', 'fr'])[(list_position(['de', 'en', 'es', 'fr'], lang) - 1 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 4 + 1] AS prediction FROM documents),
    pc AS (SELECT c AS class, (SELECT count(*) FROM k WHERE label = c) AS support, (SELECT count(*) FROM k WHERE prediction = c) AS predicted, (SELECT count(*) FROM k WHERE label = c AND prediction = c) AS tp FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS c)),
    pm AS (SELECT class, support, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM pc)"""
_HALF = "r AS (SELECT * FROM events WHERE ts < '2024-01-16'), c AS (SELECT * FROM events WHERE ts >= '2024-01-16')"


def _cdf(x: str, n: str = "") -> str:
    return f"""v{n} AS (SELECT {x} AS x, 1 AS r, 0 AS c FROM r UNION ALL SELECT {x}, 0, 1 FROM c), g{n} AS (SELECT x, sum(r) AS r, sum(c) AS c FROM v{n} GROUP BY x),
        d{n} AS (SELECT x, abs(sum(r) OVER u / (SELECT sum(r) FROM g{n})::DOUBLE - sum(c) OVER u / (SELECT sum(c) FROM g{n})::DOUBLE) AS gap, lead(x) OVER (ORDER BY x) - x AS step FROM g{n} WINDOW u AS (ORDER BY x))"""


_SHARES = "p AS (SELECT coalesce(a.t, b.t) AS t, coalesce(a.n, 0) AS rn, coalesce(b.n, 0) AS cn FROM (SELECT event_type AS t, count(*) AS n FROM r GROUP BY 1) a FULL JOIN (SELECT event_type AS t, count(*) AS n FROM c GROUP BY 1) b ON a.t = b.t), q AS (SELECT *, rn / sum(rn) OVER ()::DOUBLE AS p, cn / sum(cn) OVER ()::DOUBLE AS q, sum(cn) OVER () AS nc FROM p)"

ORACLE_SQL = {
    "soft_vote": f"WITH {_VOTE} SELECT * FROM v",
    "rule_cross_check": f"""WITH {_VOTE}, u AS (SELECT CAST(user_id % 200 AS VARCHAR) AS table_name, count(*) AS n FROM events GROUP BY 1),
        z AS (SELECT v.table_name, prediction, CAST(table_name::INT % 4 AS INTEGER) AS rule_normal_form, CASE WHEN table_name::INT % 10 = 0 THEN 29 ELSE n END AS rows FROM v JOIN u USING (table_name))
        SELECT table_name, prediction, rule_normal_form, rule_normal_form = prediction AS rule_agrees, rule_normal_form <> prediction OR rows < 30 AS needs_review,
               concat_ws('; ', CASE WHEN rule_normal_form <> prediction THEN 'rule says ' || rule_normal_form END, CASE WHEN rows < 30 THEN 'few rows' END, CASE WHEN table_name::INT % 3 = 0 THEN 'constant: a,b' END) AS review_reason FROM z""",
    "hard_vote_accuracy": f"""WITH {_S}, v AS (SELECT source, CASE WHEN 2 * sum(prediction) > count(*) THEN 1 ELSE 0 END AS vote, CASE WHEN 2 * sum(label) > count(*) THEN 1 ELSE 0 END AS truth FROM s GROUP BY 1)
        SELECT count(*) AS n, avg(CAST(vote = truth AS DOUBLE)) AS accuracy FROM v""",
    "failure_report": """WITH f AS (SELECT CASE event_id % 4 WHEN 0 THEN 'missing model' WHEN 2 THEN 'missing alias' ELSE 'other' END AS kind, event_type FROM events WHERE event_id % 4 <> 1),
        g AS (SELECT kind, count(*) AS n, count(DISTINCT event_type) AS reasons FROM f GROUP BY 1) SELECT kind, n, reasons, CAST(row_number() OVER (ORDER BY n DESC, kind) AS INTEGER) AS rank FROM g""",
    "group_folds": f"WITH {_S}, {_FOLDS} SELECT doc_id, source, fold FROM f",
    "class_weights": f"WITH {_S}, c AS (SELECT label, count(*) AS n FROM s GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 9) AS weight FROM c",
    "split_groups": """WITH RECURSIVE l AS (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09), e AS (SELECT o AS a, p AS b FROM l UNION SELECT p, o FROM l),
        r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""",
    "pr_curve": f"WITH {_S}, {_CURVE} SELECT lang, score, tp, predicted, positives, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM c",
    "average_precision": f"WITH {_S}, {_CURVE} SELECT lang, round(sum(coalesce(pos / nullif(positives, 0)::DOUBLE, 0) * precision), 9) AS average_precision FROM c GROUP BY lang",
    "threshold_f1": f"WITH {_S}, {_CURVE}, z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score DESC) AS k FROM c) SELECT lang, score AS threshold, round(f1, 9) AS f1 FROM z WHERE k = 1",
    "binary_quality": f"""WITH {_S}, z AS (SELECT lang, {_BIN}, avg(-CASE WHEN label = 1 THEN ln(greatest(least(score, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)) END) AS ll FROM s GROUP BY 1)
        SELECT lang, n, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round({_F1}, 9) AS f1, round((n - fp - fn) / n::DOUBLE, 9) AS accuracy, round(ll, 9) AS log_loss FROM z""",
    "weighted_metrics": f"WITH {_CLS} SELECT " + ", ".join(f"round(sum({c} * support) / sum(support), 9) AS weighted_{c}, round(avg({c}), 9) AS macro_{c}" for c in ("precision", "recall", "f1")) + " FROM pm",
    "class_metrics": f"WITH {_CLS} SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pm",
    "confusion": f"WITH {_CLS} SELECT label, prediction, count(*) AS n FROM k GROUP BY 1, 2",
    "fold_summary": f"WITH {_S}, {_FOLDS}, z AS (SELECT fold, {_BIN} FROM f GROUP BY 1), y AS (SELECT {_F1} AS f1 FROM z) SELECT round(avg(f1), 9) AS mean, round(stddev_pop(f1), 9) AS std, round(min(f1), 9) AS min, round(max(f1), 9) AS max FROM y",
    "error_buckets": f"""WITH {_S}, z AS (SELECT *, CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN prediction = 1 THEN 'FP' WHEN label = 1 THEN 'FN' END AS bucket FROM s)
        SELECT bucket, count(*) AS n, round(avg(toxic::DOUBLE), 9) AS toxic_rate, round(avg(CAST(lang = 'en' AS DOUBLE)), 9) AS is_english_rate FROM z WHERE bucket IS NOT NULL GROUP BY 1""",
    "top_missed_sources": f"WITH {_S}, z AS (SELECT source, count(*) AS n FROM s WHERE label = 1 AND prediction = 0 GROUP BY 1), y AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, source) AS INTEGER) AS rank FROM z) SELECT * FROM y WHERE rank <= 10",
    "candidate_selection": f"""WITH {_S}, x AS (SELECT lang, c.candidate, label, CAST(score >= c.candidate AS INTEGER) AS prediction FROM s, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) AS c(candidate)),
        z AS (SELECT lang, candidate, {_BIN} FROM x GROUP BY 1, 2), y AS (SELECT candidate, avg({_F1}) AS mean FROM z GROUP BY 1) SELECT 'quality' AS track, candidate, round(mean, 9) AS mean FROM y ORDER BY mean DESC, candidate LIMIT 1""",
    "promotion": f"""WITH {_S}, z AS (SELECT lang, doc_id % 2 AS side, {_BIN} FROM s GROUP BY 1, 2), y AS (SELECT lang, side, CASE WHEN lang = 'fr' THEN NULL ELSE round({_F1}, 9) END AS metric FROM z),
        d AS (SELECT * FROM y WHERE side = 0 AND lang <> 'es'), p AS (SELECT * FROM y WHERE side = 1 AND lang <> 'de')
        SELECT coalesce(d.lang, p.lang) AS model, CASE WHEN d.lang IS NULL THEN 'no_dev' WHEN p.lang IS NULL THEN 'bootstrap' WHEN d.metric IS NULL OR p.metric IS NULL THEN 'missing_metric' WHEN d.metric >= p.metric THEN 'promote' ELSE 'keep' END AS verdict FROM d FULL JOIN p ON d.lang = p.lang""",
    "hash_split": """WITH h AS (SELECT event_id, user_id, event_type, md5(event_id || '|' || user_id || '|' || event_type) AS h FROM events),
        b AS (SELECT event_id, user_id, event_type, CAST((('0x' || h[1:16])::UHUGEINT % 100 * 16 + ('0x' || h[17:32])::UHUGEINT % 100) % 100 AS INTEGER) AS bucket FROM h) SELECT *, CASE WHEN bucket < 80 THEN 'reference' ELSE 'holdout' END AS split FROM b""",
    "stratified_sample": """WITH n AS (SELECT event_type, greatest(1, round_even(count(*) * 101 / sum(count(*)) OVER ()::DOUBLE, 0)) AS q FROM events GROUP BY 1),
        r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS k FROM events) SELECT event_type, event_id FROM r JOIN n USING (event_type) WHERE k <= q""",
    "ks_drift": f"WITH {_HALF}, {_cdf('value')} SELECT round(max(gap), 9) AS ks FROM d",
    "wasserstein_drift": f"WITH {_HALF}, {_cdf('user_id')} SELECT round(sum(gap * step), 6) AS wasserstein FROM d",
    "js_drift": f"WITH {_HALF}, {_SHARES} SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 9) AS js FROM q",
    "chi_square_drift": f"WITH {_HALF}, {_SHARES} SELECT round(sum((cn - p * nc) ** 2 / (p * nc)), 6) AS chi_square, count(*) - 1 AS degrees FROM q WHERE p > 0",
    "drifted_columns": f"""WITH {_HALF}, {_cdf("value")}, {_cdf("event_id", "2")},
        z AS (SELECT max(gap) AS x FROM d UNION ALL SELECT max(gap) FROM d2) SELECT count(*) FILTER (x >= 0.5) AS drifted_columns_count, count(*) FILTER (x >= 0.5) / count(*)::DOUBLE AS drifted_columns_share FROM z""",
    "rolling_window": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events),
        r AS (SELECT n.*, k AS report FROM n, range(100000) AS t(k) WHERE k * 30 < n AND n <= k * 30 + 60 AND k * 30 + 60 <= total AND k <= n / 30) SELECT event_type, report, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(avg(value), 6) AS mean_value FROM r GROUP BY 1, 2""",
    "positive_probability": f"WITH {_E} SELECT event_id, round(CASE WHEN predicted = 1 THEN probability ELSE 1 - probability END, 6) AS p FROM e",
    "prediction_counters": f"WITH {_E} SELECT model, predicted, count(*) AS n FROM e GROUP BY 1, 2",
    "probability_histogram": f"WITH {_E} SELECT model, le, count(*) FILTER (probability <= le) AS n FROM e, (VALUES (0.55::DOUBLE), (0.7::DOUBLE), (0.85::DOUBLE), (1.0::DOUBLE)) AS b(le) GROUP BY 1, 2",
    "error_share_alert": """WITH w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(i AS BIGINT)) AS window_start, event_type FROM events, range(6) AS t(i)), g AS (SELECT window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM w GROUP BY 1)
        SELECT window_start, n, bad, round(bad / n::DOUBLE, 9) AS share FROM g WHERE bad / n::DOUBLE > 0.25""",
    "latency_quantiles": "SELECT date_trunc('day', ts) AS window_start, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(CAST(value <= 50 AS DOUBLE)), 6) AS within_limit, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "request_rate": f"WITH {_E} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, model, round(count(*) / 21600.0::DOUBLE, 9) AS per_second FROM e GROUP BY 1, 2",
    "silent_windows": """WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS w FROM events), a AS (SELECT unnest(generate_series((SELECT min(w) FROM s), (SELECT max(w) FROM s), INTERVAL 15 MINUTE)) AS w) SELECT w AS window_start FROM a WHERE w NOT IN (SELECT w FROM s)""",
    "one_class_models": f"WITH {_E} SELECT date_trunc('day', ts) AS window_start, model, count(*) AS n, count(DISTINCT predicted) AS classes FROM e GROUP BY 1, 2 HAVING count(DISTINCT predicted) = 1 AND count(*) > 50",
    "low_confidence": f"WITH {_E} SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, model, round(avg(probability), 6) AS mean FROM e GROUP BY 1, 2 HAVING avg(probability) < 0.72",
    "hold_period": """WITH d AS (SELECT date_trunc('day', ts) AS w, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS share FROM events GROUP BY 1), c AS (SELECT *, share > 0.19 AS c FROM d), i AS (SELECT *, row_number() OVER (ORDER BY w) - sum(c::INT) OVER (ORDER BY w) AS g FROM c),
        h AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w) AS held FROM i WHERE c) SELECT w AS window_start, round(share, 9) AS share, held FROM h WHERE held >= 3""",
}
