"""Queries of the normal-form model's features and training set, served models and their monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import atomicity, dependencies, evaluation, fd_algebra, features, monitor, quality, recipes, training
from tablewright.plans.dependency_queries import _CN, _HANDLING, CUSTOMER_NATION, HANDLING, _counts, _customer_nation, _fd_sql, _handling
from tablewright.plans.manifest_queries import ORACLE_SQL as MANIFEST_SQL
from tablewright.plans.manifest_queries import USE, _use
from tablewright.plans.model_queries import _labelled
from tablewright.plans.run_queries import _events
from tablewright.plans.star import star
from tablewright.sources.ledger import new_ledger
from tablewright.streaming import feeds, reports


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in df.schema))


def normal_form_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature frame of customers with their nation folded in."""
    return _rounded(features.build_features(_customer_nation(spark, sf_dir), "customer_nation"))


def normal_form_features_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature frame of orders with a code that two columns determine together."""
    return _rounded(features.build_features(_handling(spark, sf_dir), "handling"))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and derived labels of three joins over whole tables, one renamed, and of an injected list."""
    specs = recipes.build_specs(star(spark, sf_dir), [None])
    chosen = [s for s in specs if (s.params["recipe"], s.params["naming"]) in (("customer_in_nation", "real"), ("supplier_in_nation", "obfuscated"), ("orders_coded", "real")) or (s.params["recipe"], s.params["kind"], s.params["naming"]) == ("list_orders_orderpriority", "injection", "real")]
    manifest = fd_algebra.manifest_rows(recipes.spec_manifest(spark, chosen))
    return features.training_set({s.table_name: s.relation.build() for s in chosen}, manifest)


def join_ladder_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order and that order's customer folded in."""
    t = star(spark, sf_dir, ["lineitem", "orders", "customer"])
    r = next(r for r in recipes.JOIN_RECIPES if r.name == "lines_of_customer")
    return recipes.joined_relation(t, r).build().groupBy("order_customer_mktsegment", "order_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.count_distinct("order_custkey").alias("customers"))


def discovered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what the data show changes the label that a declared key alone gives."""
    manifests, found = [], []
    for name, df, key in (("customer_nation", _customer_nation(spark, sf_dir), ["custkey"]), ("priority_use", _use(spark, sf_dir).select(USE), ["custkey", "orderpriority"])):
        rest = [c for c in df.columns if c not in key]
        manifests.append((name, df.columns, [(key, rest)], False))
        stats, pairs, _ = dependencies.table_statistics(df, name)
        found.append(dependencies._directed(stats, pairs).where("n_pair = n_lhs and n_rhs > 1").select("table_name", F.array("lhs").alias("lhs"), "rhs"))
    m = spark.createDataFrame(manifests, "rel_id string, attributes array<string>, fds array<struct<lhs: array<string>, rhs: array<string>>>, violates_1nf boolean")
    return quality.label_against_discovered(m, found[0].union(found[1])).drop("reason")


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the columns of lines, with whether they were returned."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("returned", F.col("l_returnflag") == "R").withColumn("is_first", (F.col("l_linenumber") == 1).cast("int"))
    return monitor.infer_column_roles(li, skip=["l_shipdate"])


def classification_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts over the latest events of each model, from the stream; an event's target is whether its value is high."""
    s = feeds.event_stream(spark, sf_dir)
    s = s.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("track"), "ts", "event_id", (F.col("value") > 60).cast("int").alias("target"), F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 2)).cast("int").alias("prediction"))
    return reports.classification_reports(s, new_ledger(spark))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a forest, learned from the reference split, on a replayed holdout."""
    d = monitor.hash_split(_labelled(spark, sf_dir), ["doc_id"], 80)
    names = ["n_chars", "n_words", "n_symbols", "n_capitals", "mean_length"]
    m = training.feature_matrix(d, names, "quality", ["doc_id", "split"])
    model = training.candidates()["forest"].fit(m.where("split = 'reference'"))

    def score(rows: DataFrame) -> DataFrame:
        got = model.transform(rows)
        p = training.vector_to_array("probability")
        return got.withColumn("prediction", F.col("prediction").cast("int")).withColumn("probability", F.array_max(p))

    out = monitor.backtest(m.where("split = 'holdout'").withColumn("label", F.col("label").cast("int")), score, "label", ["doc_id"], 2000)
    return out.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in out.schema))


def text_model_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of a text classifier's languages, each against the rest, on documents that it has not seen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null").select("doc_id", "text", "lang")
    d = monitor.hash_split(docs, ["doc_id"], 50)
    model = training.text_classifier("text", "lang").fit(d.where("split = 'reference'"))
    classes = [*model.stages[4].labels]
    got = training.scored(model, d.where("split = 'holdout'"), [*classes, "unknown"], ["doc_id", "lang"])
    out = evaluation.one_vs_rest_precision(got, classes, "lang")
    return out.select("class", F.round("average_precision", 6).alias("average_precision"), "support")


def model_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources voted on by a model's distributions over their documents, checked against a rule: scores, votes and cross-check in one."""
    d = _labelled(spark, sf_dir)
    m = training.feature_matrix(d, ["n_chars", "n_words", "n_symbols", "n_capitals", "mean_length"], "quality", ["source", "n_symbols"])
    got = training.candidates()["forest"].fit(m).transform(m).withColumn("p", training.vector_to_array("probability"))
    votes = evaluation.soft_vote(got.select(F.col("source").alias("table_name"), F.map_from_arrays(F.array(F.lit("0"), F.lit("1")), "p").alias("probabilities")))
    rules = d.groupBy(F.col("source").alias("table_name")).agg((F.avg("n_symbols") < 0.2).cast("int").alias("rule_normal_form"), F.count("*").alias("row_count"), F.array().cast("array<string>").alias("constant_columns"))
    return evaluation.rule_cross_check(votes, rules).select("table_name", "prediction", "n_columns", "rule_normal_form", "rule_agrees", "needs_review")


def served_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model's version in service (its month) the latest day's accuracy."""
    e = _events(spark, sf_dir).withColumn("version", F.date_format("ts", "yyyy-MM")).withColumn("right", (F.col("predicted") == (F.col("value") > 60).cast("int")).cast("double"))
    runs = e.groupBy("model", "version", F.to_date("ts").alias("run_at")).agg(F.concat(F.lit("estimator "), F.min("event_type")).alias("estimator"), F.round(F.avg("right"), 9).alias("metric"))
    served = e.groupBy("model").agg(F.max("version").alias("version")).union(e.where("false").select("model", "version"))
    return monitor.served_quality(served, runs).withColumn("run_at", F.col("run_at").cast("string"))


def gauge_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours whose peak value has been above 90 for three hours in a row, by model."""
    return monitor.gauge_alert(_events(spark, sf_dir), "ts", "value", 90.0, "1 hour", 3, ["model"]).select("window_start", "model", "peak", F.col("held").cast("long").alias("held"))


def target_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a type of event is not seen."""
    return monitor.target_down(_events(spark, sf_dir), "ts", "1 hour", ["event_type"]).select("window_start", "event_type")


def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a model has more than one error in 30 minutes."""
    d = monitor.error_rate(_events(spark, sf_dir), "ts", ["model", "event_type"], F.col("event_type") == "error", "1 hour", 3600, 2 / 3600)
    return d.withColumn("per_second", F.round("per_second", 9))


QUERIES = {
    f.__name__: f
    for f in (
        normal_form_features, normal_form_features_pairs, training_set, join_ladder_whole, discovered_labels, column_roles, classification_windows, backtest, text_model_precision,
        model_votes, served_quality, gauge_alert, target_down, error_rate,
    )
}


def _features_sql(table: str, rel: str, columns: dict[str, str]) -> str:
    """The feature frame of a table that is not sampled and has no numbered columns."""
    c, n = list(columns), len(columns)
    shapes = " UNION ALL ".join(
        f"SELECT '{x}' AS c, {i} AS o, '{t}' AS t, count({x}) AS nn, " + (
            f"coalesce(count(CASE WHEN regexp_matches({x}, '{atomicity.LIST_LIKE}') THEN 1 END) / nullif(count({x}), 0)::DOUBLE, 0.0) AS l, coalesce(avg(length({x})), 0.0) AS m, coalesce(avg(length({x}) - length(regexp_replace({x}, '[,;|]', '', 'g'))), 0.0) AS p"
            if t == "varchar" else "0.0::DOUBLE AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS p") + " FROM rel"
        for i, (x, t) in enumerate(columns.items(), 1)
    )
    position = f"list_sort(list_transform(cols, lambda x: list_position({c}, x)))"
    card = "list_product(list_transform(cols, lambda x: greatest(m[x], 1)::DOUBLE))"
    single = lambda keys: f"part AS (SELECT f.*, EXISTS (SELECT 1 FROM {keys} k WHERE len(k.cols) > 1 AND list_contains(k.cols, lhs)) AS part, EXISTS (SELECT 1 FROM {keys} k WHERE k.cols = [lhs]) AS holds, EXISTS (SELECT 1 FROM {keys} k WHERE list_contains(k.cols, rhs)) AS prime FROM f)"
    tally = lambda keys: f"(WITH {single(keys)} SELECT count(*) AS n, count(*) FILTER (part AND NOT holds) AS p, count(*) FILTER (NOT part AND NOT holds) AS t, count(*) FILTER (part AND NOT holds AND NOT prime) AS sp, count(*) FILTER (NOT part AND NOT holds AND NOT prime) AS st FROM part)"
    pairs = n * (n - 1)
    long = lambda x, name: f"CAST({x} AS BIGINT) AS {name}"
    real = lambda x, name: f"round(CAST({x} AS DOUBLE), 9) AS {name}"
    return f"""WITH {_fd_sql(rel, c).replace(_counts(c, (1, 2)), _counts(c, (1, 2, 3)))}, mm AS (SELECT map(list(c), list(n)) AS m FROM s), sh AS ({shapes}),
        el AS (SELECT *, m / (p + 1) AS tok, l >= 0.8 AND m / (p + 1) <= 20 AND c NOT LIKE '%comment%' AS na, m / (p + 1) <= 20 AND NOT (l >= 0.8 AND c NOT LIKE '%comment%') AS ok FROM sh),
        ek AS (SELECT list(c) FILTER (ok) AS e FROM el),
        u AS (SELECT cols, rows, {card} AS card, len(list_filter(cols, lambda x: m[x] / rows::DOUBLE >= 0.9)) > 0 AS near FROM n, r, mm, ek WHERE n = rows AND rows > 0 AND list_has_all(e, cols)),
        uo AS (SELECT * FROM u WHERE len(cols) = 1 OR (NOT near AND card >= rows)), k AS (SELECT * FROM uo a WHERE NOT EXISTS (SELECT 1 FROM uo b WHERE len(b.cols) < len(a.cols) AND list_has_all(a.cols, b.cols))),
        ku AS (SELECT cols, row_number() OVER (ORDER BY rows::DOUBLE * rows / (2 * card) DESC, {position}) AS rank FROM k), best AS (SELECT * FROM ku WHERE rank = 1),
        f AS (SELECT lhs, rhs FROM d WHERE n_pair = n_lhs AND n_rhs > 1 AND n_lhs / rows::DOUBLE < 0.9),
        nf AS (SELECT n_lhs / n_pair::DOUBLE AS strength FROM d WHERE n_lhs / n_pair::DOUBLE >= 0.95 AND n_lhs < n_pair AND n_rhs > 1 AND n_lhs / rows::DOUBLE < 0.9),
        nk AS (SELECT cols FROM n, r, ek WHERE len(cols) <= 2 AND n >= 0.99 * rows AND n < rows AND list_has_all(e, cols)),
        nu AS (SELECT cols FROM nk a WHERE len(cols) = 1 OR NOT EXISTS (SELECT 1 FROM nk b WHERE len(b.cols) = 1 AND list_contains(a.cols, b.cols[1]))),
        pc AS (SELECT p.cols, p.n, s.c FROM (SELECT cols, n FROM n, r, ek WHERE len(cols) = 2 AND rows - n >= 10 AND list_has_all(e, cols)) p, s WHERE NOT list_contains(p.cols, s.c) AND s.n > 1 AND s.n <= p.n
               AND NOT EXISTS (SELECT 1 FROM d WHERE list_contains(p.cols, d.lhs) AND d.rhs = s.c AND (d.n_pair = d.n_lhs OR d.n_pair > p.n))),
        pf AS (SELECT pc.cols AS lhs, pc.c AS rhs FROM pc JOIN n t ON t.cols = list_sort(list_append(pc.cols, pc.c)) AND t.n = pc.n),
        pp AS (SELECT count(*) AS n, count(*) FILTER (part AND NOT holds) AS p, count(*) FILTER (NOT part AND NOT holds) AS t FROM (SELECT EXISTS (SELECT 1 FROM ku WHERE len(cols) > 2 AND list_has_all(cols, lhs)) AS part, EXISTS (SELECT 1 FROM ku WHERE list_has_all(lhs, cols)) AS holds FROM pf)),
        b AS {tally("best")}, a AS {tally("ku")},
        kk AS (SELECT count(*) AS n, count(*) FILTER (len(cols) > 1) AS c, coalesce(max(len(cols)) FILTER (rank = 1), 0) AS size FROM ku), ee AS (SELECT count(*) FILTER (na) AS na, max(l) AS l FROM el),
        cc AS (SELECT count(*) FILTER (n <= 1) AS n FROM s), nn AS (SELECT count(*) AS n, coalesce(max(strength), 0.0) AS m FROM nf), ni AS (SELECT count(*) AS n FROM nu)
        SELECT 'lake' AS database, 'star' AS schema, '{table}' AS table_name, el.c AS column_name, el.t AS column_type, {long("o", "ordinal_position")}, {real("s.n / rows", "col_unique_ratio")}, {real("1 - nn / rows", "col_null_ratio").replace("nn /", "el.nn /")},
        {real("el.l", "col_list_like_ratio")}, {real("tok", "col_mean_token_length")}, {real("el.p + 1", "col_mean_token_count")}, {real("CASE WHEN el.m > 0 THEN el.p / el.m ELSE 0 END", "col_separator_density")}, {long("el.c LIKE '%comment%'", "col_is_freetext_name")},
        {long("el.na", "col_violates_1nf")}, {long("0", "col_in_repeating_group")}, {long("EXISTS (SELECT 1 FROM ku WHERE list_contains(cols, el.c))", "col_in_candidate_key")}, {long("EXISTS (SELECT 1 FROM best WHERE list_contains(cols, el.c))", "col_is_prime")},
        {long("(SELECT count(*) FROM f WHERE lhs = el.c)", "col_determines_count")}, {long("(SELECT count(*) FROM f WHERE rhs = el.c)", "col_depends_on_count")}, {long("rows", "table_row_count")}, {long("0", "table_sampled")}, {real("1", "table_sample_ratio")},
        {long("0", "table_search_truncated")}, {real("1", "table_pair_coverage")}, {real("1", "table_ucc_search_coverage")}, {real("1", "table_pair_fd_search_coverage")}, {long(n, "table_column_count")}, {real("ee.l", "table_max_list_like_ratio")},
        {real(f"ee.na / {n}", "table_ratio_list_like_columns")}, {real("0", "table_repeating_group_ratio")}, {real(f"cc.n / {n}", "table_constant_column_ratio")}, {long("kk.n = 0", "table_has_no_ucc_le3")}, {long("kk.n", "table_candidate_key_count")}, {long("kk.size", "table_key_size")},
        {long("kk.c", "table_composite_key_count")}, {real(f"kk.size / {n}", "table_prime_ratio")}, {long("b.n", "table_fd_count")}, {real(f"b.n / {pairs}", "table_fd_ratio")}, {long("b.p", "table_partial_fd_count")}, {real(f"b.p / {pairs}", "table_partial_fd_ratio")},
        {long("b.t", "table_transitive_fd_count")}, {real(f"b.t / {pairs}", "table_transitive_fd_ratio")}, {long("b.sp", "table_strict_partial_fd_count")}, {long("b.st", "table_strict_transitive_fd_count")}, {long("nn.n", "table_near_fd_count")}, {real(f"nn.n / {pairs}", "table_near_fd_ratio")},
        {real("nn.m", "table_max_near_fd_strength")}, {long("ni.n", "table_near_ucc_count")}, {long("ni.n > 0 AND kk.n = 0", "table_has_near_key_but_no_key")}, {long("a.p", "table_partial_fd_count_anykey")}, {long("a.t", "table_transitive_fd_count_anykey")},
        {long("pp.n", "table_pair_fd_count")}, {long("pp.p", "table_pair_partial_fd_count")}, {long("pp.t", "table_pair_transitive_fd_count")}
        FROM el JOIN s ON s.c = el.c, r, b, a, kk, ee, cc, nn, ni, pp"""


_CN_TYPES = dict(zip(CUSTOMER_NATION, ("bigint", "double", "varchar", "integer", "varchar", "integer"), strict=True))
_HANDLING_TYPES = dict(zip(HANDLING, ("bigint", "varchar", "varchar", "varchar"), strict=True))
_EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, 'm' || (user_id % 3) AS model, CASE WHEN user_id % 3 = 2 THEN 1 ELSE event_id % 2 END AS predicted FROM events)"
_ROLES = {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0}
_LABELLED_EVENTS = """e AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS track, ts, event_id, CAST(value > 60 AS INT) AS target, CASE WHEN event_id % 11 > 0 THEN event_id % 2 END AS prediction FROM events)"""

ORACLE_SQL = {
    "classification_windows": f"""
        WITH RECURSIVE {_LABELLED_EVENTS}, n AS (SELECT *, row_number() OVER w AS n, sum(target) OVER (w ROWS 59 PRECEDING) AS ones FROM e WHERE target IS NOT NULL AND prediction IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY ts, event_id)),
        g AS (SELECT *, min(CASE WHEN n >= 60 AND ones BETWEEN 1 AND 59 THEN n END) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS upcoming FROM n),
        r AS (SELECT track, 0 AS report, upcoming AS at FROM g WHERE n = 60 AND upcoming IS NOT NULL UNION ALL SELECT g.track, r.report + 1, g.upcoming FROM r JOIN g ON g.track = r.track AND g.n = r.at + 30 WHERE g.upcoming IS NOT NULL)
        SELECT r.track, CAST(r.report AS BIGINT) AS report, min(event_id) AS first, max(event_id) AS last, count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) FILTER (target = 0 AND prediction = 1) AS fp,
               count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (target = 0 AND prediction = 0) AS tn
        FROM r JOIN n ON n.track = r.track AND n.n > r.at - 60 AND n.n <= r.at GROUP BY 1, 2""",
    "normal_form_features": _features_sql("customer_nation", _CN, _CN_TYPES),
    "normal_form_features_pairs": _features_sql("handling", _HANDLING, _HANDLING_TYPES),
    "join_ladder_whole": """SELECT c_mktsegment AS order_customer_mktsegment, o_orderstatus AS order_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(DISTINCT o_custkey) AS customers
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "discovered_labels": f"SELECT rel_id, 3::INTEGER AS declared_form, normal_form AS discovered_form, normal_form <> 3 AS changes FROM ({MANIFEST_SQL['normal_form_labels']})",
    "column_roles": " UNION ALL ".join(f"SELECT '{c}' AS column_name, " + (f"CASE WHEN count(DISTINCT {c}) <= 2 THEN 'categorical' ELSE 'numerical' END AS role FROM lineitem" if k else "'skipped' AS role") for c, k in _ROLES.items())
        + " UNION ALL SELECT 'returned', 'categorical' UNION ALL SELECT 'is_first', 'categorical'",
    "served_quality": f"""WITH {_EVENTS}, v AS (SELECT *, strftime(ts, '%Y-%m') AS version, CAST(predicted = CAST(value > 60 AS INT) AS DOUBLE) AS ok FROM e),
        r AS (SELECT model, version, CAST(ts AS DATE) AS run_at, 'estimator ' || min(event_type) AS estimator, round(avg(ok), 9) AS metric FROM v GROUP BY ALL), s AS (SELECT model, max(version) AS version FROM v GROUP BY model)
        SELECT model, version, estimator, metric, CAST(run_at AS VARCHAR) AS run_at FROM (SELECT r.*, row_number() OVER (PARTITION BY model ORDER BY run_at DESC) AS k FROM r JOIN s USING (model, version)) WHERE k = 1""",
    "gauge_alert": f"""WITH {_EVENTS}, w AS (SELECT date_trunc('hour', ts) AS window_start, model, max(value) AS peak FROM e GROUP BY ALL), i AS (SELECT *, row_number() OVER o - sum(CAST(peak > 90 AS INT)) OVER o AS g FROM w WINDOW o AS (PARTITION BY model ORDER BY window_start)),
        h AS (SELECT *, row_number() OVER (PARTITION BY model, g ORDER BY window_start) AS held FROM i WHERE peak > 90) SELECT window_start, model, peak, held FROM h WHERE held >= 3""",
    "target_down": """WITH w AS (SELECT DISTINCT date_trunc('hour', ts) AS window_start, event_type FROM events), h AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 1 HOUR)) AS window_start FROM w)
        SELECT h.window_start, t.event_type FROM h, (SELECT DISTINCT event_type FROM w) t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.window_start = h.window_start AND w.event_type = t.event_type)""",
    "error_rate": f"WITH {_EVENTS} SELECT date_trunc('hour', ts) AS window_start, model, event_type, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM e WHERE event_type = 'error' GROUP BY ALL HAVING count(*) / 3600.0::DOUBLE > 2 / 3600.0::DOUBLE",
}
