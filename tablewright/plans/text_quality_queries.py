"""Queries of subject areas and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import quality, text
from tablewright.plans import dependency_queries, profile_queries, run_queries
from tablewright.plans.star import columns_sql, features_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.table_documents(profile_queries.discover(spark, sf_dir))


def tfidf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of the words of part names and types, for words of two parts or more."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return text.tf_idf(p, "p_partkey", text.words(F.concat_ws(" ", "p_name", "p_type")), min_df=2).withColumn("weight", F.round("weight", 9))


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest word of each document."""
    w = text.tf_idf(_docs(spark, sf_dir), "doc_id", text.words(F.col("text")), min_df=2).withColumn("weight", F.round("weight", 9))
    return w.groupBy("doc_id").agg(F.max("weight").alias("weight"), F.count("*").alias("terms"))


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-grams of part names, counted."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.explode(text.char_ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def ctfidf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each language's documents."""
    return text.topic_keywords(_docs(spark, sf_dir), "lang", text.words(F.col("text"))).select("lang", "term", "rank")


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from a cache that knows the keywords of English and French alone."""
    k = text.topic_keywords(_docs(spark, sf_dir), "lang", text.words(F.col("text")))
    cache = text.label_lookup(k.where("lang in ('en', 'fr')"), spark.createDataFrame([], "keyword_key string, label string"), "lang").select("keyword_key", F.concat(F.lit("area "), "lang").alias("label"))
    return text.label_lookup(k, cache, "lang").select("lang", "label")


def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned first lines of the documents, taken as labels that a model might have written."""
    raw = F.concat(F.lit("Label: \""), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.clean_label(raw).alias("label"))


def supervised_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("area", F.when(F.col("doc_id") % 11 == 0, "outlier").otherwise(F.concat("source", F.lit(" "), "lang")))
    return text.supervised_set(d, "area").select("doc_id", "area")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.stratified_split(_docs(spark, sf_dir), "lang", ["doc_id", "source"]).select("doc_id", "lang", "split")


def dq_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_queries.profile_columns_star(spark, sf_dir)
    return quality.count_violations(p, quality.domain_rules(["is_unique", "is_non_null"], ["unique_ratio", "null_ratio"], ["ordinal_position"], ["count"]))


def dq_line_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that lines break: discounts over 5 percent, quantities under 1 and line numbers over 4."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.count_violations(li, {"discount": ~F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") < 1, "line": F.col("l_linenumber") > 4})


def dq_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr("if(o_orderstatus = 'O', null, o_orderpriority)").alias("priority"), F.expr("if(o_totalprice > 250000, null, o_custkey)").alias("buyer"))
    return quality.null_shares(o, ["o_orderkey", "priority", "buyer"], {"o_orderkey": 0.0, "priority": 0.2, "buyer": 0.9}).withColumn("null_share", F.round("null_share", 9))


def dq_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_balance(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality").withColumn("share", F.round("share", 9))


def dq_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_violations(profile_queries.profile_columns_star(spark, sf_dir), quality.consistency_rules())


def dq_group_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines should agree on their supplier and flag; and columns of a table on its row count."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.group_constants(li.withColumn("order_parity", F.col("l_orderkey") % 2), ["l_orderkey"], ["l_suppkey", "l_returnflag", "order_parity"])


def dq_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exclusive(spark.read.parquet(f"{sf_dir}/labels.parquet"), [("quality", "toxic")])


def dq_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_sanity(run_queries._scored(spark, sf_dir), "source", "label", 15)


def dq_shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are in two of a careless split's folds."""
    return quality.shared_groups(run_queries._scored(spark, sf_dir).withColumn("fold", F.floor(F.col("doc_id") / 500)), "source", "fold")


FDS = [(["nationkey"], ["nation_name"]), (["nationkey"], ["regionkey"]), (["regionkey"], ["nationkey"]), (["custkey"], ["acctbal", "mktsegment"]), (["mktsegment", "nationkey"], ["acctbal"])]


def verify_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.verify_fds(dependency_queries._customer_nation(spark, sf_dir), "customer_nation", FDS)
    return d.withColumns({c: F.array_join(c, ",") for c in ("lhs", "rhs")})


def decoy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of error-prone users (more than 12 errors) against the truth (over a quarter of their events)."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 100).alias("table_name")).agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return quality.decoy_report(u.select((F.col("e") > 24).alias("fired"), (F.col("e") / F.col("n") > 0.22).alias("truth")), "fired", "truth").select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "passed")


def label_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run_queries._scored(spark, sf_dir).select(F.col("label").alias("normal_form"), F.col("lang").alias("naming"), (F.col("prediction") == 0).alias("visible"))
    return quality.label_noise(d, "naming")


def key_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    uccs = dependency_queries._uccs(dependency_queries._customer_nation(spark, sf_dir), "customer_nation").unionByName(dependency_queries._uccs(dependency_queries._handling(spark, sf_dir), "handling"))
    truth = profile_queries.discover(spark, sf_dir).where("table_name = 'customer' and ordinal_position = 1").select(F.lit("customer_nation").alias("table_name"), F.array("column_name").alias("cols"))
    return quality.key_ranking(uccs, truth)


def no_key_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations without any key of up to three columns."""
    uccs = dependency_queries._uccs(dependency_queries._customer_nation(spark, sf_dir), "customer_nation").unionByName(dependency_queries._uccs(dependency_queries._handling(spark, sf_dir), "handling"))
    return quality.without_key(spark.createDataFrame([("customer_nation",), ("handling",)], "table_name string"), uccs)


def review_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review reasons from profile facts, on a manifest on which all tables had been marked."""
    p = profile_queries.profile_columns_star(spark, sf_dir)
    manifest = p.select("table_name", F.lit(True).alias("needs_review"), F.lit("old").alias("review_reason")).distinct()
    reasons = p.where("table_has_no_single_pk_candidate = 1").select("table_name", F.lit("no single key").alias("reason")).unionByName(p.where("table_row_count < 30").select("table_name", F.lit("few rows").alias("reason")))
    return quality.refresh_review(manifest, reasons).withColumn("review_reason", F.coalesce("review_reason", F.lit("")))


QUERIES = {
    f.__name__: f
    for f in (
        table_documents, tfidf_parts, tfidf_documents, char_ngrams, ctfidf_topics, topic_labels, cleaned_labels, supervised_set, stratified_split, dq_domains, dq_line_domains, dq_nulls, dq_balance, dq_consistency,
        dq_group_constant, dq_exclusive, dq_groups, dq_shared_groups, verify_fds, decoy_report, label_noise, key_ranking, no_key_tables, review_refresh,
    )
}


def _tfidf(source: str, key: str, value: str) -> str:
    return f"""t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({value}), '[a-z]+')) AS term FROM {source}), tf AS (SELECT k, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
        w AS (SELECT k, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {source})) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term)), z AS (SELECT k, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 9) AS weight FROM w)"""


_TOPICS = """t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), tf AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT lang, sum(tf) AS size FROM tf GROUP BY 1), c AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1),
    w AS (SELECT lang, term, round(tf / size::DOUBLE * ln(1 + (SELECT avg(size) FROM s) / total), 9) AS weight FROM tf JOIN s USING (lang) JOIN c USING (term)), r AS (SELECT lang, term, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w)"""
_SC = run_queries._S
_CN, _N = dependency_queries._CN, dependency_queries._counts

ORACLE_SQL = {
    "table_documents": f"WITH c AS ({columns_sql()}), g AS (SELECT database, schema, table_name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns FROM c GROUP BY ALL) SELECT *, replace(table_name, '_', ' ') || ': ' || columns AS description FROM g",
    "tfidf_parts": f"WITH {_tfidf('part', 'p_partkey', chr(112) + '_name || chr(32) || p_type')} SELECT k AS p_partkey, term, weight FROM z",
    "tfidf_documents": f"WITH {_tfidf('documents', 'doc_id', 'text')} SELECT k AS doc_id, max(weight) AS weight, count(*) AS terms FROM z GROUP BY 1",
    "char_ngrams": """WITH w AS (SELECT ' ' || unnest(string_split_regex(lower(p_name), '\\s+')) || ' ' AS p FROM part), n AS (SELECT p, unnest([3, 4, 5]) AS n FROM w WHERE length(p) > 2),
        g AS (SELECT CASE WHEN length(p) <= n THEN p ELSE substr(p, i::INT, n) END AS gram FROM n, range(1, 200) AS t(i) WHERE i <= greatest(length(p) - n + 1, 1)) SELECT gram, count(*) AS n FROM g GROUP BY 1""",
    "ctfidf_topics": f"WITH {_TOPICS} SELECT * FROM r WHERE rank <= 8",
    "topic_labels": "SELECT DISTINCT lang, CASE WHEN lang IN ('en', 'fr') THEN 'area ' || lang ELSE 'topic_' || lang END AS label FROM documents",
    "cleaned_labels": """WITH l AS (SELECT doc_id, trim(string_split(trim('Label: "' || text, ' '), chr(10))[1], ' ') AS t FROM documents), m AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '(?i)^(label|name|topic|subject area)\\s*:\\s*', ''), '["''`*]', '', 'g'), ' ') AS t FROM l)
        SELECT doc_id, array_to_string((string_split_regex(t, '\\s+'))[1:5], ' ') AS label FROM m""",
    "supervised_set": "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'outlier' ELSE source || ' ' || lang END AS area FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY area) AS n FROM a WHERE area <> 'outlier') SELECT doc_id, area FROM n WHERE n >= 4",
    "stratified_split": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|' || source)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM r",
    "dq_domains": "SELECT * FROM (VALUES ('is_unique in 0, 1', 0::BIGINT), ('is_non_null in 0, 1', 0), ('unique_ratio in [0, 1]', 0), ('null_ratio in [0, 1]', 0), ('ordinal_position >= 1', 0), ('count >= 0', 0)) AS v(rule, violations)",
    "dq_line_domains": "SELECT 'discount' AS rule, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) AS violations FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (l_quantity < 1) FROM lineitem UNION ALL SELECT 'line', count(*) FILTER (l_linenumber > 4) FROM lineitem",
    "dq_nulls": """WITH s AS (SELECT 'o_orderkey' AS column_name, 0.0::DOUBLE AS null_share, 0.0::DOUBLE AS most UNION ALL SELECT 'priority', round(avg(CAST(o_orderstatus = 'O' AS DOUBLE)), 9), 0.2 FROM orders UNION ALL SELECT 'buyer', round(avg(CAST(o_totalprice > 250000 AS DOUBLE)), 9), 0.9 FROM orders) SELECT *, null_share <= most AS passed FROM s""",
    "dq_balance": "WITH d AS (SELECT count(*) AS n, avg(quality::DOUBLE) AS share, count(DISTINCT quality) = 2 AS both_classes FROM labels) SELECT n, round(share, 9) AS share, both_classes, both_classes AND share BETWEEN 0.01 AND 0.99 AS passed FROM d",
    "dq_consistency": f"""WITH {features_sql()} SELECT 'unique means ratio 1' AS rule, count(*) FILTER (is_unique = 1 AND count > 0 AND unique_ratio <> 1) AS violations FROM profile UNION ALL SELECT 'ratio 1 without nulls means unique', count(*) FILTER (unique_ratio = 1 AND null_count = 0 AND is_unique = 0) FROM profile
        UNION ALL SELECT 'non-null means ratio 0', count(*) FILTER (is_non_null = 1 AND null_ratio <> 0) FROM profile UNION ALL SELECT 'name_length', count(*) FILTER (name_length <> length(column_name)) FROM profile""",
    "dq_group_constant": "WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_returnflag) AS b FROM lineitem GROUP BY 1) SELECT 'l_suppkey' AS column_name, count(*) FILTER (a > 1) AS violations FROM g UNION ALL SELECT 'l_returnflag', count(*) FILTER (b > 1) FROM g UNION ALL SELECT 'order_parity', 0",
    "dq_exclusive": "SELECT 'quality and toxic' AS rule, count(*) FILTER (quality = 1 AND toxic = 1) AS violations FROM labels",
    "dq_groups": f"WITH {_SC}, g AS (SELECT source, count(*) AS n, count(DISTINCT label) AS c FROM s GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n < 15) AS small_groups, count(*) FILTER (c = 1) AS single_class_groups FROM g",
    "dq_shared_groups": f"WITH {_SC} SELECT source, count(DISTINCT doc_id // 500) AS folds FROM s GROUP BY 1 HAVING count(DISTINCT doc_id // 500) > 1",
    "verify_fds": f"WITH {_CN}, {_N(dependency_queries.CUSTOMER_NATION, (1, 2, 3))} "
    + " UNION ALL ".join(f"SELECT '{','.join(a)}' AS lhs, '{','.join(b)}' AS rhs, x.n AS n_l, y.n AS n_b, x.n = y.n AS holds FROM n x, n y WHERE x.cols = {sorted(a)} AND y.cols = {sorted({*a, *b})}" for a, b in FDS),
    "decoy_report": """WITH u AS (SELECT user_id % 100 AS t, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1), c AS (SELECT count(*) FILTER (e > 24 AND e / n::DOUBLE > 0.22) AS tp, count(*) FILTER (e > 24 AND NOT e / n::DOUBLE > 0.22) AS fp, count(*) FILTER (NOT e > 24 AND e / n::DOUBLE > 0.22) AS fn FROM u),
        p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 1) AS recall FROM c) SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, precision = 1 AND recall >= 0.9 AS passed FROM p""",
    "label_noise": f"WITH {_SC} SELECT lang AS naming, count(*) AS tables, count(*) FILTER (prediction <> 0) AS unseen FROM s WHERE label = 0 GROUP BY 1",
    "key_ranking": f"WITH u AS ({dependency_queries.ORACLE_SQL['uccs_customer']}) SELECT 1::BIGINT AS tables, count(*) AS found, count(*) FILTER (rank = 1) AS first FROM u WHERE cols = 'custkey'",
    "no_key_tables": "SELECT 'handling' AS table_name FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1 LIMIT 1",
    "review_refresh": f"""WITH {features_sql()}, t AS (SELECT DISTINCT table_name, table_has_no_single_pk_candidate = 1 AS a, table_row_count < 30 AS b FROM profile)
        SELECT table_name, concat_ws(' | ', CASE WHEN b THEN 'few rows' END, CASE WHEN a THEN 'no single key' END) AS review_reason, a OR b AS needs_review FROM t""",
}
