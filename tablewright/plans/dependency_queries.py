"""Queries of the normal-form track: atomicity, combinations, keys, dependencies, rule-based normal forms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import atomicity, combos, dependencies
from tablewright.plans.star import PREFIX, columns_of, star

CUSTOMER_NATION = ["custkey", "acctbal", "mktsegment", "nationkey", "nation_name", "regionkey"]
HANDLING = ["custkey", "orderstatus", "orderpriority", "handling_code"]


def _customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and its region folded in."""
    t = star(spark, sf_dir, ["customer", "nation"])
    n = t["nation"].withColumnRenamed("name", "nation_name")
    return t["customer"].drop("name").join(n, "nationkey").select(CUSTOMER_NATION)


def _handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a code that status and priority determine together, but neither alone."""
    o = star(spark, sf_dir, ["orders"])["orders"]
    code = F.concat(F.substring("orderpriority", 1, 1), F.col("orderstatus"))
    return o.select("custkey", "orderstatus", "orderpriority", code.alias("handling_code"))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("cols", F.array_join("cols", ","))


def list_like_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of text, documents' source names and order priorities folded into lists."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props")
    o = star(spark, sf_dir, ["orders"])["orders"]
    folded = o.groupBy("custkey").agg(F.array_join(F.array_sort(F.collect_set("orderpriority")), ", ").alias("priorities"), F.array_join(F.array_sort(F.collect_set("orderpriority")), ", ").alias("priority_comment"))
    m = atomicity.with_atomicity(atomicity.token_measures(atomicity.value_shapes({"documents": docs, "events": events, "folded": folded})))
    return m.select("table_name", "column_name", "ordinal_position", "non_null", *(F.round(c, 9).alias(c) for c in ("list_like_ratio", "mean_length", "mean_separators", "mean_token_length", "mean_token_count", "separator_density")), "is_non_atomic", "is_key_eligible")


def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with one value at most, null counted as one; of open orders, whose status is constant."""
    o = star(spark, sf_dir, ["orders"])["orders"].where("orderstatus = 'O'")
    return combos.singles(o, "open_orders").where("n_distinct <= 1").select("table_name", F.col("cols")[0].alias("column_name"))


def pair_matrix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(combos.pair_matrix(star(spark, sf_dir, ["orders"])["orders"], "orders"))


def null_as_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of singles and pairs of a table with nulls: priorities of orders that are still open are unknown."""
    o = star(spark, sf_dir, ["orders"])["orders"].select("orderstatus", F.expr("if(orderstatus = 'O', null, orderpriority)").alias("priority"), F.expr("if(totalprice > 200000, null, custkey % 7)").alias("slot"))
    return _joined(combos.combo_distinct(o, [["orderstatus"], ["priority"], ["slot"], ["orderstatus", "priority"], ["priority", "slot"], ["orderstatus", "priority", "slot"]], "orders"))


def sampled_pairs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of a table beyond the sampling gate, on the portable sample."""
    li = star(spark, sf_dir, ["lineitem"])["lineitem"]
    key = ["orderkey", "partkey", "suppkey", "linenumber"]
    return _joined(combos.pair_matrix(combos.sample_rows(li, li.count(), key).select(*key, "returnflag", "linestatus"), "lineitem"))


def _uccs(df: DataFrame, table: str) -> DataFrame:
    stats, pairs, _ = dependencies.table_statistics(df, table)
    return dependencies.find_uccs(stats, pairs, lambda c: combos.combo_distinct(df, c, table))


def uccs_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_uccs(_customer_nation(spark, sf_dir), "customer_nation")).withColumn("ucc_score", F.round("ucc_score", 9))


def uccs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_uccs(star(spark, sf_dir, ["orders"])["orders"], "orders")).withColumn("ucc_score", F.round("ucc_score", 9))


def structural_keys_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(dependencies.structural_keys(_uccs(_customer_nation(spark, sf_dir), "customer_nation"))).select("table_name", "cols")


def full_cardinalities_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-column counts of the whole table, beside which the sample's are never put."""
    return combos.singles(star(spark, sf_dir, ["lineitem"])["lineitem"], "lineitem").select("table_name", F.col("cols")[0].alias("column_name"), "n_distinct")


def fds_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, pairs, _ = dependencies.table_statistics(_customer_nation(spark, sf_dir), "customer_nation")
    return dependencies.find_dependencies(stats, pairs)


def near_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that a few rows break: every 97th customer has a nation name of its own kind."""
    d = _customer_nation(spark, sf_dir).withColumn("nation_name", F.expr("if(custkey % 97 = 0, concat(nation_name, ' II'), nation_name)"))
    d = d.withColumn("slot", F.expr("custkey % 300")).withColumn("half", F.expr("if(custkey = 7, -1, custkey % 300 % 150)"))
    stats, pairs, _ = dependencies.table_statistics(d, "customer_nation")
    return dependencies.find_near_dependencies(stats, pairs).withColumn("strength", F.round("strength", 9))


def near_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, pairs, _ = dependencies.table_statistics(_customer_nation(spark, sf_dir), "customer_nation")
    return _joined(dependencies.find_near_uccs(stats, pairs))


def pair_fds_handling_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _handling(spark, sf_dir)
    stats, pairs, _ = dependencies.table_statistics(df, "handling")
    found = dependencies.find_pair_dependencies(dependencies.pair_fd_candidates(stats, pairs), lambda c: combos.combo_distinct(df, c, "handling"))
    return found.withColumn("lhs", F.array_join("lhs", ","))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customer_nation(spark, sf_dir)
    stats, pairs, _ = dependencies.table_statistics(df, "customer_nation")
    keys = dependencies.structural_keys(dependencies.find_uccs(stats, pairs, lambda c: combos.combo_distinct(df, c, "customer_nation")))
    fds = dependencies.find_dependencies(stats, pairs).withColumn("lhs", F.array("lhs"))
    return dependencies.classify_dependencies(fds, keys)


def fd_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).withColumn("lhs", F.array_join("lhs", ","))


def rule_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = spark.createDataFrame([("customer_nation",), ("folded",)], "table_name string")
    shapes = list_like_profile(spark, sf_dir).where("is_non_atomic = 1 and table_name = 'folded'")
    return dependencies.rule_normal_form(tables, _classified(spark, sf_dir), shapes)


QUERIES = {
    f.__name__: f
    for f in (
        list_like_profile, constant_columns, pair_matrix_orders, null_as_value_counts, sampled_pairs_lineitem, uccs_customer, uccs_orders, structural_keys_customer,
        full_cardinalities_lineitem, fds_customer_nation, near_fds, near_keys, pair_fds_handling_code, fd_classes, rule_normal_form,
    )
}

_CN = "rel AS (SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment, c_nationkey AS nationkey, n_name AS nation_name, n_regionkey AS regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_ORDERS = f"rel AS (SELECT {', '.join(f'o_{c} AS {c}' for c, _ in columns_of('orders'))} FROM orders)"
_HANDLING = "rel AS (SELECT o_custkey AS custkey, o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, substr(o_orderpriority, 1, 1) || o_orderstatus AS handling_code FROM orders)"


def _counts(columns: list[str], sizes: tuple[int, ...]) -> str:
    """CTE `n`: distinct counts of all combinations of the given sizes of rel's columns."""
    all_ = [c for k in sizes for c in combinations(sorted(columns), k)]
    return "n AS (" + " UNION ALL ".join(f"SELECT {list(c)} AS cols, count(DISTINCT ({', '.join(c)},)) AS n FROM rel" if len(c) > 1 else f"SELECT {list(c)} AS cols, count(DISTINCT {{'x': {c[0]}}}) AS n FROM rel" for c in all_) + ")"


def _position(columns: list[str]) -> str:
    return f"list_sort(list_transform(cols, lambda x: list_position({columns}, x)))"


def _ucc_sql(table: str, rel: str, columns: list[str]) -> str:
    card = "list_product(list_transform(cols, lambda x: greatest(m[x], 1)::DOUBLE))"
    return f"""WITH {rel}, {_counts(columns, (1, 2, 3))}, r AS (SELECT count(*) AS rows FROM rel), mm AS (SELECT map(list(cols[1]), list(n)) AS m FROM n WHERE len(cols) = 1),
        u AS (SELECT cols, rows, {card} AS card, len(list_filter(cols, lambda x: m[x] / rows::DOUBLE >= 0.9)) > 0 AS near FROM n, r, mm WHERE n = rows),
        ok AS (SELECT * FROM u WHERE len(cols) = 1 OR (NOT near AND card >= rows)),
        k AS (SELECT * FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE len(b.cols) < len(a.cols) AND list_has_all(a.cols, b.cols)))
        SELECT '{table}' AS table_name, array_to_string(cols, ',') AS cols, round(rows::DOUBLE * rows / (2 * card), 9) AS ucc_score,
               CAST(row_number() OVER (ORDER BY rows::DOUBLE * rows / (2 * card) DESC, {_position(columns)}) AS INTEGER) AS rank FROM k"""


def _fd_sql(rel: str, columns: list[str]) -> str:
    """CTEs up to `d`: both directions of each pair with counts."""
    return f"""{rel}, {_counts(columns, (1, 2))}, r AS (SELECT count(*) AS rows FROM rel), p AS (SELECT cols[1] AS lhs, cols[2] AS rhs, n FROM n WHERE len(cols) = 2 UNION ALL SELECT cols[2], cols[1], n FROM n WHERE len(cols) = 2),
        s AS (SELECT cols[1] AS c, n FROM n WHERE len(cols) = 1), d AS (SELECT lhs, rhs, p.n AS n_pair, a.n AS n_lhs, b.n AS n_rhs, rows FROM p JOIN s a ON a.c = lhs JOIN s b ON b.c = rhs, r)"""


_DIRTY = """rel AS (SELECT custkey, acctbal, mktsegment, nationkey, CASE WHEN custkey % 97 = 0 THEN nation_name || ' II' ELSE nation_name END AS nation_name, regionkey,
    custkey % 300 AS slot, CASE WHEN custkey = 7 THEN -1 ELSE custkey % 300 % 150 END AS half FROM rel0)"""
_FOLDED = "(SELECT array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS v FROM orders GROUP BY o_custkey)"


def _shape_sql(table: str, column: str, ordinal: int, source: str, value: str | None) -> str:
    free = 1 if column.endswith("comment") else 0
    if value is None:
        return f"SELECT '{table}' AS table_name, '{column}' AS column_name, {ordinal} AS ordinal_position, count(*) AS non_null, 0.0::DOUBLE AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s, {free} AS free FROM {source}"
    like = atomicity.LIST_LIKE
    return f"SELECT '{table}', '{column}', {ordinal}, count({value}), count(CASE WHEN regexp_matches({value}, '{like}') THEN 1 END) / count({value})::DOUBLE, avg(length({value})), avg(length({value}) - length(regexp_replace({value}, '[,;|]', '', 'g'))), {free} FROM {source}"


_SHAPES = " UNION ALL ".join((
    _shape_sql("folded", "custkey", 1, _FOLDED, None), _shape_sql("folded", "priorities", 2, _FOLDED, "v"), _shape_sql("folded", "priority_comment", 3, _FOLDED, "v"),
    _shape_sql("documents", "text", 1, "documents", "text"), _shape_sql("documents", "lang", 2, "documents", "lang"),
    _shape_sql("events", "event_type", 1, "events", "event_type"), _shape_sql("events", "props", 2, "events", "props"),
))
_LI = ["orderkey", "partkey", "suppkey", "linenumber", "returnflag", "linestatus"]
_CLASSES = f"""{_fd_sql(_CN, CUSTOMER_NATION)}, f AS (SELECT lhs, rhs FROM d WHERE n_pair = n_lhs AND n_rhs > 1 AND n_lhs / rows::DOUBLE < 0.9), key AS (SELECT 'custkey' AS k)"""

ORACLE_SQL = {
    "list_like_profile": f"""WITH x AS ({_SHAPES}), y AS (SELECT *, m / (s + 1) AS t FROM x)
        SELECT table_name, column_name, ordinal_position, non_null, round(l, 9) AS list_like_ratio, round(m, 9) AS mean_length, round(s, 9) AS mean_separators, round(t, 9) AS mean_token_length, round(s + 1, 9) AS mean_token_count,
               round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 9) AS separator_density, CAST(free = 0 AND l >= 0.8 AND t <= 20 AS INTEGER) AS is_non_atomic, CAST(t <= 20 AND NOT (free = 0 AND l >= 0.8 AND t <= 20) AS INTEGER) AS is_key_eligible FROM y""",
    "constant_columns": "SELECT 'open_orders' AS table_name, 'orderstatus' AS column_name FROM orders WHERE o_orderstatus = 'O' HAVING count(DISTINCT o_orderstatus) = 1",
    "pair_matrix_orders": f"WITH {_ORDERS}, {_counts([c for c, _ in columns_of('orders')], (2,))} SELECT 'orders' AS table_name, array_to_string(cols, ',') AS cols, n AS n_distinct FROM n",
    "null_as_value_counts": f"""WITH rel AS (SELECT o_orderstatus AS orderstatus, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_custkey % 7 END AS slot FROM orders),
        {_counts(["orderstatus", "priority", "slot"], (1, 2, 3))} SELECT 'orders' AS table_name, array_to_string(cols, ',') AS cols, n AS n_distinct FROM n WHERE cols <> ['orderstatus', 'slot']""",
    "sampled_pairs_lineitem": f"""WITH t AS (SELECT count(*) AS n FROM lineitem), rel AS (SELECT {", ".join(f"l_{c} AS {c}" for c in _LI)} FROM lineitem, t
        WHERE n <= 20000 OR ('0x' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber), 1, 8))::BIGINT % CAST(ceil(n / 10000.0) AS BIGINT) = 0),
        {_counts(_LI, (2,))} SELECT 'lineitem' AS table_name, array_to_string(cols, ',') AS cols, n AS n_distinct FROM n""",
    "uccs_customer": _ucc_sql("customer_nation", _CN, CUSTOMER_NATION),
    "uccs_orders": _ucc_sql("orders", _ORDERS, [c for c, _ in columns_of("orders")]),
    "structural_keys_customer": f"SELECT table_name, cols FROM ({_ucc_sql('customer_nation', _CN, CUSTOMER_NATION)}) WHERE ucc_score >= 1",
    "full_cardinalities_lineitem": " UNION ALL ".join(f"SELECT 'lineitem' AS table_name, '{c}' AS column_name, count(DISTINCT {PREFIX['lineitem']}{c}) AS n_distinct FROM lineitem" for c, _ in columns_of("lineitem")),
    "fds_customer_nation": f"WITH {_fd_sql(_CN, CUSTOMER_NATION)} SELECT 'customer_nation' AS table_name, lhs, rhs FROM d WHERE n_pair = n_lhs AND n_rhs > 1 AND n_lhs / rows::DOUBLE < 0.9",
    "near_fds": f"""WITH {_CN.replace("rel AS", "rel0 AS", 1)}, {_fd_sql(_DIRTY, [*CUSTOMER_NATION, "slot", "half"])}
        SELECT 'customer_nation' AS table_name, lhs, rhs, round(n_lhs / n_pair::DOUBLE, 9) AS strength FROM d WHERE n_lhs / n_pair::DOUBLE >= 0.95 AND n_lhs < n_pair AND n_rhs > 1 AND n_lhs / rows::DOUBLE < 0.9""",
    "near_keys": f"""WITH {_CN}, {_counts(CUSTOMER_NATION, (1, 2))}, r AS (SELECT count(*) AS rows FROM rel), k AS (SELECT cols FROM n, r WHERE n >= 0.99 * rows AND n < rows)
        SELECT 'customer_nation' AS table_name, array_to_string(cols, ',') AS cols FROM k WHERE len(cols) = 1 OR NOT EXISTS (SELECT 1 FROM k s WHERE len(s.cols) = 1 AND list_contains(k.cols, s.cols[1]))""",
    "pair_fds_handling_code": f"""WITH {_HANDLING}, {_counts(HANDLING, (1, 2, 3))}, r AS (SELECT count(*) AS rows FROM rel), s AS (SELECT cols[1] AS c, n FROM n WHERE len(cols) = 1),
        p AS (SELECT cols, n, rows - n AS support FROM n, r WHERE len(cols) = 2 AND rows - n >= 10), x AS (SELECT p.cols, p.n, p.support, s.c, s.n AS nc FROM p, s WHERE NOT list_contains(p.cols, s.c) AND s.n > 1)
        SELECT 'handling' AS table_name, array_to_string(x.cols, ',') AS lhs, x.c AS rhs, x.support FROM x JOIN n t ON len(t.cols) = 3 AND t.cols = list_sort(list_append(x.cols, x.c)) AND t.n = x.n
        WHERE NOT EXISTS (SELECT 1 FROM n q JOIN s ON q.cols = list_sort([s.c, x.c]) AND q.n = s.n WHERE list_contains(x.cols, s.c))""",
    "fd_classes": f"WITH {_CLASSES} SELECT 'customer_nation' AS table_name, lhs, rhs, false AS is_partial, lhs <> k AS is_transitive, false AS is_partial_strict, lhs <> k AND rhs <> k AS is_transitive_strict FROM f, key",
    "rule_normal_form": f"""WITH {_CLASSES}, e AS (SELECT string_agg(lhs || '->' || rhs, ',' ORDER BY lhs || '->' || rhs) AS t FROM f, key WHERE lhs <> k AND rhs <> k)
        SELECT 'customer_nation' AS table_name, CAST(CASE WHEN t IS NULL THEN 3 ELSE 2 END AS INTEGER) AS rule_normal_form, coalesce('transitive: ' || t, '') AS rule_evidence FROM e
        UNION ALL SELECT 'folded', CAST(CASE WHEN l >= 0.8 AND m / (s + 1) <= 20 THEN 0 ELSE 3 END AS INTEGER), CASE WHEN l >= 0.8 AND m / (s + 1) <= 20 THEN 'not atomic: priorities' ELSE '' END FROM ({_SHAPES}) AS q(table_name, column_name, ordinal_position, non_null, l, m, s, free)
        WHERE table_name = 'folded' AND column_name = 'priorities'""",
}
