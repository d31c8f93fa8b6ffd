"""Queries of the key track: profiles, names and scopes of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import names
from tablewright.operators import profile, scope
from tablewright.plans.star import columns_sql, features_sql, star, star_columns, stats_sql
from tablewright.sources.tables import discover_columns, evolve_schema, manifest_delete, manifest_insert, select_tables

ONE_HOT = ", ".join(f"CAST(column_type = '{k}' AS INTEGER) AS column_type_{k}" for k in profile.KEY_TYPES)


def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_columns(spark, star(spark, sf_dir))


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, df in star(spark, sf_dir).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit("lake").alias("database"), F.lit("star").alias("schema"), F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def discover_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the tables that have more than 1,000 rows; `only` outranks `skip`."""
    counts = _row_counts(spark, sf_dir)
    return select_tables(discover(spark, sf_dir), only=counts.where("n > 1000"), skip=counts)


def discover_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_tables(discover(spark, sf_dir), skip=_row_counts(spark, sf_dir).where("n > 1000"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(*star_columns(spark, sf_dir))


def profile_columns_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(*star_columns(spark, sf_dir))


def min_max_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest values of all columns."""
    return profile.min_max(star(spark, sf_dir))


def feature_contract_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's features: exact columns, order and types."""
    p = profile_columns_star(spark, sf_dir)
    contract = [("is_unique", "double"), ("unique_ratio", "double"), ("null_ratio", "double"), ("ordinal_position", "double"), ("name_ends_with_id", "double"), ("table_column_count", "double")]
    return profile.select_contract(p.select([c for c, _ in contract]), contract)


def cross_table_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = column_stats(spark, sf_dir).select("database", "schema", "table_name", "column_name", "is_unique")
    return scope.add_cross_table_features(p, ["database", "schema"])


def _databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile under two databases: what describes trade, and what describes places."""
    place = F.when(F.col("table_name").isin("region", "nation", "supplier"), "places").otherwise("trade")
    return column_stats(spark, sf_dir).select(place.alias("database"), "schema", "table_name", "column_name", "is_unique")


def scope_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.scope_augmented_variants(_databases(spark, sf_dir), widths=(1, 5, None))


def serving_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over orders and lineitem; the other tables' uniqueness from the queue, in which each column has an old and a new row."""
    stats = column_stats(spark, sf_dir).select("database", "schema", "table_name", "column_name", "ordinal_position", "is_unique")
    run = stats.where(F.col("table_name").isin("orders", "lineitem")).drop("ordinal_position")
    queue = stats.where(~F.col("table_name").isin("orders", "lineitem", "part"))
    queue = queue.withColumn("id", F.col("ordinal_position").cast("long")).unionByName(queue.withColumn("id", F.col("ordinal_position") + 100).withColumn("is_unique", 1 - F.col("is_unique")))
    return scope.serving_scope(run, discover(spark, sf_dir), queue)


def repeating_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered columns: of the star tables, and of one whose columns are the order priorities, numbered."""
    wide = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    named = wide.toDF("custkey", "status1", "status_2", "Status3")
    scheme = wide.select("F", "O", "P").toDF("col_1", "col_2", "col_3")
    return names.repeating_groups(discover_columns(spark, star(spark, sf_dir) | {"wide": named, "scheme": scheme}))


def freetext_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose names among the star's columns and their tables' `_comment`, `_note` and `_version` columns."""
    d = discover(spark, sf_dir)
    extra = d.select("table_name", F.explode(F.array(*(F.concat("column_name", F.lit(s)) for s in ("_comment", "_note", "_version")))).alias("column_name"))
    d = d.select("table_name", "column_name").union(extra)
    return d.withColumn("is_freetext", names.is_freetext_name(F.col("column_name")))


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = discover(spark, sf_dir)
    d = d.select("table_name", F.explode(F.array("column_name", *(F.concat("column_name", F.lit(s)) for s in ("_id", "id", "_code", "num", "__key")))).alias("column_name"))
    c = F.col("column_name")
    return d.select("table_name", "column_name", names.stem(c).alias("stem"), F.array_join(names.table_variants(F.col("table_name")), ",").alias("variants"), names.ends_with_bare_id(c).alias("bare_id"), names.ends_with_code(c).alias("code"))


def evolved_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old results under a newer schema: no row is lost, new columns are null."""
    old = spark.read.parquet(f"{sf_dir}/nation.parquet")
    new = T.StructType([*old.schema.fields, T.StructField("n_area", T.DoubleType())])
    return evolve_schema(old, new, sentinel="n_nationkey")


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all tables, small ones deleted, large ones replaced by rows that need review."""
    counts = _row_counts(spark, sf_dir).select("table_name", F.col("n").alias("rows"), F.lit(False).alias("needs_review"))
    kept = manifest_delete(counts, counts.where("rows < 30"))
    return manifest_insert(kept, counts.where("rows > 1000").withColumn("needs_review", F.lit(True)))


QUERIES = {
    f.__name__: f
    for f in (
        discover, discover_only, discover_skip, column_stats, profile_columns_star, min_max_text, feature_contract_pk, cross_table_features, scope_augmented,
        serving_scope, repeating_groups, freetext_names, name_parts, evolved_schema, manifest_changes,
    )
}

_STEM = "CASE " + " ".join(f"WHEN right(c, {len(s)}) = '{s}' THEN rtrim(c[1:length(c) - {len(s)}], '_')" for s in names.ID_SUFFIXES) + " ELSE c END"
_VARIANTS = "list_sort(list_distinct(list_filter([t, CASE WHEN t LIKE '%ies' THEN regexp_replace(t, 'ies$', 'y') END, CASE WHEN t LIKE '%s' THEN t[1:length(t) - 1] ELSE t || 's' END], lambda x: x IS NOT NULL)))"


def _cross(source: str, scope_columns: str, out: str) -> str:
    """CTEs that add the seven features to `source`."""
    keys = [k.strip() for k in scope_columns.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""x0 AS (SELECT *, lower(table_name) AS t, lower(column_name) AS c FROM {source}),
        x1 AS (SELECT *, {_STEM} AS cut, {_VARIANTS} AS own FROM x0),
        x2 AS (SELECT *, CASE WHEN length(cut) >= 2 THEN cut ELSE c END AS stem FROM x1),
        xv AS (SELECT {scope_columns}, list_distinct(flatten(list(own))) AS vs FROM x2 GROUP BY {scope_columns}),
        xn AS (SELECT a.*, len(list_distinct(list_filter((SELECT list(b.t) FROM x2 b WHERE {same} AND b.c = a.c), lambda x: x <> a.t))) AS n_same,
               coalesce(len(list_filter((SELECT list(b.t) FROM x2 b WHERE {same} AND b.c = a.c AND b.is_unique = 1), lambda x: x <> a.t)), 0) > 0 AS elsewhere,
               list_filter((SELECT b.vs FROM xv b WHERE {same}), lambda v: NOT list_contains(a.own, v)) AS others FROM x2 a),
        {out} AS (SELECT * EXCLUDE (t, c, cut, own, stem, n_same, elsewhere, others), CAST(n_same AS INTEGER) AS n_other_tables_with_same_column_name, CAST(elsewhere AS INTEGER) AS name_unique_in_other_table,
               CAST(elsewhere AND is_unique = 0 AS INTEGER) AS is_non_unique_and_name_unique_elsewhere, CAST(list_contains(others, stem) AS INTEGER) AS name_references_other_table_exact,
               CAST(list_contains(others, stem) OR (length(stem) >= 3 AND len(list_filter(others, lambda v: contains(v, stem))) > 0) AS INTEGER) AS name_references_other_table_fuzzy,
               CAST(regexp_matches(c, '(id|no)$') AND NOT regexp_matches(c, '(_id|_no)$') AS INTEGER) AS name_ends_with_id_no_underscore,
               CAST(regexp_matches(c, '({"|".join(names.CODE_SUFFIXES)})$') AS INTEGER) AS name_ends_with_code_or_num FROM xn)"""


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
_SCOPED = "SELECT {db} AS database, schema, table_name, column_name, is_unique FROM stats"


def _plain(column: str) -> str:
    """A money or rate column without negative zeros; other columns as they are."""
    return f"{column} + 0.0" if column.endswith(("acctbal", "price", "quantity", "discount", "tax")) else column


ORACLE_SQL = {
    "discover": columns_sql(),
    "discover_only": f"WITH c AS ({columns_sql()}), n AS ({_COUNTS}) SELECT c.* FROM c JOIN n USING (table_name) WHERE n > 1000",
    "discover_skip": f"WITH c AS ({columns_sql()}), n AS ({_COUNTS}) SELECT c.* FROM c JOIN n USING (table_name) WHERE n <= 1000",
    "column_stats": f"WITH {stats_sql()} SELECT * FROM stats",
    "profile_columns_star": f"WITH {features_sql()} SELECT *, {ONE_HOT} FROM profile",
    "min_max_text": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({_plain(p + c)}) AS VARCHAR) AS min_value, CAST(max({_plain(p + c)}) AS VARCHAR) AS max_value FROM {t}"
        for t, p, cs in (
            ("region", "r_", "regionkey name"), ("nation", "n_", "nationkey name regionkey"), ("customer", "c_", "custkey name nationkey acctbal mktsegment"), ("supplier", "s_", "suppkey name nationkey acctbal"),
            ("part", "p_", "partkey name brand type size retailprice"), ("orders", "o_", "orderkey custkey orderstatus totalprice orderdate orderpriority"), ("lineitem", "l_", "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate"),
        )
        for c in cs.split()
    ),
    "feature_contract_pk": f"WITH {features_sql()} SELECT is_unique::DOUBLE AS is_unique, unique_ratio, null_ratio, ordinal_position::DOUBLE AS ordinal_position, name_ends_with_id::DOUBLE AS name_ends_with_id, table_column_count::DOUBLE AS table_column_count FROM profile",
    "cross_table_features": f"WITH {stats_sql()}, s AS ({_SCOPED.format(db='database')}), {_cross('s', 'database, schema', 'o')} SELECT * FROM o",
    "scope_augmented": f"""WITH {stats_sql()}, s AS ({_SCOPED.format(db="CASE WHEN table_name IN ('region', 'nation', 'supplier') THEN 'places' ELSE 'trade' END")}),
        w AS (SELECT s.*, w.scope_width, CASE WHEN w.scope_width = '1' THEN s.database ELSE '' END AS bucket FROM s, (VALUES ('1'), ('5'), ('all')) AS w(scope_width)),
        {_cross("w", "scope_width, bucket", "o")} SELECT * EXCLUDE (bucket) FROM o""",
    "serving_scope": f"""WITH {stats_sql()}, s AS (SELECT database, schema, table_name, column_name,
        CASE WHEN table_name IN ('orders', 'lineitem') THEN is_unique WHEN table_name = 'part' THEN 0 ELSE 1 - is_unique END AS is_unique FROM stats),
        {_cross("s", "database, schema", "o")} SELECT * FROM o WHERE table_name IN ('orders', 'lineitem')""",
    "repeating_groups": "SELECT * FROM (VALUES ('wide', 'status1', 'status', 3::BIGINT), ('wide', 'status_2', 'status', 3::BIGINT), ('wide', 'Status3', 'status', 3::BIGINT)) AS v(table_name, column_name, stem, members)",
    "freetext_names": f"""WITH c AS ({columns_sql()}), a AS (SELECT table_name, column_name || s AS column_name FROM c, (VALUES (''), ('_comment'), ('_note'), ('_version')) AS v(s))
        SELECT *, CAST(regexp_matches(lower(column_name), '{"|".join(names.FREETEXT_TOKENS)}') AS INTEGER) AS is_freetext FROM a""",
    "name_parts": f"""WITH k AS ({columns_sql()}), a AS (SELECT table_name, table_name AS t, column_name || s AS column_name, column_name || s AS c FROM k, (VALUES (''), ('_id'), ('id'), ('_code'), ('num'), ('__key')) AS v(s)),
        b AS (SELECT *, {_STEM} AS cut FROM a)
        SELECT table_name, column_name, CASE WHEN length(cut) >= 2 THEN cut ELSE c END AS stem, array_to_string({_VARIANTS}, ',') AS variants,
               CAST(regexp_matches(c, '(id|no)$') AND NOT regexp_matches(c, '(_id|_no)$') AS INTEGER) AS bare_id, CAST(regexp_matches(c, '({"|".join(names.CODE_SUFFIXES)})$') AS INTEGER) AS code FROM b""",
    "evolved_schema": "SELECT *, CAST(NULL AS DOUBLE) AS n_area FROM nation",
    "manifest_changes": f"WITH n AS ({_COUNTS}) SELECT table_name, n AS rows, n > 1000 AS needs_review FROM n WHERE n >= 30",
}
