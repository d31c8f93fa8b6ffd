"""The star schema that the registered queries profile, and what their SQL has in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.tables import discover_columns, read_tables, unprefixed

#: Columns of the given tables, without prefix, with their type label.
COLUMNS = {
    "region": "regionkey integer, name varchar",
    "nation": "nationkey integer, name varchar, regionkey integer",
    "customer": "custkey bigint, name varchar, nationkey integer, acctbal double, mktsegment varchar",
    "supplier": "suppkey bigint, name varchar, nationkey integer, acctbal double",
    "part": "partkey bigint, name varchar, brand varchar, type varchar, size integer, retailprice double",
    "orders": "orderkey bigint, custkey bigint, orderstatus varchar, totalprice double, orderdate timestamp, orderpriority varchar",
    "lineitem": "orderkey bigint, partkey bigint, suppkey bigint, linenumber integer, quantity double, extendedprice double, discount double, tax double, returnflag varchar, linestatus varchar, shipdate timestamp",
}
PREFIX = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}


def star(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: unprefixed(df) for t, df in read_tables(spark, sf_dir, names or COLUMNS).items()}


def star_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    tables = star(spark, sf_dir)
    return discover_columns(spark, tables), tables


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in COLUMNS[table].split(", ")]


def columns_sql() -> str:
    """A row a column, as discover_columns() gives it."""
    rows = [f"('lake', 'star', '{t}', '{c}', {i}, '{k}', false)" for t in sorted(COLUMNS) for i, (c, k) in enumerate(columns_of(t), 1)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(database, schema, table_name, column_name, ordinal_position, column_type, is_nested)"


def stats_sql() -> str:
    """CTEs up to `stats`: counts of each column."""
    one = [f"SELECT '{t}' AS table_name, {i} AS ordinal_position, count(DISTINCT {PREFIX[t]}{c}) AS u, count(*) AS n, count(*) - count({PREFIX[t]}{c}) AS z FROM {t}" for t in COLUMNS for i, (c, _) in enumerate(columns_of(t), 1)]
    return f"""cols AS ({columns_sql()}), counted AS ({" UNION ALL ".join(one)}),
        stats AS (SELECT table_name, ordinal_position, database, schema, column_name, column_type, is_nested, u AS number_unique_values, n AS count, z AS null_count,
                  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE z / n::DOUBLE END AS null_ratio, CAST(u = n AND z = 0 AS INTEGER) AS is_unique FROM cols JOIN counted USING (table_name, ordinal_position))"""


def features_sql() -> str:
    """CTEs up to `profile`: the key-track profile, without one-hot columns."""
    return f"""{stats_sql()},
        f AS (SELECT *, CASE WHEN count = 0 THEN 0.0::DOUBLE ELSE number_unique_values / count::DOUBLE END AS unique_ratio, CAST(null_count = 0 AS INTEGER) AS is_non_null,
              CAST(ordinal_position = 1 AS INTEGER) AS is_first_column, ordinal_position / (max(ordinal_position) OVER t)::DOUBLE AS relative_ordinal_position,
              CAST(lower(column_name) LIKE '%\\_id' ESCAPE '\\' AS INTEGER) AS name_ends_with_id, CAST(lower(column_name) LIKE '%key%' AS INTEGER) AS name_contains_key,
              CAST(lower(column_name) LIKE '%' || lower(table_name) || '%' AS INTEGER) AS name_contains_table_name,
              CAST(length(table_name) > 1 AND lower(column_name) = regexp_replace(lower(table_name), 's$', '') || '_id' AS INTEGER) AS name_is_singular_table_id,
              CAST(length(column_name) AS INTEGER) AS name_length FROM stats WINDOW t AS (PARTITION BY table_name)),
        profile AS (SELECT *, max(ordinal_position) OVER t AS table_column_count, CAST(sum(is_unique) OVER t AS BIGINT) AS table_unique_column_count, max(count) OVER t AS table_row_count,
              CAST(sum(CAST(unique_ratio > 0.95 AS INTEGER)) OVER t AS BIGINT) AS table_near_unique_column_count, CAST(sum(name_ends_with_id) OVER t AS BIGINT) AS table_id_named_column_count,
              CAST(sum(is_non_null) OVER t AS BIGINT) AS table_non_null_column_count, max(unique_ratio) OVER t AS table_max_unique_ratio,
              CAST(sum(CAST(column_type IN ('bigint', 'integer', 'int') AS INTEGER)) OVER t AS BIGINT) AS table_integer_column_count,
              CAST(row_number() OVER (PARTITION BY table_name ORDER BY unique_ratio DESC, ordinal_position) AS INTEGER) AS unique_ratio_rank,
              CAST(row_number() OVER (PARTITION BY table_name ORDER BY null_ratio, ordinal_position) AS INTEGER) AS null_ratio_rank,
              CAST(coalesce(ordinal_position = min(CASE WHEN is_unique = 1 THEN ordinal_position END) OVER t, false) AS INTEGER) AS is_first_unique_column,
              CAST(sum(is_unique) OVER t - is_unique AS BIGINT) AS other_unique_columns_in_table, CAST(sum(is_unique) OVER t > 0 AS INTEGER) AS table_has_unique_column,
              CAST(sum(is_unique) OVER t = 0 AS INTEGER) AS table_has_no_single_pk_candidate,
              CAST(row_number() OVER (PARTITION BY table_name ORDER BY null_ratio, ordinal_position) = 1 AS INTEGER) AS is_least_null_in_table,
              CASE WHEN max(unique_ratio) OVER t = 0 THEN 0.0::DOUBLE ELSE unique_ratio / max(unique_ratio) OVER t END AS unique_ratio_relative_to_max,
              CAST(sum(CAST(unique_ratio > 0.95 AS INTEGER)) OVER t - CAST(unique_ratio > 0.95 AS INTEGER) AS BIGINT) AS other_near_unique_columns_in_table
              FROM f WINDOW t AS (PARTITION BY table_name))"""
