"""Column and table profiles of the key track: one aggregation over all columns of all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import names
from tablewright.sources.tables import REF

#: Types with a flag of their own in the normal-form track, where bigint is what others are compared with.
NF_TYPES = ("date", "double", "integer", "varchar")
KEY_TYPES = ("boolean", "date", "decimal", "double", "integer", "varchar")
NEAR_UNIQUE = 0.95


def _number(c: Column, kind: T.DataType) -> Column | None:
    """A column of whole numbers or dates as a long."""
    return c.cast("long") if isinstance(kind, T.IntegralType) else F.unix_date(c).cast("long") if isinstance(kind, T.DateType) else None


def column_sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """The pre-pass, one scan a table: rows and non-null values of each column; of whole numbers also the ends and a mergeable sketch's
    estimate of how many are distinct."""

    def one(table: str, df: DataFrame) -> DataFrame:
        aggs, cells = [F.count("*").alias("n")], []
        for i, f in enumerate(df.schema.fields, 1):
            c = F.col(f"`{f.name}`")
            number, none = _number(c, f.dataType), F.lit(None).cast("long")
            aggs.append(F.count(c).alias(f"v{i}"))
            if number is not None:
                aggs += [F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}"), F.approx_count_distinct(number, 0.05).alias(f"d{i}")]
            low, high, distinct = (F.col(f"{k}{i}") if number is not None else none for k in "abd")
            cells.append(F.struct(F.lit(i).alias("ordinal_position"), F.col("n").alias("count"), F.col(f"v{i}").alias("non_null"), low.alias("low"), high.alias("high"), distinct.alias("estimate")))
        return df.agg(*aggs).select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))

    return reduce(DataFrame.union, (one(t, df) for t, df in tables.items()))


def is_dense(low: int | None, high: int | None, estimate: int | None) -> bool:
    """Whether words of 64 bits, one for each 64 numbers between the ends, are fewer than half of the distinct numbers."""
    return low is not None and (high - low) // 64 + 1 <= estimate / 2


def column_words(tables: dict[str, DataFrame], dense: set[tuple[str, int]]) -> DataFrame:
    """(table_name, ordinal_position, word, bits): of each non-null value of a dense column its place among 64 neighbours, as a bit, and
    which 64 they are; of others a 64-bit hash and one bit. A value has the same word and bit wherever it is."""

    def one(table: str, df: DataFrame) -> DataFrame:
        cells = []
        for i, f in enumerate(df.schema.fields, 1):
            c = F.col(f"`{f.name}`")
            number = _number(c, f.dataType) if (table, i) in dense else None
            word = F.xxhash64(c) if number is None else F.shiftright(number, 6)
            bits = F.lit(1).cast("long") if number is None else F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
            cells.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("o"), word.alias("w"), bits.alias("b"))))
        exploded = df.select(F.lit(table).alias("table_name"), F.explode(F.array(*cells)).alias("x")).where("x is not null")
        return exploded.select("table_name", F.col("x.o").alias("ordinal_position"), F.col("x.w").alias("word"), F.col("x.b").alias("bits"))

    return reduce(DataFrame.union, (one(t, df) for t, df in tables.items()))


def column_stats(columns: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct values (null ignored), rows and nulls of each column.

    A pre-pass counts rows and nulls, and finds the columns of whole numbers that lie so close together that 64 of them fit into a word: of
    these, words are shuffled in place of values. All other values are counted by their 64-bit hash, each once for each task before
    the shuffle. A column of an empty table has zero counts and counts as unique.
    """
    sketches = column_sketches(tables)
    known = sketches.collect()  # a row for each column
    dense = {(r["table_name"], r["ordinal_position"]) for r in known if is_dense(r["low"], r["high"], r["estimate"])}
    words = column_words(tables, dense).groupBy("table_name", "ordinal_position", "word").agg(F.bit_or("bits").alias("bits"))
    distinct = words.groupBy("table_name", "ordinal_position").agg(F.sum(F.bit_count("bits")).alias("number_unique_values"))
    counts = tables[next(iter(tables))].sparkSession.createDataFrame([tuple(r)[:4] for r in known], "table_name string, ordinal_position int, count long, non_null long")
    counts = counts.withColumn("null_count", F.col("count") - F.col("non_null")).drop("non_null")
    out = columns.join(counts, ["table_name", "ordinal_position"], "left").join(distinct, ["table_name", "ordinal_position"], "left")
    out = out.fillna(0, ["number_unique_values", "count", "null_count"]).withColumn("null_ratio", ratio("null_count", "count"))
    return out.withColumn("is_unique", names.flag((F.col("number_unique_values") == F.col("count")) & (F.col("null_count") == 0)))


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def with_column_features(stats: DataFrame) -> DataFrame:
    n, c, t = F.max("ordinal_position").over(Window.partitionBy(*REF)), F.col("column_name"), F.col("table_name")
    return (
        stats.withColumn("unique_ratio", ratio("number_unique_values", "count"))
        .withColumn("is_non_null", names.flag(F.col("null_count") == 0))
        .withColumn("is_first_column", names.flag(F.col("ordinal_position") == 1))
        .withColumn("relative_ordinal_position", F.col("ordinal_position") / n)
        .withColumn("name_ends_with_id", names.ends_with_id(c))
        .withColumn("name_contains_key", names.contains_key(c))
        .withColumn("name_contains_table_name", names.contains_table_name("column_name", "table_name"))
        .withColumn("name_is_singular_table_id", names.is_singular_table_id(c, t))
        .withColumn("name_length", F.length(c))
    )


def with_table_features(p: DataFrame, integers: tuple[str, ...] = ("bigint", "integer", "int")) -> DataFrame:
    """Counts over a table's columns, own-excluding counts, ranks and relations to the table's best column."""
    w = Window.partitionBy(*REF)
    total = lambda cond: F.sum(names.flag(cond)).over(w)
    near = F.col("unique_ratio") > NEAR_UNIQUE
    p = (
        p.withColumn("table_column_count", F.max("ordinal_position").over(w))
        .withColumn("table_unique_column_count", F.sum("is_unique").over(w))
        .withColumn("first_unique", F.min(F.when(F.col("is_unique") == 1, F.col("ordinal_position"))).over(w))
        .withColumn("table_row_count", F.max("count").over(w))
        .withColumn("table_near_unique_column_count", total(near))
        .withColumn("table_id_named_column_count", F.sum("name_ends_with_id").over(w))
        .withColumn("table_non_null_column_count", F.sum("is_non_null").over(w))
        .withColumn("table_max_unique_ratio", F.max("unique_ratio").over(w))
        .withColumn("table_integer_column_count", total(F.col("column_type").isin(*integers)))
        .withColumn("unique_ratio_rank", F.row_number().over(w.orderBy(F.desc("unique_ratio"), "ordinal_position")))
        .withColumn("null_ratio_rank", F.row_number().over(w.orderBy("null_ratio", "ordinal_position")))
    )
    return (
        p.withColumn("is_first_unique_column", names.flag(F.col("ordinal_position") == F.col("first_unique")))
        .withColumn("other_unique_columns_in_table", F.col("table_unique_column_count") - F.col("is_unique"))
        .withColumn("table_has_unique_column", names.flag(F.col("table_unique_column_count") > 0))
        .withColumn("table_has_no_single_pk_candidate", names.flag(F.col("table_unique_column_count") == 0))
        .withColumn("is_least_null_in_table", names.flag(F.col("null_ratio_rank") == 1))
        .withColumn("unique_ratio_relative_to_max", ratio("unique_ratio", "table_max_unique_ratio"))
        .withColumn("other_near_unique_columns_in_table", F.col("table_near_unique_column_count") - names.flag(near))
        .drop("first_unique")
    )


def one_hot(column: str, prefix: str, kinds: tuple[str, ...], strict: bool = False) -> list[Column]:
    """A flag for each kind. strict: a value that is none of them is an error, else all flags are 0."""
    value = F.regexp_replace(F.lower(F.col(column)), r"\(.*\)", "")
    if strict:
        value = F.when(value.isin(*kinds), value).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.col(column))))
    return [(value == k).cast("int").alias(f"{prefix}{k}") for k in kinds]


def profile_columns(columns: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The whole key-track profile: a row a column."""
    p = with_table_features(with_column_features(column_stats(columns, tables)))
    return p.select("*", *one_hot("column_type", "column_type_", KEY_TYPES))


def min_max(tables: dict[str, DataFrame]) -> DataFrame:
    """Each column's smallest and largest value as text: carried along, never a feature. Negative zero counts as zero."""

    def one(table: str, df: DataFrame) -> DataFrame:
        value = {c: F.col(f"`{c}`") + F.lit(0.0) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes}
        cells = df.agg(*(f(value[c]).cast("string").alias(f"{n}_{i}") for i, c in enumerate(df.columns) for n, f in (("min", F.min), ("max", F.max))))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"min_{i}").alias("min_value"), F.col(f"max_{i}").alias("max_value")) for i, c in enumerate(df.columns)))
        return cells.select(F.lit(table).alias("table_name"), F.inline(rows))

    return reduce(DataFrame.union, (one(t, df) for t, df in tables.items()))


def select_contract(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """Exactly the contract's columns, in its order and types; a missing column is an error, and so is an unexpected feature."""
    missing = [c for c, _ in contract if c not in df.columns]
    unexpected = [c for c in df.columns if c not in dict(contract)]
    if missing or unexpected:
        raise ValueError(f"features differ: missing {missing}, unexpected {unexpected}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in contract))
