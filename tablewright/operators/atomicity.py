"""First-normal-form measures of text columns: lists in a value, prose, and what may be part of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import names

#: Fixed value: a value that is a list of short parts.
LIST_LIKE = r"^[^,;|.!?]{1,40}([,;|] ?[^,;|.!?]{1,40})+$"
SEPARATORS = "[,;|]"
#: Longer values are judged part by part: the pattern repeats a group, for which the matcher would recurse as often.
LONG = 400
LIST_RATIO, MAX_TOKEN = 0.8, 20


def is_list_like(value: Column) -> Column:
    """Whether a value is a list of short parts, as LIST_LIKE says (with the end of the text for $), for values of any length."""
    parts = F.split(value, SEPARATORS, -1)
    size = lambda p: F.length(p).between(1, 40)
    spaced = lambda p: (F.length(p) == 41) & p.startswith(" ")
    by_part = (F.size(parts) > 1) & ~value.rlike("[.!?]") & size(parts[0]) & F.forall(F.slice(parts, F.lit(2), F.size(parts)), lambda p: size(p) | spaced(p))
    return F.when(F.length(value) <= LONG, value.rlike(LIST_LIKE.removesuffix("$") + r"\z")).otherwise(by_part)


def value_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column: non_null, list_like_ratio, mean_length, mean_separators; 0 for columns that are not text. One scan a table."""

    def one(table: str, df: DataFrame) -> DataFrame:
        text = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema}
        c = lambda n: F.col(f"`{n}`")
        aggs, cells = [], []
        for i, (n, is_text) in enumerate(text.items(), 1):
            aggs.append(F.count(c(n)).alias(f"n{i}"))
            if is_text:
                aggs += [F.count_if(is_list_like(c(n))).alias(f"l{i}"), F.avg(F.length(c(n))).alias(f"m{i}"), F.avg(F.length(c(n)) - F.length(F.regexp_replace(c(n), SEPARATORS, ""))).alias(f"s{i}")]
            zero = F.lit(0.0)
            cells.append(F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("ordinal_position"), F.col(f"n{i}").alias("non_null"),
                F.coalesce(F.col(f"l{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)), zero).alias("list_like_ratio") if is_text else zero.alias("list_like_ratio"),
                F.coalesce(F.col(f"m{i}"), zero).alias("mean_length") if is_text else zero.alias("mean_length"),
                F.coalesce(F.col(f"s{i}"), zero).alias("mean_separators") if is_text else zero.alias("mean_separators")))
        return df.agg(*aggs).select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))

    return reduce(DataFrame.union, (one(t, df) for t, df in tables.items()))


def token_measures(shapes: DataFrame) -> DataFrame:
    tokens = F.col("mean_separators") + 1
    d = shapes.withColumn("mean_token_length", F.col("mean_length") / tokens).withColumn("mean_token_count", tokens)
    return d.withColumn("separator_density", F.when(F.col("mean_length") > 0, F.col("mean_separators") / F.col("mean_length")).otherwise(0.0))


def with_atomicity(measures: DataFrame) -> DataFrame:
    """is_non_atomic (lists of short parts, not named as prose) and is_key_eligible (short and atomic)."""
    short = F.col("mean_token_length") <= MAX_TOKEN
    d = measures.withColumn("is_non_atomic", ((names.is_freetext_name(F.col("column_name")) == 0) & (F.col("list_like_ratio") >= LIST_RATIO) & short).cast("int"))
    return d.withColumn("is_key_eligible", (short & (F.col("is_non_atomic") == 0)).cast("int"))
