"""Predicates and parts of column and table names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes in the order in which the first match is stripped.
ID_SUFFIXES = ("_id", "_key", "_num", "_code", "_ref", "_no", "_fk", "id", "key", "num", "code", "ref", "no")
#: Suffixes of code-like names.
CODE_SUFFIXES = ("_no", "_num", "_code", "_key", "_ref", "no", "num", "code", "ref")
#: Parts of names that mark prose.
FREETEXT_TOKENS = ("bemerkung", "kommentar", "comment", "beschreibung", "description", "freitext", "freetext", "memo", "notiz", "note", "zusatzinfo", "feedback", "review")
MIN_STEM = 2


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def ends_with_id(c: Column) -> Column:
    return flag(F.lower(c).endswith("_id"))


def contains_key(c: Column) -> Column:
    return flag(F.lower(c).contains("key"))


def contains_table_name(c: str, t: str) -> Column:
    """LIKE with the table's name as the pattern: an underscore in it stands for any character."""
    return flag(F.expr(f"lower({c}) LIKE concat('%', lower({t}), '%')"))


def is_singular_table_id(c: Column, t: Column) -> Column:
    one = F.when(F.lower(t).endswith("s"), F.expr("substring(lower(table_name), 1, length(table_name) - 1)")).otherwise(F.lower(t))
    return flag((F.length(t) > 1) & (F.lower(c) == F.concat(one, F.lit("_id"))))


def stem(c: Column) -> Column:
    """The name without its first matching suffix and the underscores before it; whole where less than two characters are left."""
    low, out = F.lower(c), None
    for s in ID_SUFFIXES:
        cut, hit = F.regexp_replace(low, f"_*{s}$", ""), low.endswith(s)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    out = out.otherwise(low)
    return F.when(F.length(out) >= MIN_STEM, out).otherwise(low)


def table_variants(t: Column) -> Column:
    """The table's name, and its plain singular or plural."""
    low = F.lower(t)
    ies = F.when(low.endswith("ies"), F.regexp_replace(low, "ies$", "y"))
    other = F.when(low.endswith("s"), F.regexp_replace(low, "s$", "")).otherwise(F.concat(low, F.lit("s")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(low, ies, other))))


def ends_with_bare_id(c: Column) -> Column:
    low = F.lower(c)
    return flag(low.rlike("(id|no)$") & ~low.rlike("(_id|_no)$"))


def ends_with_code(c: Column) -> Column:
    return flag(F.lower(c).rlike("(" + "|".join(CODE_SUFFIXES) + ")$"))


def is_freetext_name(c: Column, tokens: tuple[str, ...] = FREETEXT_TOKENS) -> Column:
    return flag(F.lower(c).rlike("|".join(tokens)))


def repeating_groups(columns: DataFrame) -> DataFrame:
    """Columns of numbered groups (phone1, phone2): two members or more of a stem; none if all columns of the table are grouped."""
    name = F.col("column_name")
    pattern = r"^(.*[\p{L}])_?(\d{1,2})$"
    key = F.when(name.rlike(pattern), F.lower(F.regexp_extract(name, pattern, 1)))
    table, group = Window.partitionBy("table_name"), Window.partitionBy("table_name", "stem")
    d = columns.withColumn("stem", key).withColumn("members", F.when(F.col("stem").isNotNull(), F.count("*").over(group)).otherwise(0))
    d = d.withColumn("grouped", F.col("members") >= 2)
    d = d.withColumn("all_grouped", F.min("grouped").over(table))
    return d.where("grouped and not all_grouped").select("table_name", "column_name", "stem", F.col("members").cast("long").alias("members"))
