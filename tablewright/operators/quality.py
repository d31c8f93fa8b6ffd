"""Data-quality checks of profile and training tables: each gives its violations as rows or counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import combos, fd_algebra


def schema_check(df: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """missing, unexpected and not_numeric columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    rows = [("missing", c) for c in required if c not in kinds] + [("unexpected", c) for c in kinds if c not in required]
    rows += [("not_numeric", c) for c in numeric if c in kinds and not isinstance(kinds[c], T.NumericType)]
    return df.sparkSession.createDataFrame(rows, "problem string, column_name string")


def label_against_discovered(manifest: DataFrame, discovered: DataFrame) -> DataFrame:
    """Whether the dependencies that the data show, added to the declared ones, would change a relation's label.

    manifest: rel_id, attributes, fds, violates_1nf; discovered: table_name, lhs (array), rhs. Returns rel_id, declared_form,
    discovered_form, changes and reason (what the added ones say).
    """
    found = discovered.groupBy(F.col("table_name").alias("rel_id")).agg(F.collect_list(F.struct("lhs", F.array("rhs").alias("rhs"))).alias("more"))
    union = manifest.join(found, "rel_id", "left").withColumn("fds", F.concat("fds", F.coalesce("more", F.expr("filter(fds, x -> false)")))).drop("more")
    of = lambda m, k: fd_algebra.normal_forms(m).select("rel_id", F.col("normal_form").alias(k), F.col("reason").alias(f"{k}_reason"))
    d = of(manifest, "declared_form").join(of(union, "discovered_form"), "rel_id")
    return d.select("rel_id", "declared_form", "discovered_form", (F.col("declared_form") != F.col("discovered_form")).alias("changes"), F.col("discovered_form_reason").alias("reason"))


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (true: broken), in one pass: (rule, violations)."""
    one = df.agg(*(F.count_if(r).alias(n) for n, r in rules.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))))


def domain_rules(flags: Sequence[str] = (), ratios: Sequence[str] = (), positive: Sequence[str] = (), counts: Sequence[str] = ()) -> dict[str, Column]:
    c = F.col
    return {f"{n} in 0, 1": ~c(n).isin(0, 1) for n in flags} | {f"{n} in [0, 1]": ~c(n).between(0, 1) for n in ratios} | {f"{n} >= 1": c(n) < 1 for n in positive} | {f"{n} >= 0": c(n) < 0 for n in counts}


def null_shares(df: DataFrame, columns: Sequence[str], most: dict[str, float]) -> DataFrame:
    """The share of nulls of each column, and whether it is within its limit."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)))
    cells = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"_{i}") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("null_share"), F.lit(most.get(c, 1.0)).alias("most")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*cells))).withColumn("passed", F.col("null_share") <= F.col("most"))


def class_balance(df: DataFrame, target: str, least: float = 0.01) -> DataFrame:
    """Share of label 1, both classes' presence, and whether the share is within [least, 1 - least]."""
    d = df.agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("share"), (F.count_distinct(target) == 2).alias("both_classes"))
    return d.withColumn("passed", F.col("both_classes") & F.col("share").between(least, 1 - least))


def consistency_rules() -> dict[str, Column]:
    """Of a column profile: what two columns say must agree."""
    c = F.col
    return {
        "unique means ratio 1": (c("is_unique") == 1) & (c("count") > 0) & (c("unique_ratio") != 1),
        "ratio 1 without nulls means unique": (c("unique_ratio") == 1) & (c("null_count") == 0) & (c("is_unique") == 0),
        "non-null means ratio 0": (c("is_non_null") == 1) & (c("null_ratio") != 0),
        "name_length": c("name_length") != F.length("column_name"),
    }


def group_constants(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which a column that should be constant is not: (column_name, violations)."""
    per = df.groupBy(*group).agg(*(F.count_distinct(c).alias(c) for c in columns))
    return count_violations(per, {c: F.col(c) > 1 for c in columns}).withColumnRenamed("rule", "column_name")


def exclusive(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that carry two labels that exclude each other."""
    return count_violations(df, {f"{a} and {b}": (F.col(a) == 1) & (F.col(b) == 1) for a, b in pairs})


def group_sanity(df: DataFrame, group: str, label: str, small: int) -> DataFrame:
    """Groups, small ones and ones of a single class."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") < small).alias("small_groups"), F.count_if(F.col("classes") == 1).alias("single_class_groups"))


def shared_groups(folds: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that are in two folds."""
    return folds.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def verify_fds(df: DataFrame, table: str, fds: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Whether each declared dependency holds in the data: the determinant counts as many as both sides together."""
    wanted = [c for lhs, rhs in fds for c in (sorted(lhs), sorted({*lhs, *rhs}))]
    n = combos.combo_distinct(df, wanted, table).distinct()
    d = df.sparkSession.createDataFrame([(list(map(str, lhs)), list(map(str, rhs)), sorted(lhs), sorted({*lhs, *rhs})) for lhs, rhs in fds], "lhs array<string>, rhs array<string>, l array<string>, b array<string>")
    of = lambda k: n.select(F.col("cols").alias(k), F.col("n_distinct").alias(f"n_{k}"))
    return d.join(of("l"), "l").join(of("b"), "b").select("lhs", "rhs", "n_l", "n_b", (F.col("n_l") == F.col("n_b")).alias("holds"))


def decoy_report(tables: DataFrame, fired: str, truth: str) -> DataFrame:
    """Precision and recall of a detector over tables, and whether it passes (1.0 and 0.9)."""
    f, t = F.col(fired), F.col(truth)
    d = tables.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    d = d.withColumn("precision", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(1.0))).withColumn("recall", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(1.0)))
    return d.withColumn("passed", (F.col("precision") == 1.0) & (F.col("recall") >= 0.9))


def label_noise(tables: DataFrame, by: str) -> DataFrame:
    """Tables labelled 0 in which no violation is to be seen, by naming."""
    return tables.where("normal_form = 0").groupBy(by).agg(F.count("*").alias("tables"), F.count_if(~F.col("visible")).alias("unseen"))


def without_key(tables: DataFrame, uccs: DataFrame) -> DataFrame:
    """Tables for which no key of up to three columns was found: reported, never failing."""
    return tables.join(uccs.select("table_name").distinct(), "table_name", "left_anti")


def key_ranking(uccs: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether the true key (table_name, cols) is among the found ones, and first. One row over all tables."""
    d = truth.join(uccs.select("table_name", "cols", "rank"), ["table_name", "cols"], "left")
    return d.agg(F.count("*").alias("tables"), F.count_if(F.col("rank").isNotNull()).alias("found"), F.count_if(F.col("rank") == 1).alias("first"))


def review_reasons(reasons: DataFrame) -> DataFrame:
    """All reasons of a table in one text."""
    return reasons.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("reason")), " | ").alias("review_reason"))


def refresh_review(manifest: DataFrame, reasons: DataFrame) -> DataFrame:
    """The manifest's review column set where there is a reason, and cleared where there is none."""
    r = review_reasons(reasons)
    kept = manifest.drop("needs_review", "review_reason")
    return kept.join(r, "table_name", "left").withColumn("needs_review", F.col("review_reason").isNotNull())
