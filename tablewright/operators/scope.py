"""Features of a column from the other tables of its scope: metadata joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import names
from tablewright.sources.shared import written

NEEDED = {"table_name", "column_name", "is_unique"}


#: Table variants of one table: its name, singular and plural.
MOST_VARIANTS = 3
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct substrings of GRAM characters; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def references(stems: DataFrame, variants: DataFrame, scope: Sequence[str]) -> DataFrame:
    """What the stems of a scope may refer to: scope, stem, is_variant (the stem is itself a table variant) and within, up to
    MOST_VARIANTS + 1 of the variants that hold a stem of GRAM characters or more.

    stems: scope, stem; variants: scope, v; each once. Variants are indexed by their substrings of GRAM characters, a stem looks only at those
    under its rarest one, so no row meets all tables of its scope. A table takes its own variants out of what its columns refer to; as these
    are MOST_VARIANTS at most, the variants that are kept always show whether another is left.
    """
    s = list(scope)
    index = variants.select(*s, "v", F.explode(_grams(F.col("v"))).alias("gram"))
    counts = index.groupBy(*s, "gram").agg(F.count("*").alias("n"))
    parts = stems.select(*s, "stem", F.size(_grams(F.col("stem"))).alias("grams"), F.explode(_grams(F.col("stem"))).alias("gram"))
    rarest = parts.join(counts, [*s, "gram"]).groupBy(*s, "stem", "grams").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    met = rarest.where("found = grams").select(*s, "stem", "gram").join(index, [*s, "gram"]).where(F.col("v").contains(F.col("stem")))
    few = met.withColumn("place", F.row_number().over(Window.partitionBy(*s, "stem").orderBy("v"))).where(F.col("place") <= MOST_VARIANTS + 1)
    within = few.groupBy(*s, "stem").agg(F.collect_set("v").alias("within"))
    same = variants.select(*s, F.col("v").alias("stem"), F.lit(True).alias("is_variant"))
    return stems.join(same, [*s, "stem"], "left").join(within, [*s, "stem"], "left")


def add_cross_table_features(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Seven features of each row from its scope; all rows stay. Missing columns are an error.

    Names compare in lower case. A scope's table variants, without the own table's, are what a name can refer to: a variant that the
    own table has too is taken out, whichever table gave it. Tables of a name are counted, never gathered; references are looked up once
    for each stem of a scope.
    """
    missing = (NEEDED | set(scope)) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    s = list(scope)
    d = df.withColumn("_t", F.lower("table_name")).withColumn("_c", F.lower("column_name")).withColumn("_stem", names.stem(F.col("column_name"))).withColumn("_own", names.table_variants(F.col("table_name")))
    d = written(d)  # read several times, where df may be the outcome of scans of whole tables
    by_table = d.groupBy(*s, "_c", "_t").agg(F.max((F.coalesce("is_unique", F.lit(0)) == 1).cast("int")).alias("_unique_here"))
    by_name = by_table.groupBy(*s, "_c").agg(F.count("*").alias("_tables"), F.sum("_unique_here").alias("_unique"))
    found = references(d.select(*s, F.col("_stem").alias("stem")).distinct(), d.select(*s, F.explode("_own").alias("v")).distinct(), s).withColumnRenamed("stem", "_stem")
    d = d.join(by_table, [*s, "_c", "_t"]).join(by_name, [*s, "_c"]).join(found, [*s, "_stem"])
    elsewhere = F.col("_unique") - F.col("_unique_here") > 0
    exact = F.coalesce("is_variant", F.lit(False)) & ~F.array_contains("_own", F.col("_stem"))
    fuzzy = F.coalesce(F.size(F.array_except("within", "_own")) > 0, F.lit(False))
    return (
        d.withColumn("n_other_tables_with_same_column_name", (F.col("_tables") - 1).cast("int"))
        .withColumn("name_unique_in_other_table", names.flag(elsewhere))
        .withColumn("is_non_unique_and_name_unique_elsewhere", names.flag(elsewhere & (F.col("is_unique") == 0)))
        .withColumn("name_references_other_table_exact", names.flag(exact))
        .withColumn("name_references_other_table_fuzzy", names.flag(exact | fuzzy))
        .withColumn("name_ends_with_id_no_underscore", names.ends_with_bare_id(F.col("column_name")))
        .withColumn("name_ends_with_code_or_num", names.ends_with_code(F.col("column_name")))
        .select(*df.columns, *FEATURES)
    )


FEATURES = ["n_other_tables_with_same_column_name", "name_unique_in_other_table", "is_non_unique_and_name_unique_elsewhere", "name_references_other_table_exact", "name_references_other_table_fuzzy", "name_ends_with_id_no_underscore", "name_ends_with_code_or_num"]


def scope_augmented_variants(df: DataFrame, widths: Sequence[int | None] = (1, 5, None), database: str = "database") -> DataFrame:
    """The rows once for each scope width, with features from scopes of that many databases (None: all in one).

    df may be the outcome of scans of whole tables: it is computed once for all widths."""
    df = written(df)
    codes = df.select(database).distinct().withColumn("_code", F.row_number().over(Window.orderBy(database)) - 1)
    d, out = df.join(codes, database), None
    for width in widths:
        bucket = F.lit(0) if width is None else F.floor(F.col("_code") / width)
        one = add_cross_table_features(d.withColumn("_bucket", bucket.cast("long")), ["_bucket"])
        one = one.withColumn("scope_width", F.lit("all" if width is None else str(width))).drop("_bucket", "_code")
        out = one if out is None else out.unionByName(one)
    return out


def serving_scope(run: DataFrame, columns: DataFrame, queue: DataFrame, scope: Sequence[str] = ("database", "schema")) -> DataFrame:
    """The run's rows with features from their whole schema.

    Whether a column of the scope is unique comes from this run, else from the newest queue row, else it is 0. Only the run's rows are
    returned.
    """
    key = ["database", "schema", "table_name", "column_name"]
    newest = Window.partitionBy(*key).orderBy(F.desc("id"))
    last = queue.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*key, F.col("is_unique").alias("_queued"))
    rest = columns.select(key).join(run.select(key), key, "left_anti").join(last, key, "left").withColumn("is_unique", F.coalesce("_queued", F.lit(0))).drop("_queued")
    both = run.withColumn("_run", F.lit(True)).unionByName(rest.withColumn("_run", F.lit(False)), allowMissingColumns=True)
    both = both.join(run.select(*scope).distinct(), list(scope), "left_semi")
    return add_cross_table_features(both, list(scope)).where("_run").drop("_run")
