"""Distinct counts of attribute combinations, with null as a value of its own."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ABOVE, SAMPLE_ROWS = 20_000, 10_000
MAX_COLUMNS = 60


def row_key(columns: Sequence[str]) -> Column:
    """A 64-bit hash of a combination's values; null is a value."""
    return F.xxhash64(*(x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))


def md5_slot(columns: Sequence[str], slots: int) -> Column:
    """Which of `slots` a row falls in, by the MD5 of its values as text: other engines compute it alike for integers."""
    digits = F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % slots


def sample_rows(df: DataFrame, rows: int, portable: Sequence[str] | None = None) -> DataFrame:
    """The whole table up to SAMPLE_ABOVE rows, else about SAMPLE_ROWS of them by a hash of the row: the same rows for every
    query, so that counts on them are comparable. A sample can invent a key or dependency: searches for these count whole tables."""
    if rows <= SAMPLE_ABOVE:
        return df
    slots = math.ceil(rows / SAMPLE_ROWS)
    slot = md5_slot(portable, slots) if portable else F.pmod(row_key(df.columns), F.lit(slots))
    return df.where(slot == 0)


def combo_distinct(df: DataFrame, combos: Sequence[Sequence[str]], table: str) -> DataFrame:
    """(table_name, cols, n_distinct) of each combination; cols sorted. One scan; each value once for each task before the
    shuffle. An empty table counts 0."""
    combos = [sorted(c) for c in combos]
    keys = F.array(*(F.struct(F.lit(i).alias("i"), row_key(c).alias("h")) for i, c in enumerate(combos)))
    counts = df.select(F.explode(keys).alias("k")).groupBy("k.i").agg(F.count_distinct("k.h").alias("n"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(combos)], "i int, cols array<string>")
    return names.join(counts, "i", "left").select(F.lit(table).alias("table_name"), "cols", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def paired_columns(columns: Sequence[str], prose: Sequence[str] = ()) -> list[str]:
    """The columns that pairs are made of: all up to MAX_COLUMNS, else prose goes first, then what stands last."""
    if len(columns) <= MAX_COLUMNS:
        return list(columns)
    return [c for c in columns if c not in set(prose)][:MAX_COLUMNS]


def pair_matrix(df: DataFrame, table: str, prose: Sequence[str] = ()) -> DataFrame:
    return combo_distinct(df, list(combinations(paired_columns(df.columns, prose), 2)), table)


def singles(df: DataFrame, table: str) -> DataFrame:
    return combo_distinct(df, [[c] for c in df.columns], table)
