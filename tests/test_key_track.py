"""Golden cases of profiles, names and scopes."""

import random

from pyspark.sql import functions as F

from tablewright.functions import names
from tablewright.operators import profile, scope
from tablewright.sources.tables import discover_columns


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


def test_stems_and_variants(spark):
    cases = {"player_id": "player", "artistid": "artist", "dept_code": "dept", "emp_num": "emp", "flight_ref": "flight", "country": "country", "cid": "cid", "team_id": "team"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", names.stem(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in got} == cases
    assert one(spark, "orders", names.table_variants) == ["order", "orders"]
    assert one(spark, "categories", names.table_variants) == ["categorie", "categories", "category"]


def test_underscore_in_table_name_is_a_wildcard(spark):
    d = spark.createDataFrame([("hasXpet_id", "has_pet"), ("pet", "has_pet")], "c string, table_name string")
    assert [r[0] for r in d.select(names.contains_table_name("c", "table_name")).collect()] == [1, 0]


def test_repeating_groups(spark):
    rows = [("a", c) for c in ("id", "phone1", "phone2", "phone3")] + [("b", "id"), ("b", "phone1")] + [("c", f"col_{i:02d}") for i in range(1, 13)]
    got = names.repeating_groups(spark.createDataFrame(rows, "table_name string, column_name string")).collect()
    assert {(r.table_name, r.column_name) for r in got} == {("a", "phone1"), ("a", "phone2"), ("a", "phone3")}


def test_profile_of_nulls_and_empty_tables(spark):
    full = spark.createDataFrame([(1, None, "x"), (2, "a", "x"), (3, "a", None)], "id long, s string, t string")
    empty = spark.createDataFrame([], "id long")
    tables = {"full": full, "empty": empty}
    got = {(r.table_name, r.column_name): r for r in profile.profile_columns(discover_columns(spark, tables), tables).collect()}
    assert (got["full", "s"].number_unique_values, got["full", "s"].null_count, got["full", "s"].is_unique) == (1, 1, 0)
    assert got["full", "id"].is_unique == 1 and got["full", "id"].is_first_unique_column == 1
    assert got["empty", "id"].is_unique == 1 and got["empty", "id"].unique_ratio == 0 and got["empty", "id"].null_ratio == 0


def test_near_unique_is_strict(spark):
    rows = [("d", "s", "t", "a", 1, 95, 100, 0, 0.0, 0, "varchar", False), ("d", "s", "t", "b", 2, 96, 100, 0, 0.0, 0, "varchar", False)]
    stats = spark.createDataFrame(rows, "database string, schema string, table_name string, column_name string, ordinal_position int, number_unique_values long, count long, null_count long, null_ratio double, is_unique int, column_type string, is_nested boolean")
    got = profile.with_table_features(profile.with_column_features(stats)).collect()
    assert {r.table_near_unique_column_count for r in got} == {1} and {r.table_has_no_single_pk_candidate for r in got} == {1}


def test_cross_table_scope(spark):
    rows = [("uni", "student", "stuid", 1), ("uni", "student", "lname", 0), ("uni", "has_pet", "stuid", 0), ("uni", "has_pet", "petid", 0)]
    d = spark.createDataFrame(rows, "database string, table_name string, column_name string, is_unique int")
    got = {(r.table_name, r.column_name): r for r in scope.add_cross_table_features(d, ["database"]).collect()}
    assert got["has_pet", "stuid"].name_unique_in_other_table == 1 and got["has_pet", "stuid"].is_non_unique_and_name_unique_elsewhere == 1
    assert got["student", "stuid"].is_non_unique_and_name_unique_elsewhere == 0
    try:
        scope.add_cross_table_features(d.drop("is_unique"), ["database"])
    except ValueError as e:
        assert "is_unique" in str(e)
    else:
        raise AssertionError("missing columns must be an error")


def test_distinct_counts_by_words(spark):
    """Dense and sparse numbers, ends of the range, dates, texts and nulls, against plain distinct counts; words in place of values."""
    rows = [(i, -i // 3, (i * i * 7919) % (1 << 40), None if i % 5 else i, f"t{i % 50}", float(i % 7), bool(i % 2)) for i in range(4000)]
    rows += [(2**31 - 1, -(2**63), 2**63 - 1, None, None, None, None), rows[0]]
    d = spark.createDataFrame(rows, "a int, b long, c long, d short, e string, f double, g boolean").withColumn("h", F.date_add(F.lit("2020-01-01").cast("date"), F.col("a") % 1000))
    d = d.withColumn("i", F.when(F.col("a") < 4000, F.col("a")))
    tables = {"t": d, "u": d.limit(0)}
    got = {(r.table_name, r.column_name): r for r in profile.column_stats(discover_columns(spark, tables), tables).collect()}
    want = d.agg(*(F.count_distinct(c).alias(c) for c in d.columns)).first()
    nulls = d.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in d.columns)).first()
    assert {c: (got["t", c].number_unique_values, got["t", c].null_count, got["t", c]["count"]) for c in d.columns} == {c: (want[c], nulls[c], 4002) for c in d.columns}
    assert all(got["u", c].number_unique_values == got["u", c]["count"] == 0 for c in d.columns)
    dense = {(r.table_name, r.ordinal_position) for r in profile.column_sketches(tables).collect() if profile.is_dense(r.low, r.high, r.estimate)}
    assert dense == {("t", 4), ("t", 8), ("t", 9)}
    key = ["table_name", "ordinal_position", "word"]
    assert profile.column_words(tables, dense).select(key).distinct().count() < 0.8 * profile.column_words(tables, set()).select(key).distinct().count()


def plain_features(rows):
    """The references of every row by looking at all tables of its scope."""
    stem = lambda c: next((c[: -len(e)].rstrip("_") if len(c[: -len(e)].rstrip("_")) >= 2 else c for e in ENDS if c.endswith(e)), c)
    variants = lambda t: {t, *([t[:-3] + "y"] if t.endswith("ies") else []), t[:-1] if t.endswith("s") else t + "s"}
    tables = {}
    for scope, t, *_ in rows:
        tables.setdefault(scope, set()).update(variants(t.lower()))
    unique, named = {}, {}
    for scope, t, c, u in rows:
        named.setdefault((scope, c.lower()), set()).add(t.lower())
        if u == 1:
            unique.setdefault((scope, c.lower()), set()).add(t.lower())
    out = []
    for scope, t, c, u in rows:
        x, others = stem(c.lower()), tables[scope] - variants(t.lower())
        elsewhere = bool(unique.get((scope, c.lower()), set()) - {t.lower()})
        exact = x in others
        out.append((scope, t, c, u, len(named[scope, c.lower()]) - 1, int(elsewhere), int(elsewhere and u == 0), int(exact), int(exact or (len(x) >= 3 and any(x in v for v in others)))))
    return out


ENDS = names.ID_SUFFIXES


def test_references_of_a_scope_of_ten_thousand_tables(spark):
    """Against all tables where they are few; and in a large scope, by what was planted there."""
    rng = random.Random(6)
    parts = ["ord", "er", "s", "cust", "omer", "cat", "egories", "x", "line", "it", "em", "orders", "ty"]
    name = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows = [(f"s{rng.randrange(3)}", name().upper() if rng.random() < 0.2 else name(), name() + rng.choice(["", "_id"]), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "scope string, table_name string, column_name string, is_unique int")
    got = scope.add_cross_table_features(df, ["scope"]).select("scope", "table_name", "column_name", "is_unique", *scope.FEATURES[:5]).collect()
    assert sorted(map(tuple, got)) == sorted(plain_features(rows))
    many = [("all", f"table{k:05d}", c, int(c == "id")) for k in range(10_000) for c in ("id", f"table{(k + 1) % 10_000:05d}_id", "le0_code", "zzz")]
    found = scope.add_cross_table_features(spark.createDataFrame(many, df.schema), ["scope"]).groupBy(F.regexp_replace("column_name", "[0-9]{5}", "N").alias("c")).agg(
        *(F.sum(x).alias(x) for x in scope.FEATURES[:5]), F.count("*").alias("n")).collect()
    assert {r.c: tuple(r)[1:] for r in found} == {"id": (10_000 * 9_999, 10_000, 0, 0, 0, 10_000), "tableN_id": (0, 0, 0, 10_000, 10_000, 10_000), "le0_code": (10_000 * 9_999, 0, 0, 0, 10_000, 10_000), "zzz": (10_000 * 9_999, 0, 0, 0, 0, 10_000)}
