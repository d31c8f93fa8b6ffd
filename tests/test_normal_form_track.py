"""Golden cases of dependencies, dependency algebra, change feed and votes."""

from pyspark.sql import functions as F

from tablewright.operators import changefeed, combos, dependencies, evaluation, fd_algebra

FORMS = [
    ("one key", ["ship", "tonnage", "flag"], [(["ship"], ["tonnage", "flag"])], False, 3),
    ("part of a key", ["ship", "voyage", "cargo", "tonnage"], [(["ship", "voyage"], ["cargo"]), (["ship"], ["tonnage"])], False, 1),
    ("over a non-key", ["voyage", "port", "country"], [(["voyage"], ["port"]), (["port"], ["country"])], False, 2),
    ("equal keys", ["p", "q", "r"], [(["p"], ["q", "r"]), (["q"], ["p", "r"])], False, 3),
    ("prime dependent", ["dock", "shift", "crane"], [(["dock", "shift"], ["crane"]), (["crane"], ["dock"])], False, 3),
    ("nothing known", ["p", "q"], [], False, 3),
    ("both", ["ship", "voyage", "cargo", "owner", "owner_seat"], [(["ship", "voyage"], ["cargo"]), (["ship"], ["owner"]), (["owner"], ["owner_seat"])], False, 1),
    ("lists", ["ship", "flags"], [(["ship"], ["flags"])], True, 0),
]
MANIFEST = "rel_id string, attributes array<string>, fds array<struct<lhs:array<string>,rhs:array<string>>>, violates_1nf boolean"


def test_normal_forms(spark):
    m = spark.createDataFrame([r[:4] for r in FORMS], MANIFEST)
    got = {r.rel_id: (r.normal_form, r["keys"]) for r in fd_algebra.normal_forms(m).collect()}
    assert {k: v[0] for k, v in got.items()} == {r[0]: r[4] for r in FORMS}
    assert got["equal keys"][1] == "p,q" and got["prime dependent"][1] == "crane+shift,dock+shift" and got["nothing known"][1] == "p+q"


def test_fd_text_round_trip(spark):
    m = spark.createDataFrame([r[:4] for r in FORMS[1:2]], MANIFEST)
    text = m.select(fd_algebra.encode_fds(F.col("fds")).alias("t"))
    assert text.first().t == '[[["ship"],["tonnage"]],[["ship","voyage"],["cargo"]]]'
    assert text.select(fd_algebra.decode_fds(F.col("t")).alias("f")).first().f[0].lhs == ["ship"]
    renamed = m.select(fd_algebra.rename_fds(F.col("fds"), F.create_map(F.lit("cargo"), F.lit("load"))).alias("f")).first().f
    assert renamed[0].rhs == ["load"]


def stats(spark, rows, distinct, pairs):
    s = spark.createDataFrame([("t", c, i, n, n, 1, rows, rows) for i, (c, n) in enumerate(distinct.items(), 1)], "table_name string, column_name string, ordinal_position int, n_distinct long, n_full long, is_key_eligible int, row_count long, total_rows long")
    return s, spark.createDataFrame([("t", sorted(k.split("+")), n) for k, n in pairs.items()], "table_name string, cols array<string>, n_distinct long")


def test_dependencies_from_counts(spark):
    fds = lambda *a: {(r.lhs, r.rhs) for r in dependencies.find_dependencies(*stats(spark, *a)).collect()}
    assert fds(100, {"a": 10, "b": 5}, {"a+b": 10}) == {("a", "b")}
    assert fds(100, {"a": 10, "b": 5}, {"a+b": 40}) == set()
    assert fds(100, {"a": 100, "b": 5}, {"a+b": 100}) == set()


def test_pair_candidates(spark):
    """A pair that repeats may determine a third column; one that a half of it determines, or that has more values, is not tried."""
    d = {"dock": 5, "shift": 4, "crane": 9, "voyage": 90, "zone": 3}
    p = {"dock+shift": 20, "crane+dock": 18, "crane+shift": 19, "dock+voyage": 90, "shift+voyage": 90, "crane+voyage": 90, "dock+zone": 5, "shift+zone": 12, "crane+zone": 15, "voyage+zone": 90}
    got = {(tuple(r.lhs), r.rhs) for r in dependencies.pair_fd_candidates(*stats(spark, 120, d, p)).collect()}
    assert (("dock", "shift"), "crane") in got and (("dock", "shift"), "zone") not in got and (("dock", "shift"), "voyage") not in got
    assert dependencies.pair_fd_candidates(*stats(spark, 120, d, p), 1).count() == 1


def test_null_is_a_value(spark):
    d = spark.createDataFrame([(1, None), (1, 2), (None, None), (1, None)], "a int, b int")
    got = {tuple(r["cols"]): r.n_distinct for r in combos.combo_distinct(d, [["a"], ["b"], ["a", "b"]], "t").collect()}
    assert got == {("a",): 2, ("b",): 2, ("a", "b"): 3}


def test_snapshot_diff(spark):
    s = "database string, schema string, table_name string, row_count long, column_count int"
    before = spark.createDataFrame([("d", "s", "rows", 100, 8), ("d", "s", "fewer", 100, 8), ("d", "s", "both", 100, 8), ("d", "s", "gone", 1, 1), ("d", "s", "same", 5, 5)], s)
    now = spark.createDataFrame([("d", "s", "rows", 150, 8), ("d", "s", "fewer", 40, 8), ("d", "s", "both", 150, 9), ("d", "s", "new", 1, 1), ("d", "s", "same", 5, 5)], s)
    got = {r.table_name: r.change_type for r in changefeed.diff_snapshots(now, before).collect()}
    assert got == {"rows": "row_count_changed", "fewer": "row_count_changed", "both": "schema_changed", "new": "new_table"}


def test_soft_vote(spark):
    rows = [("t", {"1": 0.45, "2": 0.55}), ("t", {"1": 0.45, "2": 0.55}), ("t", {"1": 0.95, "2": 0.05}), ("t", None), ("u", {"3": 0.5, "0": 0.5})]
    got = {r.table_name: r for r in evaluation.soft_vote(spark.createDataFrame(rows, "table_name string, probabilities map<string,double>")).collect()}
    assert got["t"].prediction == 1 and got["t"].n_columns == 3 and got["u"].prediction == 0


def test_average_precision_is_the_step_sum(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)]
    got = evaluation.average_precision(spark.createDataFrame(rows, "label int, score double")).first()[0]
    assert abs(got - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12


def test_folds_are_disjoint(spark):
    rows = [(i, f"g{i % 17}", int(i % 5 == 0)) for i in range(400)]
    d = evaluation.grouped_stratified_folds(spark.createDataFrame(rows, "id long, g string, y int"), "g", "y", 4)
    assert d.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and d.count() == 400
