"""Sources, recipes, features, gates and monitors on small tables."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import evaluation, fd_algebra, features, monitor, quality, ranked, recipes
from tablewright.plans.star import COLUMNS
from tablewright.sources import shared, tables
from tablewright.sources.ledger import Ledger
from tablewright.streaming import feeds, reports


def test_labelled_csv_and_staging(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,n,label\na,1,1\nb,,0\n")
    d = tables.read_labelled_csv(spark, str(tmp_path / "p.csv"), "name string, n int, label int")
    assert [tuple(r) for r in d.collect()] == [("a", 1, 1), ("b", None, 0)]
    (tmp_path / "bad.csv").write_text("name,n,label\na,x,1\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_labelled_csv(spark, str(tmp_path / "bad.csv"), "name string, n int, label int").collect()
    path = str(tmp_path / "staging")
    tables.write_staging(d, path)
    tables.write_staging(d.limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_results_are_kept_and_columns_verified(spark, tmp_path):
    path = str(tmp_path / "results")
    for day in ("2024-01-01", "2024-01-02"):
        tables.append_results(spark.range(3).withColumn("run_date", F.lit(day)), path)
    assert spark.read.parquet(path).groupBy("run_date").count().orderBy("run_date").collect()[1]["count"] == 3
    assert tables.materialise(spark.range(2), str(tmp_path / "t"), ["id"]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        tables.materialise(spark.range(2), str(tmp_path / "u"), ["id", "more"])


def test_resumable_build(spark, tmp_path):
    made = []

    def unit(name, fail=False):
        def make():
            if fail:
                raise RuntimeError("stopped")
            made.append(name)
            return spark.range(2)

        return make

    path = str(tmp_path / "build")
    with pytest.raises(RuntimeError):
        tables.resumable_build(spark, {"a": unit("a"), "b": unit("b", True)}, path)
    got = tables.resumable_build(spark, {"a": unit("a"), "b": unit("b")}, path)
    assert made == ["a", "b"] and got.groupBy("unit").count().count() == 2


def small_star(spark):
    """A star of a few rows a table, in the columns of the given one."""
    rng, n = random.Random(1), {"region": 3, "nation": 6, "customer": 40, "supplier": 10, "part": 12, "orders": 120, "lineitem": 300}
    value = {"integer": lambda: rng.randrange(5), "bigint": lambda: rng.randrange(10), "double": lambda: float(rng.randrange(50)), "varchar": lambda: rng.choice(["aa", "bb", "cc"]), "timestamp": lambda: None}
    of = {"regionkey": "region", "nationkey": "nation", "custkey": "customer", "suppkey": "supplier", "partkey": "part", "orderkey": "orders"}
    out = {}
    for t, text in COLUMNS.items():
        cols, rows = [c.split() for c in text.split(", ")], []
        for i in range(n[t]):
            row = {c: rng.randrange(n[of[c]]) if c in of else value[k]() for c, k in cols}
            row |= {c: i for c, _ in cols if recipes.KEYS[t] == [c]}
            row |= {"name": f"{t} {i}"} if "name" in row else {}
            row |= {"linenumber": i} if t == "lineitem" else {}
            rows.append(Row(**row))
        schema = ", ".join(f"{c} {'string' if k == 'varchar' else 'int' if k == 'integer' else k}" for c, k in cols)
        out[t] = spark.createDataFrame(rows, schema)
    return out


def test_specs_and_their_labels(spark):
    tables_ = small_star(spark)
    specs = recipes.build_specs(tables_, limits=(None, 50))
    assert len(recipes.JOIN_RECIPES) == 23 and len(specs) == 2 * 2 * (23 + 12) and len({s.table_name for s in specs}) == len(specs)
    pairs = {}
    for s in specs:
        if "pair_id" in s.params:
            pairs.setdefault(s.params["pair_id"], set()).add(s.params["kind"])
    assert len(pairs) == 24 and all(v == {"injection", "control"} for v in pairs.values())
    labels = {r.rel_id: r.normal_form for r in fd_algebra.normal_forms(recipes.spec_manifest(spark, specs)).collect()}
    of = {(s.params["recipe"], s.params["kind"]): set() for s in specs}
    for s in specs:
        of[s.params["recipe"], s.params["kind"]].add(labels[s.table_name])
    assert all(len(v) == 1 for v in of.values())  # neither limit nor naming changes a label
    form = {k: v.pop() for k, v in of.items()}
    for name, want in (("customer_alone", 3), ("nation_alone", 3), ("lines_alone", 3), ("nation_in_region", 2), ("orders_of_region", 2), ("orders_coded", 2), ("lines_coded", 2), ("lines_of_order", 1), ("lines_of_all", 1), ("lines_of_part", 2), ("lines_of_supplier", 2)):
        assert form[name, "join"] == want, name
    assert all(v == {"injection": 0, "control": 3}[kind] for (_, kind), v in form.items() if kind != "join")
    for s in specs[:23] + specs[35:40] + specs[23:35]:  # the tables have the declared columns, and the declared dependencies hold
        df = s.relation.build()
        assert df.columns == s.relation.attributes
        checks = [F.count_distinct(F.struct(*a)).alias(f"a{i}") for i, (a, _) in enumerate(s.relation.fds)] + [F.count_distinct(F.struct(*a, *b)).alias(f"b{i}") for i, (a, b) in enumerate(s.relation.fds)]
        got = df.agg(*checks).first()
        assert all(got[f"a{i}"] == got[f"b{i}"] for i in range(len(s.relation.fds))), s.params


def test_axis_sweep(spark):
    rows = [r.asDict() for r in recipes.axis_sweep(spark, 300).collect()]
    assert len(rows) == 300 and all(r["target"] == r["id"] % 4 for r in rows)
    for axis in recipes.SWEEP:  # no axis tells the target
        for v in {r[axis] for r in rows}:
            assert {r["target"] for r in rows if r[axis] == v} == {0, 1, 2, 3}
    chosen = rows[:12]
    specs = [recipes.Spec(f"t{r['id']}", recipes.swept_relation(spark, r)) for r in chosen]
    labels = {r.rel_id: r.normal_form for r in fd_algebra.normal_forms(recipes.spec_manifest(spark, specs)).collect()}
    assert [labels[f"t{r['id']}"] for r in chosen] == [r["target"] for r in chosen]
    for s, r in zip(specs, chosen, strict=True):
        df = s.relation.build()
        assert df.columns == s.relation.attributes and len(df.columns) == r["attributes"] and df.count() == r["rows"]
        got = df.agg(*(F.count_distinct(row_of(a)).alias(f"a{i}") for i, (a, _) in enumerate(s.relation.fds)), *(F.count_distinct(row_of(a + b)).alias(f"b{i}") for i, (a, b) in enumerate(s.relation.fds))).first()
        assert all(got[f"a{i}"] == got[f"b{i}"] for i in range(len(s.relation.fds)))


def row_of(columns):
    return F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("~")).alias(c) for c in columns))


def test_synthetic_relation_holds_what_it_declares(spark):
    d = recipes.synthetic_relation(spark, 400, [20, 20], {"free": 7}, {"part": (["k0"], 3), "far": (["free"], 4)}, null_every=5)
    n = d.agg(F.count_distinct("k0", "k1"), F.count_distinct(row_of(["k0"])), F.count_distinct(row_of(["k0", "part"])), F.count_distinct(row_of(["free"])), F.count_distinct(row_of(["free", "far"])), F.count_if(F.col("part").isNull())).first()
    assert n[0] == 400 and n[1] == n[2] and n[3] == n[4] and n[5] > 0


def test_training_set_and_manifest(spark):
    t = small_star(spark)
    specs = [s for s in recipes.build_specs(t, [None], ["real"]) if s.params["recipe"] in ("customer_in_nation", "orders_alone", "list_lineitem_returnflag")]
    manifest = fd_algebra.manifest_rows(recipes.spec_manifest(spark, specs))
    assert {r.normal_form for r in manifest.collect()} == {0, 2, 3} and "fds" in manifest.columns and "params" in manifest.columns
    got = features.training_set({s.table_name: s.relation.build() for s in specs[:2]}, manifest)
    rows = got.collect()
    assert len(rows) == sum(len(s.relation.attributes) for s in specs[:2])
    assert len([c for c in got.columns if c.startswith(("col_", "table_")) and c != "table_name"]) == 48 and {r.normal_form for r in rows} == {2, 3}
    joined = {r.column_name: r for r in rows if r.table_name == next(s.table_name for s in specs if s.params["recipe"] == "customer_in_nation")}
    assert joined["custkey"].col_unique_ratio == 1 and joined["custkey"].col_in_candidate_key == 1 and joined["nationkey"].table_fd_count > 0 and joined["custkey"].table_search_truncated == 0


def test_features_of_an_empty_table(spark):
    rows = features.build_features(spark.createDataFrame([], "a int, b string"), "empty").collect()
    assert len(rows) == 2 and rows[0].table_row_count == 0 and rows[0].table_has_no_ucc_le3 == 1 and rows[0].table_sample_ratio == 1.0


def test_label_against_discovered(spark):
    m = spark.createDataFrame([("t", ["k", "a", "b"], [(["k"], ["a", "b"])], False), ("u", ["k", "a"], [(["k"], ["a"])], False)], "rel_id string, attributes array<string>, fds array<struct<lhs: array<string>, rhs: array<string>>>, violates_1nf boolean")
    got = {r.rel_id: r for r in quality.label_against_discovered(m, spark.createDataFrame([("t", ["a"], "b")], "table_name string, lhs array<string>, rhs string")).collect()}
    assert (got["t"].declared_form, got["t"].discovered_form, got["t"].changes) == (3, 2, True) and not got["u"].changes


def test_schema_check(spark):
    got = {tuple(r) for r in quality.schema_check(spark.createDataFrame([(1, "x")], "a int, c string"), ["a", "b"], ["a", "c"]).collect()}
    assert got == {("missing", "b"), ("unexpected", "c"), ("not_numeric", "c")}


def test_baseline_gate(spark):
    m = spark.createDataFrame([("table", 0.95, 0.02), ("column", 0.90, 0.02), ("spread", 0.99, 0.2), ("groups", 250.0, None)], "name string, value double, std double")
    got = {r.name: r.passed for r in evaluation.baseline_gate(m, {"table": 0.92, "column": 0.94}, {"groups": 300}).collect()}
    assert got == {"table": True, "column": False, "spread": False, "groups": False}


def test_column_roles(spark):
    rows = [(1, 0.5, True, "x", None, 2), (2, 0.5, False, "y", None, 9), (3, 1.5, None, "z", None, 2), (None, None, True, None, None, None)]
    d = spark.createDataFrame(rows, "a int, b double, c boolean, d string, e int, f int")
    assert {r.column_name: r.role for r in monitor.infer_column_roles(d).collect()} == {"a": "numerical", "b": "categorical", "c": "categorical", "d": "skipped", "e": "categorical", "f": "categorical"}


def test_backtest_fails_if_all_fail(spark):
    d = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    good = lambda rows: rows.withColumn("prediction", F.when(F.col("id") % 10 > 0, F.col("label"))).withColumn("probability", F.lit(0.9))
    r = monitor.backtest(d, good, "label", ["id"], 100).first()
    assert 95 <= r.replayed <= 105 and 0 < r.failed < r.replayed and r.accuracy == 1.0 and not r.all_failed
    bad = lambda rows: rows.withColumn("prediction", F.lit(None).cast("int")).withColumn("probability", F.lit(None).cast("double"))
    r = monitor.backtest(d, bad, "label", ["id"], 100).first()
    assert r.all_failed and r.failed == r.replayed


def test_votes_and_one_vs_rest(spark):
    votes = spark.createDataFrame([("a", 3), ("b", 1)], "table_name string, prediction int")
    truth = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "table_name string, truth int")
    r = evaluation.vote_gate(votes, truth, floor=0.3).first()
    assert r.tables == 3 and abs(r.accuracy - 1 / 3) < 1e-12 and r.passed
    rows = [("x", {"x": 0.9, "y": 0.1}), ("y", {"x": 0.6, "y": 0.4}), ("x", {"x": 0.5, "y": 0.5})]
    got = {r["class"]: r.average_precision for r in evaluation.one_vs_rest_precision(spark.createDataFrame(rows, "label string, probabilities map<string,double>"), ["x", "y"]).collect()}
    assert abs(got["x"] - (0.5 + 0.5 * 2 / 3)) < 1e-12 and abs(got["y"] - 0.5) < 1e-12 and abs(got["weighted"] - (2 * got["x"] + got["y"]) / 3) < 1e-12


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("values", [list(range(500)), [1.5] * 3, [], [0.1 * (i * i % 97) for i in range(400)]])
def test_running_sums(spark, values, descending):
    rng = random.Random(1)
    rows = [(float(v), g, rng.randrange(9)) for g in "ab" for v in sorted(set(values))]
    got = ranked.running_sums(spark.createDataFrame(rows, "v double, g string, n long"), "v", ["n"], ["g"], descending, ranges=7).collect()
    assert len(got) == len(rows)
    for r in got:
        inside = [n for v, g, n in rows if g == r.g and (v >= r.v if descending else v <= r.v)]
        assert r.n_upto == sum(inside) and r.n_all == sum(n for _, g, n in rows if g == r.g)


def due_reports(events, size, every):
    """What classification_reports() gives for one track, event by event."""
    wait, window, out = size, [], []
    for e in events:
        window, wait = [*window, e][-size:], wait - 1
        if wait <= 0 and len({t for _, t, _ in window}) == 2:
            out.append((min(i for i, *_ in window), max(i for i, *_ in window), *(sum((t, p) == k for _, t, p in window) for k in ((1, 1), (0, 1), (1, 0), (0, 0)))))
            wait = every
    return out


def test_classification_windows_wait_for_both_classes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "t" if i % 3 else "u", None if i % 17 == 0 else int(rng.random() < 0.5) if i > 60 else 0, i % 2) for i in range(200)]
    schema = "event_id long, track string, target int, prediction int"
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("event_id").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
    got = reports.classification_reports(stream, Ledger(spark, str(tmp_path / "ledger")), 10, 5).collect()
    for track in "tu":
        want = due_reports([(i, t, p) for i, k, t, p in rows if k == track and t is not None], 10, 5)
        assert [tuple(r)[2:] for r in sorted(got, key=lambda r: r.report) if r.track == track] == want and want


def test_notifications_wake_one_diff_a_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "notes"))
    seen = []
    notes = spark.readStream.schema(T.StructType([T.StructField("id", T.LongType())])).parquet(str(tmp_path / "notes"))
    run = lambda: feeds.notification_stream(notes, lambda: spark.range(2), lambda d, n: seen.append(("record", n, d.count())), lambda: seen.append("watermark"), str(tmp_path / "check")).awaitTermination()
    run()
    assert seen == [("record", 0, 2), "watermark"]
    run()  # nothing new: nothing wakes
    spark.range(1).write.mode("append").parquet(str(tmp_path / "notes"))
    run()
    assert seen == [("record", 0, 2), "watermark", ("record", 1, 2), "watermark"]


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
