"""Queries of dependency algebra, denormalisation recipes and the change feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import changefeed, dependencies, fd_algebra, recipes
from tablewright.plans.dependency_queries import _CN, CUSTOMER_NATION, _counts, _customer_nation
from tablewright.plans.star import columns_sql, star
from tablewright.sources.tables import REF, discover_columns

USE = ["custkey", "orderpriority", "n", "nationkey", "nation_name"]


def _use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a customer uses an order priority, with the customer's nation: key (custkey, orderpriority), partly dependent."""
    o = star(spark, sf_dir, ["orders"])["orders"].groupBy("custkey", "orderpriority").agg(F.count("*").alias("n"))
    return o.join(_customer_nation(spark, sf_dir).select("custkey", "nationkey", "nation_name"), "custkey").select(USE)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with the single-column dependencies that their data show, and their declared key."""
    out = []
    for name, df, key in (("customer_nation", _customer_nation(spark, sf_dir), ["custkey"]), ("priority_use", _use(spark, sf_dir), ["custkey", "orderpriority"])):
        stats, pairs, _ = dependencies.table_statistics(df, name)
        found = dependencies._directed(stats, pairs).where("n_pair = n_lhs and n_rhs > 1").select(F.array("lhs").alias("lhs"), F.array("rhs").alias("rhs"))
        rest = [c for c in df.columns if c not in key]
        fds = found.agg(F.collect_list(F.struct("lhs", "rhs")).alias("fds"))
        declared = F.array(F.struct(F.array(*map(F.lit, key)).alias("lhs"), F.array(*map(F.lit, rest)).alias("rhs")))
        out.append(fds.select(F.lit(name).alias("rel_id"), F.array(*map(F.lit, df.columns)).alias("attributes"), F.concat("fds", declared).alias("fds"), F.lit(False).alias("violates_1nf")))
    return reduce(DataFrame.unionByName, out)


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "+") for c in columns})


def normalised_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(fd_algebra.normalise_fds(manifest(spark, sf_dir)), "lhs", "rhs").distinct()


def fd_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(fd_algebra.closures(manifest(spark, sf_dir)), "closure")


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = fd_algebra.with_keys(manifest(spark, sf_dir)).withColumn("key", F.explode("keys"))
    shown = lambda c: F.array_join(F.array_sort(fd_algebra.names_of(F.col(c), F.col("attributes"))), "+")
    return keyed.select("rel_id", shown("key").alias("key"), shown("prime").alias("prime"))


def normal_form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd_algebra.normal_forms(manifest(spark, sf_dir)).select("rel_id", "normal_form", "keys")


def projected_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies after nationkey has been dropped."""
    m = manifest(spark, sf_dir).withColumn("keep", F.filter("attributes", lambda x: x != "nationkey"))
    return _text(fd_algebra.project_fds(m), "lhs", "rhs")


def join_ladder_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first 500 orders, with order, customer and nation folded in, and a pair-determined code."""
    t = star(spark, sf_dir, ["orders", "customer", "nation"])
    steps = [recipes.Step("customer", "custkey", "custkey", "customer_"), recipes.Step("nation", "customer_nationkey", "nationkey", "nation_")]
    out = recipes.build_join(t, "orders", ["orderkey"], steps, limit=500, drop=["orderdate"], derived={"code": recipes.pair_determined("orderpriority", "orderstatus")})
    return out


def list_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.list_injection(star(spark, sf_dir, ["lineitem"])["lineitem"], "orderkey", "returnflag")


def list_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.list_control(star(spark, sf_dir, ["lineitem"])["lineitem"], "orderkey", "returnflag", ["linenumber", "partkey", "suppkey", "returnflag"])


def repeating_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.repeating_pivot(star(spark, sf_dir, ["lineitem"])["lineitem"], "orderkey", "partkey").fillna(-1)


def pivot_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.pivot_control(star(spark, sf_dir, ["lineitem"])["lineitem"], "orderkey", "partkey")


def obfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.obfuscated(star(spark, sf_dir, ["supplier"])["supplier"])


# --- change feed: yesterday's snapshot is today's, but for orders and parts ------------------------------------------------


def _before(now: DataFrame) -> DataFrame:
    b = now.where("table_name <> 'region'")
    b = b.withColumn("column_count", F.expr("if(table_name = 'part', column_count - 1, column_count)"))
    return b.withColumn("row_count", F.expr("if(table_name in ('orders', 'part'), row_count - 10, row_count)"))


NOON = "2024-01-30 12:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.snapshot_tables(star(spark, sf_dir))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = snapshot(spark, sf_dir)
    return changefeed.diff_snapshots(now, _before(now))


PENDING = "database string, schema string, table_name string, change_type string, source string, detected_at timestamp, " + ", ".join(f"{t}_claimed_by string, {t}_claimed_at timestamp, {t}_completed_at timestamp" for t in changefeed.TRACKS)


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of today, recorded twice: by the poller, and by an announcement; and all tables' first load, long ago, done for keys."""
    none = spark.createDataFrame([], PENDING)
    now = snapshot(spark, sf_dir)
    first = changefeed.record_changes(none, changefeed.diff_snapshots(now, now.limit(0)), "load", _at("2024-01-01 00:00:00"))
    first, _ = changefeed.claim(first, "keys", "run-0", _at("2024-01-01 01:00:00"))
    first = changefeed.complete(first, "keys", "run-0", _at("2024-01-01 02:00:00"))
    first, _ = changefeed.claim(first, "nf", "run-0", _at("2024-01-01 01:00:00"))
    changes = changefeed.diff_snapshots(now, _before(now))
    return changefeed.record_changes(changefeed.record_changes(first, changes, "poller", _at(NOON)), changes.where("change_type <> 'new_table'"), "announced", _at(NOON))


def _shown(pending: DataFrame) -> DataFrame:
    return pending.select("table_name", "change_type", "source", *(F.coalesce(f"{t}_claimed_by", F.lit("-")).alias(f"{t}_claimed_by") for t in changefeed.TRACKS), *(F.col(f"{t}_completed_at").isNotNull().alias(f"{t}_completed") for t in changefeed.TRACKS))


def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_pending(spark, sf_dir))


def claimed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.claim(_pending(spark, sf_dir), "keys", "run-1", _at(NOON))[1]


def claim_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys: claimed, claimed again (no change) and completed; subject areas: claimed and released."""
    p, _ = changefeed.claim(_pending(spark, sf_dir), "keys", "run-1", _at(NOON))
    p, _ = changefeed.claim(p, "keys", "run-1", _at(NOON))
    p = changefeed.complete(p, "keys", "run-1", _at(NOON))
    p, _ = changefeed.claim(p, "subject_area", "run-2", _at(NOON))
    return _shown(changefeed.release_run(p, "subject_area", "run-2"))


def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = changefeed.claim(_pending(spark, sf_dir), "nf", "run-3", _at(NOON))
    return _shown(changefeed.release_stale(p, _at("2024-01-30 13:00:00")))


def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.count_unclaimed(_pending(spark, sf_dir))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all tables but orders; those of small tables' keys are processed, lineitem's first five are not."""
    c = discover_columns(spark, star(spark, sf_dir)).select(*REF, "column_name", "ordinal_position")
    q = c.where("table_name <> 'orders' and not (table_name = 'lineitem' and ordinal_position > 5)")
    n = F.when(F.col("table_name") == "lineitem", 100).otherwise(0)
    return q.withColumn("id", (n + F.length("table_name") * 1000 + F.col("ordinal_position")).cast("long")).withColumn("processed", F.col("table_name") != "lineitem")


def _enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = discover_columns(spark, star(spark, sf_dir)).select(*REF, "column_name", "ordinal_position")
    return changefeed.enqueue(_queue(spark, sf_dir), staged, requeue=snapshot_diff(spark, sf_dir))


def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enqueued(spark, sf_dir)


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.queue_status(_enqueued(spark, sf_dir))


def fetched_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.fetch_batch(_enqueued(spark, sf_dir), 7)


def marked_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models answered for ids that are no multiple of 3, one of them for the others."""
    q = _enqueued(spark, sf_dir)
    answers = q.where("not processed").select("id", F.explode(F.expr("if(id % 3 = 0, array('pk'), array('pk', 'fk'))")).alias("model"))
    return changefeed.mark_processed(q, answers, ["pk", "fk"]).select("id", "table_name", "column_name", "processed")


def fully_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.fully_queued_tables(discover_columns(spark, star(spark, sf_dir)), _queue(spark, sf_dir))


def leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.leftover_for_tables(_enqueued(spark, sf_dir), snapshot_diff(spark, sf_dir))


def processed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.processed_tables(_queue(spark, sf_dir).where("processed"))


QUERIES = {
    f.__name__: f
    for f in (
        normalised_fds, fd_closure, candidate_keys, normal_form_labels, projected_fds, join_ladder_orders, list_injection, list_control, repeating_pivot, pivot_control, obfuscated,
        snapshot, snapshot_diff, recorded_changes, claimed_tables, claim_cycle, stale_claims, open_work, enqueue_dedup, queue_status, fetched_batch, marked_processed, fully_queued, leftover, processed_tables,
    )
}

_SHIFT = 10


def _relation_sql(name: str, rel: str, columns: list[str], key: list[str]) -> str:
    bit = lambda c: f"(1 << (list_position({columns}, {c}) - 1))"
    k, rest = sum(1 << columns.index(c) for c in key), sum(1 << i for i, c in enumerate(columns) if c not in key)
    return f"""(WITH {rel}, {_counts(columns, (1, 2))}, s AS (SELECT cols[1] AS c, n FROM n WHERE len(cols) = 1),
        p AS (SELECT cols[1] AS l, cols[2] AS r, n FROM n WHERE len(cols) = 2 UNION ALL SELECT cols[2], cols[1], n FROM n WHERE len(cols) = 2)
        SELECT '{name}' AS rel_id, {columns} AS attrs, list({bit("l")} << {_SHIFT} | {bit("r")}) || [{k} << {_SHIFT} | {rest}] AS fds FROM p JOIN s a ON a.c = l JOIN s b ON b.c = r WHERE p.n = a.n AND b.n > 1)"""


_USE = """rel AS (SELECT o_custkey AS custkey, o_orderpriority AS orderpriority, count(*) AS n, any_value(c_nationkey) AS nationkey, any_value(n_name) AS nation_name
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
_MANIFEST = f"""m0 AS ({_relation_sql("customer_nation", _CN, CUSTOMER_NATION, ["custkey"])} UNION ALL {_relation_sql("priority_use", _USE, USE, ["custkey", "orderpriority"])}),
    m AS (SELECT *, (1 << len(attrs)) - 1 AS full_set, list_transform(range(len(fds) * len(fds)), lambda i: fds[i % len(fds) + 1]) AS reps FROM m0)"""
_CLOSURE = "list_reduce(reps, lambda a, f: CASE WHEN (a & (f >> 10)) = (f >> 10) THEN a | (f & 1023) ELSE a END, {x})"
_NAMES = "array_to_string(list_sort(list_filter(attrs, lambda c, i: ({x} >> (i - 1)) & 1 = 1)), '+')"
_KEYS = f"""{_MANIFEST}, sub AS (SELECT *, unnest(range(1, full_set + 1))::BIGINT AS x FROM m), sup AS (SELECT * FROM sub WHERE {_CLOSURE.format(x="x")} = full_set),
    k AS (SELECT * FROM sup a WHERE NOT EXISTS (SELECT 1 FROM sup b WHERE b.rel_id = a.rel_id AND b.x <> a.x AND (b.x & a.x) = b.x)),
    kp AS (SELECT rel_id, bit_or(x) AS prime, string_agg({_NAMES.format(x="x")}, ',' ORDER BY {_NAMES.format(x="x")}) AS keys FROM k GROUP BY rel_id)"""
_ORACLE_TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
_SNAP = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}" for t, n in zip(_ORACLE_TABLES, (5, 11, 3, 6, 6, 2, 4), strict=True))
_DIFF = "SELECT * FROM (VALUES ('region', 'new_table'), ('part', 'schema_changed'), ('orders', 'row_count_changed')) AS v(table_name, change_type)"
_FIRST = ", ".join(f"('{t}', 'new_table', 'load')" for t in _ORACLE_TABLES)


def _work(keys: str, nf: str, subject: str, first_nf: str = "'run-0'", keys_done: str = "false") -> str:
    return f"""WITH d AS ({_DIFF}), w AS (SELECT * FROM (VALUES {_FIRST}) AS v(table_name, change_type, source) UNION ALL SELECT table_name, change_type, 'poller' FROM d UNION ALL SELECT table_name, change_type, 'announced' FROM d WHERE change_type <> 'new_table')
        SELECT *, CASE WHEN source = 'load' THEN 'run-0' ELSE {keys} END AS keys_claimed_by, CASE WHEN source = 'load' THEN {first_nf} ELSE {nf} END AS nf_claimed_by, {subject} AS subject_area_claimed_by,
               source = 'load' OR {keys_done} AS keys_completed, false AS nf_completed, false AS subject_area_completed FROM w"""


_QUEUE = f"""c AS (SELECT database, schema, table_name, column_name, ordinal_position FROM ({columns_sql()})),
    q AS (SELECT *, CAST(CASE WHEN table_name = 'lineitem' THEN 100 ELSE 0 END + length(table_name) * 1000 + ordinal_position AS BIGINT) AS id, table_name <> 'lineitem' AS processed FROM c
          WHERE table_name <> 'orders' AND NOT (table_name = 'lineitem' AND ordinal_position > 5)),
    n AS (SELECT * FROM c WHERE (table_name = 'orders') OR (table_name = 'lineitem' AND ordinal_position > 5) OR table_name IN ('region', 'part')),
    e AS (SELECT * FROM q UNION ALL SELECT *, (SELECT max(id) FROM q) + row_number() OVER (ORDER BY database, schema, table_name, ordinal_position) AS id, false AS processed FROM n)"""
_LAKE = "'lake' AS database, 'star' AS schema"

ORACLE_SQL = {
    "normalised_fds": f"WITH {_MANIFEST} SELECT DISTINCT rel_id, {_NAMES.format(x='(f >> 10)')} AS lhs, {_NAMES.format(x='(f & 1023)')} AS rhs FROM (SELECT *, unnest(fds) AS f FROM m)",
    "fd_closure": f"WITH {_MANIFEST}, a AS (SELECT *, unnest(attrs) AS attribute, unnest(range(len(attrs))) AS i FROM m) SELECT rel_id, attribute, {_NAMES.format(x='y')} AS closure FROM (SELECT *, {_CLOSURE.format(x='(1 << i)::BIGINT')} AS y FROM a)",
    "candidate_keys": f"WITH {_KEYS} SELECT rel_id, {_NAMES.format(x='x')} AS key, {_NAMES.format(x='prime')} AS prime FROM k JOIN kp USING (rel_id)",
    "normal_form_labels": f"""WITH {_KEYS}, part AS (SELECT DISTINCT k.rel_id FROM k JOIN kp USING (rel_id) JOIN sub s ON s.rel_id = k.rel_id AND (s.x & k.x) = s.x AND s.x <> k.x WHERE ({_CLOSURE.replace("reps", "s.reps").format(x="s.x")} & ~s.x & ~prime) <> 0),
        fd AS (SELECT m.*, unnest(fds) AS f FROM m), trans AS (SELECT DISTINCT fd.rel_id FROM fd JOIN kp USING (rel_id) WHERE {_CLOSURE.format(x="(f >> 10)")} <> full_set AND ((f & 1023) & ~(f >> 10) & ~prime) <> 0)
        SELECT rel_id, CAST(CASE WHEN rel_id IN (SELECT rel_id FROM part) THEN 1 WHEN rel_id IN (SELECT rel_id FROM trans) THEN 2 ELSE 3 END AS INTEGER) AS normal_form, keys FROM kp""",
    "projected_fds": f"""WITH {_MANIFEST}, z AS (SELECT *, full_set & ~(1 << (list_position(attrs, 'nationkey') - 1)) AS kept FROM m),
        l AS (SELECT DISTINCT rel_id, unnest(list_distinct(list_transform(fds, lambda f: f >> 10) || list_transform(range(len(attrs)), lambda i: 1 << i)))::BIGINT AS l FROM z),
        y AS (SELECT z.*, l, {_CLOSURE.format(x="l")} & kept & ~l AS r FROM z JOIN l USING (rel_id) WHERE (l & kept) = l)
        SELECT rel_id, {_NAMES.format(x="l")} AS lhs, {_NAMES.format(x="r")} AS rhs FROM y WHERE r <> 0""",
    "join_ladder_orders": """SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS orderstatus, o_totalprice AS totalprice, o_orderpriority AS orderpriority, c_name AS customer_name, c_nationkey AS customer_nationkey,
        c_acctbal AS customer_acctbal, c_mktsegment AS customer_mktsegment, n_name AS nation_name, n_regionkey AS nation_regionkey, substr(o_orderpriority, 1, 1) || o_orderstatus AS code
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "list_injection": "SELECT l_orderkey AS orderkey, string_agg(l_returnflag, ', ' ORDER BY l_returnflag) AS returnflag FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
    "list_control": "SELECT l_orderkey AS orderkey, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS returnflag FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
    "repeating_pivot": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM lineitem)
        SELECT l_orderkey AS orderkey, max(CASE WHEN rn = 1 THEN l_partkey END) AS partkey_1, max(CASE WHEN rn = 2 THEN l_partkey END) AS partkey_2, coalesce(max(CASE WHEN rn = 3 THEN l_partkey END), -1) AS partkey_3 FROM r GROUP BY 1 HAVING count(*) >= 2""",
    "pivot_control": "SELECT l_orderkey AS orderkey, min(l_partkey) AS first_partkey, count(*) AS count_partkey, max(l_partkey) AS last_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
    "obfuscated": "SELECT s_suppkey AS xa, s_name AS xb, s_nationkey AS xc, s_acctbal AS xd FROM supplier",
    "snapshot": f"SELECT {_LAKE}, * FROM ({_SNAP})",
    "snapshot_diff": f"SELECT {_LAKE}, * FROM ({_DIFF})",
    "recorded_changes": _work("'-'", "'-'", "'-'"),
    "claimed_tables": f"SELECT {_LAKE}, table_name FROM ({_DIFF})",
    "claim_cycle": _work("'run-1'", "'-'", "'-'", keys_done="true"),
    "stale_claims": _work("'-'", "'run-3'", "'-'", first_nf="'-'"),
    "open_work": f"SELECT count(*) AS n_open FROM ({_work(chr(39) + '-' + chr(39), chr(39) + '-' + chr(39), chr(39) + '-' + chr(39))})",
    "enqueue_dedup": f"WITH {_QUEUE} SELECT * FROM e",
    "queue_status": f"WITH {_QUEUE} SELECT count(*) AS total, count(*) FILTER (NOT processed) AS unprocessed, count(*) FILTER (processed) AS processed FROM e",
    "fetched_batch": f"WITH {_QUEUE} SELECT * FROM e WHERE NOT processed ORDER BY id LIMIT 7",
    "marked_processed": f"WITH {_QUEUE} SELECT id, table_name, column_name, processed OR id % 3 <> 0 AS processed FROM e",
    "fully_queued": f"WITH {_QUEUE} SELECT c.database, c.schema, c.table_name FROM c LEFT JOIN q USING (table_name, column_name) GROUP BY ALL HAVING count(*) = count(q.id)",
    "leftover": f"WITH {_QUEUE} SELECT count(*) AS leftover FROM e WHERE NOT processed AND table_name IN (SELECT table_name FROM ({_DIFF}))",
    "processed_tables": f"WITH {_QUEUE} SELECT DISTINCT database, schema, table_name FROM q WHERE processed",
}
