"""Denormalisation: joins that fold dimensions into facts, lists and repeating columns in place of child rows, renamings."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """Fold a dimension in: join on left = right (the dimension's key, not carried along), other columns prefixed."""

    dimension: str
    left: str
    right: str
    prefix: str


def build_join(tables: dict[str, DataFrame], fact: str, key: Sequence[str], steps: Sequence[Step], limit: int | None = None, drop: Sequence[str] = (), derived: dict[str, Column] | None = None) -> DataFrame:
    """The fact, limited in the order of its key as declared, with dimensions folded in by chained inner joins. Which join is
    broadcast is left to the sizes that Spark knows."""
    df = tables[fact]
    if limit is not None:
        df = df.orderBy(*key).limit(limit)
    for s in steps:
        dim = tables[s.dimension]
        dim = dim.select(F.col(s.right).alias("_key"), *(F.col(c).alias(f"{s.prefix}{c}") for c in dim.columns if c != s.right))
        df = df.join(dim, df[s.left] == F.col("_key")).drop("_key")
    for name, column in (derived or {}).items():
        df = df.withColumn(name, column)
    return df.drop(*drop)


def join_fds(fact_fds: list, steps: Sequence[Step], dimension_columns: dict[str, list[str]]) -> list[tuple[list[str], list[str]]]:
    """What a build_join() declares: the fact's dependencies, and each foreign key's on what its dimension brought."""
    out = list(fact_fds)
    for s in steps:
        out.append(([s.left], [f"{s.prefix}{c}" for c in dimension_columns[s.dimension] if c != s.right]))
    return out


def pair_determined(a: str, b: str, k: int = 1) -> Column:
    """A value that a and b determine together."""
    return F.concat(F.substring(F.col(a).cast("string"), 1, k), F.col(b).cast("string"))


def list_injection(children: DataFrame, parent: str, value: str, separator: str = ", ") -> DataFrame:
    """A list of the children's values in place of their rows, for parents with two or more: no longer atomic."""
    d = children.groupBy(parent).agg(F.array_sort(F.collect_list(F.col(value).cast("string"))).alias("v"))
    return d.where(F.size("v") >= 2).select(parent, F.array_join("v", separator).alias(value))


def list_control(children: DataFrame, parent: str, value: str, order: Sequence[str]) -> DataFrame:
    """For the same parents one atomic value: of the first child in that order."""
    d = children.groupBy(parent).agg(F.min_by(F.col(value).cast("string"), F.struct(*order)).alias(value), F.count("*").alias("n"))
    return d.where("n >= 2").drop("n")


def repeating_pivot(children: DataFrame, parent: str, value: str, slots: int = 3) -> DataFrame:
    """value_1 to value_n in place of child rows: the smallest values, for parents with two or more children."""
    w = Window.partitionBy(parent).orderBy(value)
    d = children.withColumn("rn", F.row_number().over(w))
    cells = [F.max(F.when(F.col("rn") == i, F.col(value))).alias(f"{value}_{i}") for i in range(1, slots + 1)]
    return d.groupBy(parent).agg(*cells, F.count("*").alias("n")).where("n >= 2").drop("n")


def pivot_control(children: DataFrame, parent: str, value: str) -> DataFrame:
    """The matched control of a repeating pivot: first, count and last."""
    d = children.groupBy(parent).agg(F.min(value).alias(f"first_{value}"), F.count("*").alias(f"count_{value}"), F.max(value).alias(f"last_{value}"))
    return d.where(F.col(f"count_{value}") >= 2)


def positional_names(n: int) -> list[str]:
    """Names without digits that tell nothing but a position: xa, xb, ... xz, xaa, ..."""
    out = []
    for i in range(n):
        name, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            name = chr(97 + r) + name
        out.append(f"x{name}")
    return out


def obfuscated(df: DataFrame) -> DataFrame:
    return df.toDF(*positional_names(len(df.columns)))


def synthetic_relation(spark, rows: int, key_sizes: Sequence[int], independent: dict[str, int], dependent: dict[str, tuple[Sequence[str], int]], null_every: int = 0) -> DataFrame:
    """A relation of known normal form, by hashing: key parts are the row number's digits, independent attributes hash the row, dependent
    ones hash their determinant, so that exactly the declared dependencies hold; null_every leaves dependents null by determinant."""
    df, base = spark.range(rows).withColumnRenamed("id", "row_id"), 1
    for i, size in enumerate(key_sizes):
        df = df.withColumn(f"k{i}", (F.floor(F.col("row_id") / base) % size).cast("long") if i < len(key_sizes) - 1 else F.floor(F.col("row_id") / base).cast("long"))
        base *= size
    for name, size in independent.items():
        df = df.withColumn(name, F.pmod(F.xxhash64("row_id", F.lit(name)), F.lit(size)))
    for name, (on, size) in dependent.items():
        value = F.pmod(F.xxhash64(*on, F.lit(name)), F.lit(size))
        df = df.withColumn(name, F.when(F.pmod(F.xxhash64(*on, F.lit(f"{name}?")), F.lit(null_every)) != 0, value) if null_every else value)
    return df.drop("row_id")


# --- recipes over the star schema, and the tables that they make ------------------------------------------------------------

#: Key of each table, and what else identifies a row.
KEYS = {"region": ["regionkey"], "nation": ["nationkey"], "customer": ["custkey"], "supplier": ["suppkey"], "part": ["partkey"], "orders": ["orderkey"], "lineitem": ["orderkey", "linenumber"]}
ALTERNATES = {"region": ["name"], "nation": ["name"]}
CUSTOMER, ORDER, PART, SUPPLIER = Step("customer", "custkey", "custkey", "customer_"), Step("orders", "orderkey", "orderkey", "order_"), Step("part", "partkey", "partkey", "part_"), Step("supplier", "suppkey", "suppkey", "supplier_")


def _nation(of: str) -> Step:
    return Step("nation", f"{of}nationkey", "nationkey", f"{of}nation_")


def _region(of: str) -> Step:
    return Step("region", f"{of}regionkey", "regionkey", f"{of}region_")


@dataclass(frozen=True)
class Recipe:
    """A fact with dimensions folded in; pair: two columns that determine a derived one together."""

    name: str
    fact: str
    steps: tuple[Step, ...] = ()
    drop: tuple[str, ...] = ()
    pair: tuple[str, str] | None = None


_ORDER_CUSTOMER = Step("customer", "order_custkey", "custkey", "order_customer_")
JOIN_RECIPES = (
    Recipe("region_alone", "region"), Recipe("nation_alone", "nation"), Recipe("customer_alone", "customer"), Recipe("supplier_alone", "supplier"), Recipe("part_alone", "part"), Recipe("orders_alone", "orders"),
    Recipe("lines_alone", "lineitem"), Recipe("lines_short", "lineitem", drop=("extendedprice", "tax", "shipdate")),
    Recipe("nation_in_region", "nation", (_region(""),)), Recipe("customer_in_nation", "customer", (_nation(""),)), Recipe("customer_in_region", "customer", (_nation(""), _region("nation_"))),
    Recipe("supplier_in_nation", "supplier", (_nation(""),)), Recipe("supplier_in_region", "supplier", (_nation(""), _region("nation_"))), Recipe("orders_of_customer", "orders", (CUSTOMER,)),
    Recipe("orders_of_nation", "orders", (CUSTOMER, _nation("customer_"))), Recipe("orders_of_region", "orders", (CUSTOMER, _nation("customer_"), _region("customer_nation_"))),
    Recipe("orders_coded", "orders", pair=("orderpriority", "orderstatus")), Recipe("lines_coded", "lineitem", pair=("returnflag", "linestatus")),
    Recipe("lines_of_order", "lineitem", (ORDER,)), Recipe("lines_of_part", "lineitem", (PART,)), Recipe("lines_of_customer", "lineitem", (ORDER, _ORDER_CUSTOMER)), Recipe("lines_of_supplier", "lineitem", (SUPPLIER, _nation("supplier_"))),
    Recipe("lines_of_all", "lineitem", (ORDER, PART, SUPPLIER)),
)


@dataclass
class Relation:
    """A table that can be built, with its attributes and the dependencies that hold by construction."""

    build: Callable[[], DataFrame]
    attributes: list[str]
    fds: list[tuple[list[str], list[str]]]
    violates_1nf: bool = False


def own_fds(table: str, columns: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    sides = [KEYS[table], *([ALTERNATES[table]] if table in ALTERNATES else [])]
    return [(k, [c for c in columns if c not in k]) for k in sides]


def joined_relation(tables: dict[str, DataFrame], recipe: Recipe, limit: int | None = None) -> Relation:
    """The fact's dependencies, each dimension's own under its new names, and its key's under the foreign key's name."""
    columns = list(tables[recipe.fact].columns)
    fds = own_fds(recipe.fact, columns)
    for s in recipe.steps:
        new = {c: s.left if c == s.right else f"{s.prefix}{c}" for c in tables[s.dimension].columns}
        columns += [v for k, v in new.items() if k != s.right]
        fds += [([new[c] for c in a], [new[c] for c in b]) for a, b in own_fds(s.dimension, tables[s.dimension].columns)]
    derived = {}
    if recipe.pair:
        derived = {"code": pair_determined(*recipe.pair)}
        columns.append("code")
        fds += [(list(recipe.pair), ["code"]), (KEYS[recipe.fact], ["code"])]
    attributes = [c for c in columns if c not in recipe.drop]
    fds = [(a, [c for c in b if c in attributes]) for a, b in fds if set(a) <= set(attributes)]
    return Relation(lambda: build_join(tables, recipe.fact, KEYS[recipe.fact], recipe.steps, limit, recipe.drop, derived), attributes, [(a, b) for a, b in fds if b])


#: Child rows that become a list or numbered columns of their parent: child table, parent, value.
LISTS = (("lineitem", "orderkey", "returnflag"), ("orders", "custkey", "orderpriority"), ("customer", "nationkey", "mktsegment"))
PIVOTS = (("lineitem", "orderkey", "partkey"), ("orders", "custkey", "orderkey"), ("supplier", "nationkey", "suppkey"))


def injected_relation(tables: dict[str, DataFrame], kind: str, child: str, parent: str, value: str, control: bool, limit: int | None = None) -> Relation:
    """A list or repeating columns in place of child rows, or the atomic control of the same parents."""

    def build() -> DataFrame:
        rows = tables[child]
        if limit is not None:
            rows = rows.orderBy(*KEYS[child]).limit(limit)
        if kind == "list":
            return list_control(rows, parent, value, KEYS[child]) if control else list_injection(rows, parent, value)
        return pivot_control(rows, parent, value) if control else repeating_pivot(rows, parent, value)

    cells = [value] if kind == "list" else [f"first_{value}", f"count_{value}", f"last_{value}"] if control else [f"{value}_{i}" for i in (1, 2, 3)]
    return Relation(build, [parent, *cells], [([parent], cells)], not control)


def renamed_relation(r: Relation) -> Relation:
    new = dict(zip(r.attributes, positional_names(len(r.attributes)), strict=True))
    return Relation(lambda: r.build().select(*(F.col(c).alias(n) for c, n in new.items())), list(new.values()), [([new[c] for c in a], [new[c] for c in b]) for a, b in r.fds], r.violates_1nf)


@dataclass
class Spec:
    """A table to be generated. pair_id links an injection and its control; the table's name tells its position alone."""

    table_name: str
    relation: Relation
    params: dict = field(default_factory=dict)


def build_specs(tables: dict[str, DataFrame], limits: Sequence[int | None] = (None, 2000, 150), namings: Sequence[str] = ("real", "obfuscated")) -> list[Spec]:
    """Every recipe and injection, for each row limit and naming: nothing is built yet."""
    out: list[Spec] = []

    def add(relation: Relation, naming: str, **params) -> None:
        relation = relation if naming == "real" else renamed_relation(relation)
        out.append(Spec(f"made_{len(out) + 1:03d}", relation, {"naming": naming, **params}))

    for limit in limits:
        for naming in namings:
            for r in JOIN_RECIPES:
                add(joined_relation(tables, r, limit), naming, recipe=r.name, kind="join", limit=limit)
            for kind, many in (("list", LISTS), ("pivot", PIVOTS)):
                for child, parent, value in many:
                    for control in (False, True):
                        name = f"{kind}_{child}_{value}"
                        add(injected_relation(tables, kind, child, parent, value, control, limit), naming, recipe=name, kind="control" if control else "injection", limit=limit, pair_id=f"{name}_{limit}_{naming}")
    return out


def spec_manifest(spark, specs: Sequence[Spec]) -> DataFrame:
    """rel_id, attributes, fds, violates_1nf and the parameters (JSON) of each spec: what labels are derived from."""
    rows = [(s.table_name, s.relation.attributes, s.relation.fds, s.relation.violates_1nf, json.dumps(s.params, sort_keys=True)) for s in specs]
    return spark.createDataFrame(rows, "rel_id string, attributes array<string>, fds array<struct<lhs: array<string>, rhs: array<string>>>, violates_1nf boolean, recipe_params string")


#: Axes of the sweep: attributes, rows, null rates (one in so many; 0: none) and namings of a relation.
SWEEP = {"attributes": (5, 7, 9, 12), "rows": (200, 1_000, 5_000), "null_every": (0, 20, 5), "naming": ("real", "obfuscated")}


def axis_sweep(spark, count: int = 300) -> DataFrame:
    """id, target form (id mod 4) and each axis's value; axes turn at strides that share no factor, so that none tells another."""
    d = spark.range(count).withColumn("target", (F.col("id") % 4).cast("int"))
    for stride, (axis, values) in zip((7, 11, 13, 3), SWEEP.items(), strict=True):
        d = d.withColumn(axis, F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(F.col("id") / stride), F.lit(len(values))).cast("int")))
    # a relation that is not atomic has a structure of its own, in turn
    d = d.withColumn("structure", F.when(F.col("target") == 0, 1 + F.pmod(F.floor(F.col("id") / 4), F.lit(3))).otherwise(F.col("target")).cast("int"))
    return d.withColumn("key_size", F.greatest(1 + F.pmod(F.floor(F.col("id") / 5), F.lit(2)), F.when(F.col("structure") == 1, 2).otherwise(1)).cast("int"))


def swept_relation(spark, spec: dict) -> Relation:
    """The relation of one row of axis_sweep(): key parts, a column that key alone determines, and by structure (1) one on a part of
    the key, (2) one on another attribute, or (3) none; target 0 adds a list."""
    sizes = [20] * spec["key_size"]
    free = spec["attributes"] - len(sizes) - (spec["structure"] < 3) - (spec["target"] == 0)
    independent = {f"a{chr(97 + i)}": 7 + 3 * i for i in range(max(free, 1))}
    on = {1: ["k0"], 2: ["aa"], 3: None}[spec["structure"]]
    dependent = {"dep": (on, 3)} if on else {}
    keys = [f"k{i}" for i in range(len(sizes))]
    rest = [*independent, *dependent] + ["tags"] * (spec["target"] == 0)

    def build() -> DataFrame:
        df = synthetic_relation(spark, spec["rows"], sizes, independent, dependent, spec["null_every"])
        if spec["target"] == 0:
            df = df.withColumn("tags", F.concat_ws(", ", *(F.concat(F.lit(c), F.pmod(F.xxhash64(*keys, F.lit(c)), F.lit(9)).cast("string")) for c in "uvw")))
        return df

    r = Relation(build, keys + rest, [(keys, rest), *([(on, ["dep"])] if on else [])], spec["target"] == 0)
    return r if spec["naming"] == "real" else renamed_relation(r)
