"""Declared dependencies over a manifest: closures, keys and normal forms of all relations at once.

A manifest row is a relation: rel_id, attributes (array of names), fds (array of struct<lhs, rhs: array of names>), violates_1nf.
Attributes become bit positions of a BIGINT, so a relation has 63 attributes at most; more, or an unknown attribute, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTRIBUTES, MAX_SEARCHED = 63, 20


def mask(names: Column, attributes: Column) -> Column:
    """The bits of `names`; a name that is no attribute is an error."""
    bit = lambda x: F.when(F.array_contains(attributes, x), F.pow(F.lit(2), F.array_position(attributes, x) - 1).cast("long")).otherwise(F.raise_error(F.concat(F.lit("unknown attribute: "), x)).cast("long"))
    return F.aggregate(names, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))


def names_of(bits: Column, attributes: Column) -> Column:
    return F.filter(attributes, lambda x, i: F.bit_get(bits, i) == 1)


def minus(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def within(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == a


def closure(bits: Column, fds: Column) -> Column:
    """All that `bits` determines. Each pass over the dependencies adds one that applies, or is the last to change anything."""
    one = lambda acc: F.aggregate(fds, acc, lambda a, f: F.when(within(f["lhs"], a), a.bitwiseOR(f["rhs"])).otherwise(a))
    return F.when(F.size(fds) > 0, F.aggregate(F.sequence(F.lit(1), F.size(fds)), bits, lambda acc, _: one(acc))).otherwise(bits)


def encode(manifest: DataFrame) -> DataFrame:
    """rel_id, attributes, violates_1nf, all (bits) and deps: normalised dependencies as bits, without their trivial parts."""
    a = F.col("attributes")
    ok = F.when(F.size(a) <= MAX_ATTRIBUTES, a).otherwise(F.raise_error(F.lit("a relation has more than 63 attributes")).cast("array<string>"))
    bits = F.transform("fds", lambda f: F.struct(mask(f["lhs"], a).alias("lhs"), mask(f["rhs"], a).alias("rhs")))
    deps = F.filter(F.transform(bits, lambda f: F.struct(f["lhs"].alias("lhs"), minus(f["rhs"], f["lhs"]).alias("rhs"))), lambda f: f["rhs"] != 0)
    return manifest.withColumn("attributes", ok).select("rel_id", "attributes", "violates_1nf", mask(a, a).alias("all"), deps.alias("deps"))


def normalise_fds(manifest: DataFrame) -> DataFrame:
    """One row a dependency, non-trivial, with sorted names."""
    d = encode(manifest).select("rel_id", "attributes", F.explode("deps").alias("f"))
    return d.select("rel_id", *(F.array_sort(names_of(F.col(f"f.{k}"), F.col("attributes"))).alias(k) for k in ("lhs", "rhs")))


def closures(manifest: DataFrame) -> DataFrame:
    """The closure of each single attribute."""
    d = encode(manifest).withColumn("attribute", F.explode("attributes"))
    got = closure(mask(F.array("attribute"), F.col("attributes")), F.col("deps"))
    return d.select("rel_id", "attribute", F.array_sort(names_of(got, F.col("attributes"))).alias("closure"))


def candidate_keys(encoded: DataFrame) -> DataFrame:
    """All minimal superkeys as bits: (rel_id, key).

    Attributes on no right side are in every key; only those on both sides need a search, MAX_SEARCHED at most. A superkey
    is minimal if it is none without any one of its attributes.
    """
    rhs = F.aggregate("deps", F.lit(0).cast("long"), lambda a, f: a.bitwiseOR(f["rhs"]))
    lhs = F.aggregate("deps", F.lit(0).cast("long"), lambda a, f: a.bitwiseOR(f["lhs"]))
    d = encoded.withColumn("mandatory", minus(F.col("all"), rhs)).withColumn("both", rhs.bitwiseAND(lhs))
    bits = F.filter(F.sequence(F.lit(0), F.size("attributes") - 1), lambda i: F.bit_get(F.col("both"), i) == 1)
    d = d.withColumn("search", bits)
    d = d.withColumn("search", F.when(F.size("search") <= MAX_SEARCHED, F.col("search")).otherwise(F.raise_error(F.lit("more than 20 attributes to search")).cast("array<int>")))
    d = d.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2), F.size("search")) - 1).cast("long"))))
    picked = F.aggregate(F.transform("search", lambda b, i: F.when(F.bit_get(F.col("n"), i) == 1, F.pow(F.lit(2), b).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    d = d.withColumn("key", F.col("mandatory").bitwiseOR(picked)).where(closure(F.col("key"), F.col("deps")) == F.col("all"))
    each = F.transform(F.sequence(F.lit(0), F.size("attributes") - 1), lambda i: F.pow(F.lit(2), i).cast("long"))
    smaller = F.exists(each, lambda b: within(b, F.col("key")) & (closure(minus(F.col("key"), b), F.col("deps")) == F.col("all")))
    return d.where(~smaller).select("rel_id", "key")


def with_keys(manifest: DataFrame) -> DataFrame:
    """The encoded manifest with its keys and prime attributes."""
    e = encode(manifest)
    k = candidate_keys(e).groupBy("rel_id").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.expr("bit_or(key)").alias("prime"))
    return e.join(k, "rel_id")


def partial_dependencies(keyed: DataFrame) -> DataFrame:
    """(rel_id, lhs, rhs) bits: what a key without one attribute still determines, but for prime attributes."""
    d = keyed.withColumn("key", F.explode("keys")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("attributes") - 1)))
    d = d.withColumn("bit", F.pow(F.lit(2), F.col("i")).cast("long")).where(within(F.col("bit"), F.col("key"))).withColumn("lhs", minus(F.col("key"), F.col("bit"))).where("lhs <> 0")
    return d.withColumn("rhs", minus(minus(closure(F.col("lhs"), F.col("deps")), F.col("lhs")), F.col("prime"))).where("rhs <> 0").select("rel_id", "attributes", "lhs", "rhs").distinct()


def transitive_dependencies(keyed: DataFrame) -> DataFrame:
    """(rel_id, lhs, rhs) bits: dependencies whose left side is no superkey, on attributes that are not prime."""
    d = keyed.withColumn("f", F.explode("deps")).where(closure(F.col("f.lhs"), F.col("deps")) != F.col("all"))
    return d.select("rel_id", "attributes", F.col("f.lhs").alias("lhs"), minus(F.col("f.rhs"), F.col("prime")).alias("rhs")).where("rhs <> 0")


def normal_forms(manifest: DataFrame) -> DataFrame:
    """normal_form (0 to 3), reason and keys of each relation. A partial dependency outranks a transitive one."""
    keyed = with_keys(manifest)
    text = lambda b: F.array_join(F.array_sort(names_of(F.col(b), F.col("attributes"))), "+")
    shown = F.concat(text("lhs"), F.lit("->"), text("rhs"))
    found = lambda d, n: d.withColumn("t", shown).groupBy("rel_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias(n))
    d = keyed.join(found(partial_dependencies(keyed), "partial"), "rel_id", "left").join(found(transitive_dependencies(keyed), "transitive"), "rel_id", "left")
    form = F.when(F.col("violates_1nf"), 0).when(F.col("partial").isNotNull(), 1).when(F.col("transitive").isNotNull(), 2).otherwise(3)
    reason = F.when(F.col("violates_1nf"), "not atomic").when(F.col("partial").isNotNull(), F.concat(F.lit("partial: "), "partial")).when(F.col("transitive").isNotNull(), F.concat(F.lit("transitive: "), "transitive")).otherwise("")
    keys = F.array_join(F.array_sort(F.transform("keys", lambda k: F.array_join(F.array_sort(names_of(k, F.col("attributes"))), "+"))), ",")
    return d.select("rel_id", form.alias("normal_form"), reason.alias("reason"), keys.alias("keys"))


def project_fds(manifest: DataFrame, keep: str = "keep") -> DataFrame:
    """Dependencies on the kept attributes (column `keep` of the manifest): closures of every left side that survives and of every
    single kept attribute, cut to what is kept."""
    e = encode(manifest).join(manifest.select("rel_id", keep), "rel_id")
    kept = mask(F.col(keep), F.col("attributes"))
    sides = F.array_distinct(F.concat(F.transform("deps", lambda f: f["lhs"]), F.transform(F.col(keep), lambda x: mask(F.array(x), F.col("attributes")))))
    d = e.withColumn("kept", kept).withColumn("lhs", F.explode(sides)).where(within(F.col("lhs"), F.col("kept")))
    d = d.withColumn("rhs", minus(closure(F.col("lhs"), F.col("deps")).bitwiseAND(F.col("kept")), F.col("lhs"))).where("rhs <> 0")
    return d.select("rel_id", *(F.array_sort(names_of(F.col(k), F.col("attributes"))).alias(k) for k in ("lhs", "rhs")))


def rename_fds(fds: Column, names: Column) -> Column:
    """Dependencies under new names; names: map of old to new, others stay."""
    new = lambda side: F.transform(side, lambda x: F.coalesce(F.element_at(names, x), x))
    return F.transform(fds, lambda f: F.struct(new(f["lhs"]).alias("lhs"), new(f["rhs"]).alias("rhs")))


def encode_fds(fds: Column) -> Column:
    """Canonical text: [[lhs],[rhs]] pairs, all sorted."""
    pairs = F.array_sort(F.transform(fds, lambda f: F.array(F.array_sort(f["lhs"]), F.array_sort(f["rhs"]))))
    return F.to_json(pairs)


def decode_fds(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<array<array<string>>>"), lambda p: F.struct(p[0].alias("lhs"), p[1].alias("rhs")))


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Manifest rows whose label is derived from the dependencies, never given: table_name, fds, keys, normal_form, params."""
    text = manifest.select("rel_id", encode_fds(F.col("fds")).alias("fds"))
    d = normal_forms(manifest).join(text, "rel_id")
    return d.select(F.col("rel_id").alias("table_name"), "fds", "keys", "normal_form", F.to_json(F.struct("reason")).alias("params"))
