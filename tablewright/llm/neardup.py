"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature is CHUNKS x WIDTH symbols, each the lowest 16 bits of a minimum hash of its word shingles. Two texts of
similarity s differ in a share 1 - s of the symbols. If two signatures differ in at most CHUNKS * (ERRORS + 1) - 1 symbols, then
by the pigeonhole principle some chunk has at most ERRORS differing symbols. With ERRORS = 1 the allowed errors of a chunk are
enumerated by leaving out each of its symbols in turn: all pairs under that distance meet in a bucket, for certain. Pairs
of similarity 0.75 or more whose signatures happen to differ more meet in one with a probability over 1 - 2e-6.

Buckets are not expanded into pairs. Each member is compared with the bucket's smallest id; a bucket of n > SPLIT members is first
dealt by a hash into about sqrt(n) parts, whose smallest ids are compared with the bucket's, so that no id meets more than about
sqrt(n) others. Once these links have formed groups, only members outside the group of their bucket's smallest id are compared with
other members of its buckets (and with that id, if the bucket was dealt into parts), those whose longer sketches are near. So a bucket of n near copies costs n comparisons.

A pair that meets in a bucket is given up, before its full sets are compared, only if its signatures or sketches are further apart than
FURTHEST, FURTHEST_QUARTER or FURTHEST_BITS: limits more than 4.7 deviations above what similarity 0.75 has. With the missed
buckets, a link between groups is found with a probability over 1 - 5e-6, and what is found is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows, mix64, shingle_sets, stash, unstash
from tablewright.llm.components import components

CHUNKS, WIDTH, ERRORS = 18, 6, 1
SYMBOLS = CHUNKS * WIDTH
#: Candidates whose signatures differ in more symbols are no links: at similarity 0.75, 27 are expected with a deviation of 4.5.
FURTHEST = 54
#: For pairs between groups, a longer sketch of one-bit symbols: at similarity 0.75, 512 are expected to differ with a deviation of 21.
SKETCH, FURTHEST_BITS = 4096, 612
#: Of the sketch's first quarter 128 are expected to differ with a deviation of 10.6.
FURTHEST_QUARTER = 181
#: Members of a bucket that are compared with its smallest id as they are; rows of a hub that meet in one place, and places at most.
SPLIT, MEET, PLACES = 256, 512, 64
_SEEDS = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """16-bit symbols, little-endian; shingles must not be empty."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[at : at + 2048, None] * _SEEDS[None, :]).min(axis=0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set) and signature, one row for each row; no text. Null, empty and blank
    texts have an empty signature."""

    def make():
        def fn(rows):
            sets = shingle_sets(rows["text"], words)
            return {
                "doc_id": rows["doc_id"], "n_shingles": [len(s) for s in sets],
                "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "signature": [signature(s) if len(s) else b"" for s in sets],
            }

        return fn

    return map_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), make, "doc_id long, n_shingles long, set_id binary, signature binary")


def keys() -> list:
    """A key for each chunk and each symbol left out of it."""
    out = []
    for c in range(CHUNKS):
        for j in range(WIDTH):
            before = F.substring("signature", 2 * WIDTH * c + 1, 2 * j)
            after = F.substring("signature", 2 * (WIDTH * c + j + 1) + 1, 2 * (WIDTH - j - 1))
            out.append(F.xxhash64(F.lit(c * WIDTH + j), before, after))
    return out


def close(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in FURTHEST symbols at most."""

    def make():
        def fn(rows):
            x, y = (np.frombuffer(b"".join(rows[k]), "<u2").reshape(-1, SYMBOLS) for k in ("sa", "sb"))
            keep = np.flatnonzero((x != y).sum(axis=1) <= FURTHEST)
            return {"a": np.array(rows["a"], np.int64)[keep], "b": np.array(rows["b"], np.int64)[keep]}

        return fn

    of = lambda k: sigs.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}"))
    return map_rows(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb"), make, "a long, b long")


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each member b of a bucket and the smallest id of the bucket, or of its part of a large bucket, and of each part's
    smallest id and its bucket's. members: key, hub, rep, n (members of the bucket)."""
    small = members.where(F.col("n") <= SPLIT).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    parts = F.pow(F.lit(2.0), F.ceil(F.log2("n") / 2)).cast("long")
    large = members.where(F.col("n") > SPLIT).withColumn("part", F.pmod(F.xxhash64("rep"), parts))
    heads = stash(large.groupBy("key", "part").agg(F.min("rep").alias("head"), F.min("hub").alias("hub")))
    within = large.join(heads.drop("hub"), ["key", "part"]).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    return small.union(within).union(heads.select("hub", "head")).where("a <> b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on the full sets of whole texts; written. pairs are written, too: they
    are read twice. Ids without a text make no pair."""

    def make():
        last: dict = {"text": None, "set": None}

        def fn(rows):
            a, b = [], []
            for i, j, s, y in zip(rows["a"], rows["b"], rows["ta"], shingle_sets(rows["tb"], words), strict=True):
                if s != last["text"]:
                    last.update(text=s, set=shingle_sets([s], words)[0])
                x = last["set"]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) > 0:
                    a.append(i)
                    b.append(j)
            return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}

        return fn

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi")
    of = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
    out = stash(map_rows(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb"), make, "a long, b long"))
    unstash(pairs)
    return out


def sketches(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rep and sketch (SKETCH one-bit minimum hashes as longs) of the documents in `ids`; null texts and ids have none, repeated ids one."""

    def make():
        seeds = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

        def sketch(shingles: np.ndarray) -> list[int]:
            low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(shingles), 128):
                np.minimum(low, (shingles[at : at + 128, None] * seeds[None, :]).min(axis=0), out=low)
            return np.packbits((mix64(low) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()

        return lambda rows: {"rep": rows["doc_id"], "sketch": [sketch(s) for s in shingle_sets(rows["text"], words)]}

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").where("text is not null")
    return map_rows(texts, make, "rep long, sketch array<long>").dropDuplicates(["rep"])


def across(stars: DataFrame, groups: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Pairs that may link different groups: a member outside the group of its bucket's hub, and another member of that hub. A hub is a
    member of its own where members may not have met it.

    Each pair comes once, at the smallest hub that both have, and only if their sketches are within FURTHEST_BITS: the join's own
    condition, so that far pairs are never rows. The members of a hub are dealt to several places, to each of which its outsiders go.
    stars: hub, rep, without nulls, each pair once. The pairs are written.
    """
    of = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"{k}_in"))
    rows = stars.join(of("hub"), "hub", "left").join(of("rep"), "rep", "left").select("hub", "rep", F.coalesce("rep_in", "rep").alias("group"), (F.coalesce("hub_in", "hub") != F.coalesce("rep_in", "rep")).alias("outside"))
    rows = stash(rows)
    wanted = stash(rows.groupBy("hub").agg(F.count("*").alias("n"), F.max("outside").alias("any")).where("any"))
    places = F.least(F.ceil(F.col("n") / MEET), F.lit(PLACES)).cast("int")
    found = rows.join(wanted.select("hub", places.alias("places")), "hub")
    hubs = found.groupBy("rep").agg(F.collect_set("hub").alias("hubs"))  # CHUNKS * WIDTH at most
    marks = stash(sketches(docs, found.select("rep").distinct(), words).join(hubs, "rep"))
    found = found.join(marks, "rep")
    # plain columns, never null: the condition stays small enough to be compiled, and the first quarter settles most pairs
    parts = [F.coalesce(F.get("sketch", F.lit(i)), F.lit(0)).alias(f"s{i}") for i in range(SKETCH // 64)]
    found = found.select("hub", "places", "rep", "group", "outside", "hubs", *parts)
    names = [c for c in found.columns if c not in ("hub", "places")]
    side = lambda d, k: d.select("hub", "place", *(F.col(c).alias(f"{k}_{c}") for c in names))
    bits = lambda n: reduce(lambda a, i: a + F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))), range(n), F.lit(0))
    every = found.where("outside").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    dealt = found.withColumn("place", F.pmod(F.xxhash64("rep"), F.col("places")).cast("int"))
    x, y = side(every, "x").alias("x"), side(dealt, "y").alias("y")
    once = ~F.col("y_outside") | (F.col("x_rep") < F.col("y_rep"))
    apart = (F.col("x_group") != F.col("y_group")) & once & (bits(SKETCH // 256) <= FURTHEST_QUARTER) & (bits(SKETCH // 64) <= FURTHEST_BITS) & (F.array_min(F.array_intersect("x_hubs", "y_hubs")) == F.col("x.hub"))
    met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.place") == F.col("y.place"))
    out = stash(x.join(y, met & apart).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct())
    for old in (rows, wanted, marks):
        unstash(old)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Groups of near-duplicate documents, as single linkage of all links.

    docs: doc_id, text; other columns, whatever their names, are not read. A document's set has its distinct `words`-word
    shingles after lower-casing A-Z; with fewer words the whole sequence is its one shingle; null, empty and blank texts have an
    empty set and are linked with nothing. Documents of equal sets (copies, repeated rows) are one class and are compared once. A row
    without doc_id is linked with nothing and kept. Rows that repeat a doc_id are one node of the graph.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row for each row. An empty table gives none.
    """
    return _near_duplicates(docs, words, percent)[0]


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates(), and what was written for it."""
    marked = stash(signatures(docs, words))
    named = marked.where("doc_id is not null and n_shingles > 0")
    classes = stash(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    sigs = classes.select("rep", "signature")

    index = sigs.select("rep", F.explode(F.array(*keys())).alias("key"))
    hubs = stash(index.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n")).where("hub < top").drop("top"))
    members = stash(index.join(hubs, "key"))  # only of buckets with two classes or more

    # the classes whose rep is the same doc_id are linked as they are: a repeated doc_id
    links = confirmed(stash(close(first_pairs(members), sigs)), docs, words, percent)
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # members outside the group of their bucket's hub, against the other members of that hub's buckets
    # first_pairs() compares those of a large bucket with their part's head alone, so there the hub itself is among the others
    stars = stash(members.where(f"hub <> rep or n > {SPLIT}").select("hub", "rep").distinct())
    more = confirmed(across(stars, groups, docs, words), docs, words, percent)
    if not more.isEmpty():
        unstash(groups)
        groups = components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    for old in (hubs, members, links, stars, more):
        unstash(old)

    of_set = classes.select("set_id", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = marked.join(of_set, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), [marked, classes, groups]


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns."""
    found, written = _near_duplicates(docs, words, percent)
    gone = stash(found.where("not kept").select("doc_id").distinct())
    for old in written:
        unstash(old)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
