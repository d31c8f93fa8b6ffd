"""Exact duplicates by composable polynomial fingerprints, confirmed by chunkwise comparison.

A text's fingerprint is its bytes as a polynomial, modulo two primes. Chunks are hashed on their own and combined by
length-shifted arithmetic: H(ab) = H(a) * base**len(b) + H(b). A text of more than LONG bytes is dealt out as chunks, which are hashed
wherever they land: each is shifted by the bytes that follow it, and the sum of a text's shifted chunks is its fingerprint.
Shorter texts are combined chunk by chunk where they are. Texts of equal fingerprint and length are then compared chunk by chunk:
an aggregation keeps the distinct contents of each chunk of each fingerprint, combined before it shuffles, so that a group of
any number of copies sends one chunk a task. Where some chunk has two contents, the fingerprints collided, and the SHA-256 of
the texts tells the group's members apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LOWER, map_rows, stash, unstash, unused

CHUNK = 1 << 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Primes below 2**31, so that the sum of a chunk's products stays below 2**63; and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
#: Bytes from which a text's chunks are dealt out.
LONG = 1 << 24


def powers(base: int, prime: int) -> np.ndarray:
    """base**0 ... base**CHUNK modulo prime."""
    out = np.ones(CHUNK + 1, np.uint64)
    step, have = base, 1
    while have <= CHUNK:
        n = min(have, CHUNK + 1 - have)
        out[have : have + n] = out[:n] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += n
    return out


_POWERS = [powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hash(data: bytes, which: int) -> int:
    """The polynomial of one chunk's bytes, each plus 1, highest power first."""
    digits = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((digits * _POWERS[which][: len(data)][::-1]).sum() % np.uint64(PRIMES[which]))


def combine(left: int, right: int, right_length: int, which: int) -> int:
    """H(ab) from H(a), H(b) and the length of b."""
    return (left * pow(BASES[which], right_length, PRIMES[which]) + right) % PRIMES[which]


def fingerprint(data: bytes) -> int:
    """Both polynomials of a text in one signed 64-bit number."""
    h = [0, 0]
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        for k in (0, 1):
            h[k] = combine(h[k], chunk_hash(part, k), len(part), k)
    return h[0] << 31 | h[1]


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(LOWER)


def lowered() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())


def fingerprints(docs: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, fp, n_bytes, text_sha256 of each row's normalised text; null texts count as empty, repeated rows stay."""

    def make():
        def fn(rows):
            texts = [normalised(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "fp": [fingerprint(t) for t in texts], "n_bytes": [len(t) for t in texts], "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}

        return fn

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.where(size <= long).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = docs.where(size > long).select("doc_id", size.cast("long").alias("n_bytes"), F.sha2(lowered().cast("binary"), 256).alias("text_sha256"), lowered().cast("binary").alias("text"))
    of_long = rows.select("doc_id", "n_bytes", "text_sha256").join(long_fingerprints(rows), ["text_sha256", "n_bytes"])
    return map_rows(short, make, "doc_id long, fp long, n_bytes long, text_sha256 string").union(of_long.select("doc_id", "fp", "n_bytes", "text_sha256"))


def long_fingerprints(rows: DataFrame) -> DataFrame:
    """text_sha256, n_bytes and fp of the distinct texts of rows (with text, normalised), by chunks that are hashed in parallel."""

    def make():
        def fn(got):
            out: dict = {k: got[k] for k in ("text_sha256", "n_bytes", "chunk_no")} | {"h0": [], "h1": []}
            for no, size, part in zip(got["chunk_no"], got["n_bytes"], got["chunk"], strict=True):
                after = size - no * CHUNK - len(part)
                for k in (0, 1):
                    out[f"h{k}"].append(combine(chunk_hash(part, k), 0, after, k))
            return out

        return fn

    numbers = F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / CHUNK).cast("int"))
    parts = rows.select("text_sha256", "n_bytes", "text", F.explode(numbers).alias("chunk_no"))
    parts = parts.select("text_sha256", "n_bytes", "chunk_no", F.expr(f"substring(text, chunk_no * {CHUNK} + 1, {CHUNK})").alias("chunk")).repartition("text_sha256", "chunk_no")
    hashed = map_rows(parts, make, "text_sha256 string, n_bytes long, chunk_no int, h0 long, h1 long")
    once = hashed.groupBy("text_sha256", "n_bytes", "chunk_no").agg(F.min("h0").alias("h0"), F.min("h1").alias("h1"))
    h0, h1 = (F.pmod(F.sum(f"h{k}"), F.lit(PRIMES[k])) for k in (0, 1))
    return once.groupBy("text_sha256", "n_bytes").agg((F.shiftleft(h0, 31).bitwiseOR(h1)).alias("fp"))


def chunks(docs: DataFrame) -> DataFrame:
    """fp, n_bytes, chunk_no and chunk of each row's normalised text; null and empty texts have no chunk."""

    def make():
        def fn(rows):
            out: dict = {"fp": [], "n_bytes": [], "chunk_no": [], "chunk": []}
            for t in map(normalised, rows["text"]):
                fp = fingerprint(t)
                for at in range(0, len(t), CHUNK):
                    for k, v in (("fp", fp), ("n_bytes", len(t)), ("chunk_no", at // CHUNK), ("chunk", t[at : at + CHUNK])):
                        out[k].append(v)
            return out

        return fn

    return map_rows(docs.select(F.col("text").cast("binary").alias("text")), make, "fp long, n_bytes long, chunk_no long, chunk binary")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are identical after lower-casing A-Z; the row with the largest doc_id stays.

    docs: doc_id, text; other columns, whatever their names, are not read. Null and empty texts are equal to each other. Of rows
    that share text and doc_id all stay (keep_one() leaves one of them). A null doc_id is below every other; where a group has no
    doc_id at all, keep_id is null and its rows stay. An empty table gives no rows.
    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row.
    """
    return _exact_duplicates(docs)[0]


def _exact_duplicates(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """exact_duplicates(), and what was written for it."""
    marked = stash(fingerprints(docs))
    repeated = stash(marked.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("fp", "n_bytes"))
    # the written table's size decides how it is joined
    parts = chunks(docs).join(repeated, ["fp", "n_bytes"], "left_semi")
    contents = parts.groupBy("fp", "n_bytes", "chunk_no", "chunk").agg(F.lit(1).alias("one"))
    collided = stash(contents.groupBy("fp", "n_bytes", "chunk_no").count().where("count > 1").select("fp", "n_bytes").distinct())

    split = marked
    if not collided.isEmpty():
        split = marked.join(collided.withColumn("collided", F.lit(True)), ["fp", "n_bytes"], "left")
        split = split.withColumn("content", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")).drop("collided")
    else:
        split = marked.withColumn("content", F.lit(""))
    key = ["fp", "n_bytes", "content"]
    groups = split.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = split.join(groups, key, "left")
    size = F.coalesce("group_size", F.lit(1))
    unstash(repeated)
    out = out.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )
    return out, [marked, collided]


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that exact_duplicates() keeps, with all their columns; of rows that repeat a doc_id and its text, one."""
    found, written = _exact_duplicates(docs)
    found = stash(found)
    for old in written:
        unstash(old)
    key, sha = unused(docs, "gone_id", "gone_sha256")
    gone = found.where("not kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    again = stash(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    same = docs["doc_id"].eqNullSafe(F.col(key))
    if again.isEmpty():
        return docs.join(gone.select(key), same, "left_anti").select(kept)
    # some doc_id is repeated: tell its rows apart by their texts, and drop whole repeated rows
    once = docs.join(again, same, "left_anti")
    once = once.join(gone.select(key), once["doc_id"].eqNullSafe(F.col(key)), "left_anti")
    (own,) = unused(docs, "own_sha256")
    more = docs.join(again, same, "left_semi").withColumn(own, F.sha2(lowered().cast("binary"), 256))
    more = more.join(gone, more["doc_id"].eqNullSafe(F.col(key)) & (more[own] == F.col(sha)), "left_anti")
    return once.select(kept).union(more.dropDuplicates(["doc_id", own]).select(kept))
