"""Prefix trie of conversations: double-array tries of lexicographic shards, and a global merge of the nodes that shards share.

Turns become 128-bit hashes, rebuilt conversations become sequences of them, and one range shuffle orders the sequences, copies by their ids.
So any hot first turn, prefix or conversation is spread over as many shards as it needs. Of a shard only the nodes on the paths of
its first and last sequence can be in other shards too: they are merged by a fingerprint of their prefix, all others are final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import ship, stash, unstash

#: Turns of different sequences, and copies of one, after which a task closes a shard: both bound a worker's memory.
LIMITS = (200_000, 1_000_000)
#: Conversation ids in a block of the list of a node's ends.
BLOCK_IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = 16  # bytes of a turn's hash


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


# --- one shard --------------------------------------------------------------------------------------------------------


class DoubleArray:
    """A trie in two arrays: the child of state s by turn t is base[s] + t, if check of that cell is s. State 0 is the root."""

    def __init__(self) -> None:
        self.base, self.check, self.low, self.end = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1, 1
        self.check[0] = 0

    def reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def free(self, count: int) -> np.ndarray:
        """The first `count` free cells, fewer if others follow only behind the end."""
        while self.low < self.end and self.check[self.low] >= 0:
            self.low += 1
        return self.low + np.flatnonzero(self.check[self.low : min(self.end, self.low + 4 * count + 64)] < 0)[:count]

    def put(self, parents: np.ndarray, cells: np.ndarray) -> None:
        self.check[cells] = parents
        self.end = max(self.end, int(cells.max()) + 1)

    def add_single(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """A child for each of many parents that have one only: any free cell will do."""
        cells = self.free(len(parents))
        missing = len(parents) - len(cells)
        cells = np.concatenate((cells, np.arange(self.end, self.end + missing)))
        self.reserve(self.end + missing)
        self.base[parents] = cells - turns
        self.put(parents, cells)

    def add_many(self, parent: int, turns: np.ndarray) -> None:
        """The children of one parent, by sorted turns: the first base that finds all of their cells free."""
        span = turns - turns[0]
        at = self.end
        candidates = self.free(max(1, min(256, (1 << 18) // len(turns))))
        self.reserve(self.end + int(span[-1]) + 1)
        if len(candidates):
            fits = np.flatnonzero((self.check[candidates[:, None] + span] < 0).all(axis=1))
            at = int(candidates[fits[0]]) if len(fits) else at
        self.base[parent] = at - turns[0]
        self.put(np.full(len(turns), parent), at + span)

    def add(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Children (parent, turn), each once, sorted."""
        starts = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        widths = np.diff(np.concatenate((starts, [len(parents)])))
        for k in np.flatnonzero(widths > 1):
            self.add_many(int(parents[starts[k]]), turns[starts[k] : starts[k] + widths[k]])
        ones = starts[widths == 1]
        if len(ones):
            self.add_single(parents[ones], turns[ones])

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of states by turns, -1 where there is none."""
        cells = self.base[states] + turns
        known = (cells > 0) & (cells < self.end)
        known[known] = self.check[cells[known]] == states[known]
        return np.where(known, cells, -1)


def dense_ids(turns: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... for distinct turns (a row of two halves each) in the order of their lowest depth, so that siblings get near numbers."""
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    new = (turns[order][1:] != turns[order][:-1]).any(axis=1)
    ids = np.empty(len(turns), np.int64)
    ids[order] = np.cumsum(np.concatenate(([0], new))) if len(turns) else 0
    lowest = np.full(ids.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, ids, depth * len(turns) + np.arange(len(turns)))
    rank = np.empty(len(lowest), np.int64)
    rank[np.argsort(lowest)] = np.arange(len(lowest))
    return rank[ids]


def fingerprints(key: bytes) -> list[bytes]:
    """Of every prefix of a sequence, from the empty one on."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for at in range(0, len(key), TURN):
        h.update(key[at : at + TURN])
        out.append(h.digest())
    return out


@dataclass
class Shard:
    """Sequences in lexicographic order, each once, with their copies: what a double-array trie is packed from."""

    keys: list[bytes] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)  # bytes of each turn's text
    copies: list[int] = field(default_factory=list)
    smallest: list[int] = field(default_factory=list)
    ends: list[str | None] = field(default_factory=list)  # digest of the ids, unless they go out in blocks
    ids: list[np.ndarray] = field(default_factory=list)  # ids of the last sequence
    turns: int = 0
    limits: tuple[int, int] = LIMITS

    def add(self, key: bytes, sizes: np.ndarray, ids: np.ndarray) -> Iterator[dict]:
        if not self.keys or key != self.keys[-1]:
            yield from self.settle(last=False)
            self.keys.append(key)
            self.sizes.append(sizes)
            self.copies.append(0)
            self.smallest.append(int(ids[0]))
            self.ends.append(None)
            self.turns += len(sizes)
        self.copies[-1] += len(ids)
        self.ids.append(ids)

    def settle(self, last: bool) -> Iterator[dict]:
        """Digest the ids of the sequence that is complete; those of the first and the last may go on in other shards, so they go out."""
        if self.ids:
            ids = np.concatenate(self.ids)
            if last or len(self.keys) == 1:
                node = fingerprints(self.keys[-1])[-1]
                for k in range(0, len(ids), BLOCK_IDS):
                    yield {"kind": 2, "node": node, "conv_id": int(ids[k]), "block": ",".join(map(str, ids[k : k + BLOCK_IDS].tolist())).encode()}
            else:
                self.ends[-1] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
            self.ids = []

    def full(self) -> bool:
        return self.turns >= self.limits[0] or sum(map(len, self.ids)) >= self.limits[1]

    def nodes(self, number: int) -> Iterator[dict]:
        """Rows of kind 0, nodes of this shard alone, and kind 1, nodes on its first and last path, with what hangs off these paths."""
        lengths = np.array([len(s) for s in self.sizes])
        first = np.concatenate(([0], np.cumsum(lengths)))
        depth = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
        ids = dense_ids(np.frombuffer(b"".join(self.keys), np.int64).reshape(-1, 2), depth)
        sizes = np.concatenate(self.sizes) if len(ids) else np.empty(0, np.int64)

        trie, state, levels = DoubleArray(), np.zeros(len(lengths), np.int64), []
        for d in range(int(lengths.max(initial=0))):  # pack, level by level
            on = np.flatnonzero(lengths > d)
            pairs = np.unique(np.stack((state[on], ids[first[on] + d])), axis=1)
            trie.add(pairs[0], pairs[1])
            state[on] = trie.step(state[on], ids[first[on] + d])
            levels.append(trie.step(pairs[0], pairs[1]))

        n = trie.end
        members, smallest = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        size, depths, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(lengths), np.int64)
        copies, least = np.array(self.copies), np.array(self.smallest)
        paths = {0: [0], len(lengths) - 1: [0]}  # states on the path of the first and of the last sequence
        np.add.at(members, 0, copies.sum())
        smallest[0] = least.min()
        for d in range(int(lengths.max(initial=0))):  # traverse every sequence through BASE and CHECK
            on = np.flatnonzero(lengths > d)
            last[on] = trie.step(last[on], ids[first[on] + d])
            at = last[on]
            np.add.at(members, at, copies[on])
            np.minimum.at(smallest, at, least[on])
            size[at], depths[at] = sizes[first[on] + d], d + 1
            for g, path in paths.items():
                if lengths[g] > d:
                    path.append(int(last[g]))

        cells = np.concatenate([np.zeros(1, np.int64), *levels])
        parent = trie.check
        on_path = np.zeros(n, bool)
        for path in paths.values():
            on_path[path] = True
        kids = np.bincount(parent[cells[1:]][~on_path[cells[1:]]], minlength=n)
        leaves = np.where(on_path, 0, kids == 0).astype(np.int64)
        saved = np.where(on_path, 0, (members - 1) * size)
        for level in reversed(levels):
            off = level[~on_path[level]]
            np.add.at(leaves, parent[off], leaves[off])
            np.add.at(saved, parent[off], saved[off])

        prints = {g: fingerprints(self.keys[g]) for g in paths}
        named = {s: prints[g][d] for g, path in paths.items() for d, s in enumerate(path)}
        ends = {int(last[g]): e for g, e in enumerate(self.ends) if e is not None}
        for s in cells.tolist():
            row = {"conv_id": smallest[s], "depth": depths[s], "n_convs": members[s], "n_children": kids[s], "n_leaves": leaves[s], "saved_tokens": saved[s]}
            if on_path[s]:
                sides = [side for side, g in enumerate((0, len(lengths) - 1)) if depths[s] < len(paths[g]) and paths[g][depths[s]] == s]
                yield row | {"kind": 1, "node": named[s], "parent": named[int(parent[s])] if s else None, "size": size[s], "first": 2 * number + sides[0], "last": 2 * number + sides[-1], "ends_sha256": ends.get(s)}
            else:
                above = int(parent[s])
                yield row | {"kind": 0, "parent_conv_id": None if on_path[above] else smallest[above], "parent": named.get(above), "ends_sha256": ends.get(s, EMPTY)}


FIELDS = {
    "kind": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "first": pa.int64(), "last": pa.int64(), "size": pa.int64(), "block": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(),
    "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
SHARD_SCHEMA = ", ".join(f"`{k}` {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[t]}" for k, t in FIELDS.items())


def tables(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Batches of rows; blocks of ids are long, so of those few make a batch."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += 1 + len(row.get("block") or b"") // 100
        if held >= 20_000:
            yield pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in part], type=t) for k, t in FIELDS.items()})
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in part], type=t) for k, t in FIELDS.items()})


def shard_rows(batches: Iterator[pa.RecordBatch], task: int, limits: tuple[int, int]) -> Iterator[dict]:
    """Of sorted sequences (turns, conv_id), the rows of one shard after another."""
    shard, made = Shard(limits=limits), 0

    def close() -> Iterator[dict]:
        number = (task << 24) + made
        for row in shard.settle(last=True):
            yield row | {"first": number}
        yield from shard.nodes(number)

    for batch in batches:
        turns, conv = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        offsets = turns.offsets.to_numpy()
        values = turns.values
        a, b, size = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        pairs = np.stack((a, b), axis=1).astype(np.int64)
        row = 0
        keys = [pairs[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(conv))]
        while row < len(conv):
            end = row + 1
            while end < len(conv) and keys[end] == keys[row]:
                end += 1
            if shard.full():
                yield from close()
                shard, made = Shard(limits=limits), made + 1
            for out in shard.add(keys[row], size[offsets[row] : offsets[row + 1]].astype(np.int64), conv[row:end]):
                yield out | {"first": (task << 24) + made}
            row = end
    if shard.keys:
        yield from close()


# --- the jobs ---------------------------------------------------------------------------------------------------------


def rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """Conversations by id, each with the first turns of the first of its group of ids in place of its own.

    turns: conv_id, turn, role, text. Turns are ordered by number, null first, those of one number by a hash of role and text. Null roles and
    texts are empty. Rows without conv_id belong to no conversation. Returns conv_id and turns, an array of (a, b: hash of role and
    text; size: bytes of the text). A task holds the hashes of `group` conversations, never a text.
    """
    role, text, first = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id") - F.col("conv_id") % group
    d = turns.where("conv_id is not null").select(
        first.alias("first"), F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"), F.octet_length(text).cast("long").alias("size"),
    )
    d = d.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("c", "turn", "a", "b", "size"))).alias("all"))
    d = d.select("first", "all", F.explode(F.array_distinct(F.transform("all", lambda x: x["c"]))).alias("conv_id"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    of = lambda c: F.filter("all", lambda x: x["c"] == F.col(c))
    d = d.select("conv_id", h.alias("h"), of("first").alias("head"), of("conv_id").alias("own"))
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return d.select(F.transform(turns, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["size"].alias("size"))).alias("turns"), "conv_id")


def joined_digests(blocks: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of a node's blocks, one after another, streamed; a list of any length takes no more memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for batch in batches:
            out = []
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if h:
                        out.append((node, h.hexdigest()))
                    node, h = key, hashlib.sha256(block)
                else:
                    h.update(b",")
                    h.update(block)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out])], names=["node", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    ordered = blocks.select("node", "block", "first", "conv_id").repartition("node").sortWithinPartitions("node", "first", "conv_id").select("node", "block")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def merged_paths(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes of all paths, each once, with totals over all shards.

    Paths are numbered in lexicographic order. A node is new on the first path that holds it, and the paths from its first to its last
    hold it all. So its subtree is what is new on its first path from its depth on, and all that is new on the later ones: sums over
    paths, no walk from level to level.
    """
    most = {"first": F.min("first"), "last": F.max("last"), "conv_id": F.min("conv_id"), "parent": F.first("parent"), "depth": F.first("depth"), "size": F.first("size"), "whole": F.max("ends_sha256")}
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    d = paths.groupBy("node").agg(*(v.alias(k) for k, v in most.items()), *(F.sum(k).alias(k) for k in sums))
    kids = d.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    d = d.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    d = d.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")})
    d = stash(d)
    totals = ("n_leaves", "saved_tokens")
    by_path = d.select(F.col("first").alias("path"), *totals).unionByName(d.select(F.col("last").alias("path"), *(F.lit(0).cast("long").alias(t) for t in totals)))
    upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # two rows for each shard
    by_path = by_path.groupBy("path").agg(*(F.sum(t).alias(t) for t in totals)).select("path", *(F.sum(t).over(upto).alias(t) for t in totals))
    below = Window.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = d.select("*", *(F.sum(t).over(below).alias(f"{t}_below") for t in totals)).drop(*totals)
    at = lambda end: by_path.select(F.col("path").alias(end), *(F.col(t).alias(f"{t}_{end}") for t in totals))
    out = own.join(at("first"), "first").join(at("last"), "last")
    out = out.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "whole", *((F.col(f"{t}_below") + F.col(f"{t}_last") - F.col(f"{t}_first")).alias(t) for t in totals))
    above = d.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above, "parent", "left").join(joined_digests(blocks), "node", "left").withColumn("ends_sha256", F.coalesce("whole", "ends_sha256", F.lit(EMPTY)))
    out = stash(out)
    unstash(d)
    return out


def columns() -> list[Column]:
    return [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]


def prefix_trie(turns: DataFrame, group: int = 5, heads: int = 9, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (see rebuilt(); `heads` - 1 turns at most come from a group's first one).

    turns: conv_id, turn, role, text; other columns, whatever their names, are not read. Nulls, ties and rows without conv_id as in
    rebuilt(); rows that repeat are turns of their own; an empty table has no node. Members of a node: conversations that start with it.
    Returns, for each node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and
    saved_tokens (over its subtree; bytes of the last turn's text times members less one), ends_sha256 (of the sorted ids of members
    that end there, comma-joined).
    """
    ship(turns.sparkSession)
    ordered = rebuilt(turns, group, heads).repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    shards = stash(ordered.mapInArrow(lambda batches: tables(shard_rows(batches, TaskContext.get().partitionId(), limits)), SHARD_SCHEMA))
    shared = merged_paths(shards.where("kind = 1"), shards.where("kind = 2"))
    own = shards.where("kind = 0")
    below = own.where("parent is not null").drop("parent_conv_id").join(shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return own.where("parent is null").select(columns()).unionByName(below.select(columns())).unionByName(shared.select(columns()))
