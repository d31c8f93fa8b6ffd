"""Packing token sequences by cutting-stock column generation.

Every full `length` tokens of a document are a sequence of their own; the remainders are packed. Their lengths, in steps of STEP
tokens, are counted on the cluster; this histogram, of a fixed size, is all that the driver gets. The linear program
over it covers each class of lengths with patterns (ways to fill one sequence) by as few sequences as can be. It starts from first-fit
patterns; the restricted program gives a price to each class, a knapsack by dynamic programming finds the pattern of most
worth at these prices, and it enters the program, until no pattern is worth more than a sequence or the sequences are proven
to be within GAP of the fewest. Patterns are used, the fullest in real tokens first, as often as the solution says,
rounded down, while little stays empty; full ones once more where the classes still have documents, then by first fit. Documents
are ranked within their class on the cluster, and their ranks give each its pattern, sequence and place. All that is left, be it
few items or the whole table, is laid end to end and cut at the bounds of sequences, the last of which are powers of two, without
padding.

The program's algebra is written in plain sums, without matrix products: the threads of a linear-algebra library may not outlive
the process's fork at the start of a Spark session.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows, stash
from tablewright.llm.tokens import ChunkTokens, proven

STEP = 4
#: Column generation ends when its sequences are proven to be within this share of the fewest.
GAP = 1e-5
#: Share by which demands are moved, against ties among the program's solutions.
SHIFT = 1e-3
#: Documents of a class that are ranked together, on average.
GROUP_ROWS = 100
#: Sequences of patterns are at least so full together, in real tokens, and those of one pattern at least FLOOR; first fit makes none
#: below FULLNESS. What would be in emptier ones is laid end to end instead.
FULLNESS, FLOOR = 0.992, 0.9


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth, and its worth: unbounded knapsack by dynamic programming."""
    worth_of = np.full(capacity + 1, -np.inf)  # of an item of each size
    worth_of[sizes] = prices
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = worth_of[1 : c + 1] + best[c - 1 :: -1]
        k = int(worth.argmax())
        best[c], pick[c] = best[c - 1], 0
        if worth[k] > best[c]:
            best[c], pick[c] = worth[k], k + 1
    found, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        found[pick[c]] += 1
        c -= max(int(pick[c]), 1)
    return float(best[capacity]), found[sizes]


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern of what is left, the largest classes first."""
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        if sizes[k] <= room and left[k] > 0:
            pattern[k] = min(room // int(sizes[k]), max(int(left[k]), 1))
            room -= int(pattern[k] * sizes[k])
    return pattern


def start_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis with a feasible solution, its inverse and the solution: first-fit patterns, each used until one of its classes is covered.

    A pattern holds no class that was covered before, so its entry in the basis is one pivot step on the inverse."""
    left, n = demand.astype(float), len(sizes)
    most = np.maximum(capacity // sizes, 1).astype(float)
    basis, inverse, times = np.diag(most), np.diag(1 / most), np.zeros(n)
    while (left > 0).any():
        pattern = first_fit(sizes, left, capacity)
        inside = np.flatnonzero(pattern)
        ratio = left[inside] / pattern[inside]
        k = inside[int(ratio.argmin())]
        enter_basis(basis, inverse, k, pattern, (inverse * pattern).sum(axis=1))
        times[k] = ratio.min()
        left[inside] -= times[k] * pattern[inside]
        left[k] = 0.0
        left[left < 1e-9] = 0.0
    return basis, inverse, times


def enter_basis(basis: np.ndarray, inverse: np.ndarray, k: int, pattern: np.ndarray, enter: np.ndarray) -> None:
    """Put the pattern in place of the basis's k-th; enter: the pattern in terms of the basis."""
    basis[:, k] = pattern
    inverse[k] /= enter[k]
    others = enter.copy()
    others[k] = 0.0
    inverse -= others[:, None] * inverse[k]


@dataclass
class Program:
    """A solution of the linear program: patterns (a column each), how often each is used, in fractions (patterns @ times = demand), and
    a bound that no solution is below."""

    patterns: np.ndarray
    times: np.ndarray
    bound: float
    rounds: int


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> Program:
    """Few sequences for the demand of each class, by pricing until they are within `gap` of the fewest (0: until no pattern helps)."""
    basis, inverse, times = start_basis(sizes, demand, capacity)
    stalled, bound, rounds = 0, float((demand * sizes).sum()) / capacity, 0
    # steps of no length that go on and on would be a circle: what the patterns do not cover is cut by the caller
    while times.sum() > bound * (1 + gap) and stalled <= 4 * len(sizes) + 100:
        prices = inverse.sum(axis=0)
        worth, pattern = knapsack(prices, sizes, capacity)
        # prices divided by the worth are feasible for the dual program, so their value is a bound
        bound = max(bound, float((prices * demand).sum()) / max(worth, 1.0))
        if worth <= 1 + 1e-9:
            break
        enter = (inverse * pattern).sum(axis=1)
        positive = enter > 1e-6  # smaller pivots would magnify rounding
        ratio = np.where(positive, times / np.where(positive, enter, 1.0), np.inf)
        k = int(ratio.argmin())
        step = max(ratio[k], 0.0)
        stalled = 0 if step > 1e-9 else stalled + 1
        times = np.maximum(times - step * enter, 0.0)
        times[k] = step
        enter_basis(basis, inverse, k, pattern, enter)
        rounds += 1
    return Program(basis.astype(np.int64), times, bound, rounds)


@dataclass
class Plan:
    """Where the ranked documents of each class go. starts: the first position (class start + rank) of each interval, ascending;
    sequence: of its first document, or -1 for those laid end to end; slot: the order within the sequence."""

    first: dict[int, int]  # of each class, its first position
    starts: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray
    sequences: int


def plan_patterns(counts: dict[int, int], length: int, tokens: dict[int, int] | None = None) -> Plan:
    """counts: documents of each class (a class k holds remainders of (k - 1) * STEP + 1 to k * STEP tokens); tokens: of all remainders
    of each class, k * STEP for each document if not given."""
    capacity = length // STEP
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(s)] for s in sizes], np.int64)
    if not len(sizes):
        return Plan({}, np.zeros(1, np.int64), np.array([-1]), np.array([0]), 0)
    mean = np.array([tokens[int(s)] for s in sizes]) / demand if tokens else sizes * float(STEP)
    shifted = demand * (1 + SHIFT * np.random.default_rng(1).random(len(demand)))
    program = column_generation(sizes, shifted, capacity)
    patterns, times = program.patterns, program.times
    used: list[tuple[np.ndarray, int]] = []
    left, spare = demand.copy(), (1 - FULLNESS) * float((mean * demand).sum())  # tokens that may stay empty in all sequences together

    def use(pattern: np.ndarray, n: int) -> bool:
        nonlocal left, spare
        inside, empty = pattern > 0, max(length - float((pattern * mean).sum()), 1e-9)
        n = min(n, int((left[inside] // pattern[inside]).min()), int(spare / empty)) if inside.any() else 0
        if n > 0:
            used.append((pattern, n))
            left = left - n * pattern
            spare -= n * empty
        return n > 0

    full = lambda p: float((p * mean).sum()) >= FULLNESS * length
    fill = (mean[:, None] * patterns).sum(axis=0) / length
    for k in np.argsort(-fill, kind="stable"):  # the fullest first
        if fill[k] >= FLOOR:
            use(patterns[:, k], int(times[k] + 1e-7))
    for k in np.argsort(-(times - np.floor(times + 1e-7)), kind="stable"):
        if full(patterns[:, k]):
            use(patterns[:, k], 1)
    while True:  # first fit, the largest first
        pattern = first_fit(sizes, left, capacity)
        if not full(pattern) or not use(pattern, int(left.max())):
            break

    first = dict(zip(sizes.tolist(), (np.cumsum(demand) - demand).tolist(), strict=True))
    at = np.cumsum(demand) - demand
    rows, sequence = [], 0
    for pattern, n in used:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            for _ in range(pattern[k]):
                rows.append((at[k], sequence, slot))
                at[k] += n
                slot += 1
        sequence += n
    rows += [(a, -1, 0) for a, rest in zip(at, left, strict=True) if rest > 0]
    rows.sort()
    starts, seq, slots = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return Plan(first, starts, seq, slots, sequence)


def encoded(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """Of each document: its tokens with the end, the CRC-32 of each full sequence's ids and of the remainder's."""
    end, whole = np.array([end_id], "<u4"), proven(vocabulary)

    def make():
        tokens = ChunkTokens.get(vocabulary, whole, ids=True)

        def fn(rows):
            out: dict = {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "doc_tokens": [], "full": [], "rest_crc": []}
            for ids in tokens.encoded(rows["text"]):
                ids = np.append(ids, end)
                cut = len(ids) - len(ids) % length
                out["doc_tokens"].append(len(ids))
                out["full"].append([zlib.crc32(ids[a : a + length]) for a in range(0, cut, length)])
                out["rest_crc"].append(zlib.crc32(ids[cut:]))
            return out

        return fn

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, "doc_id long, text_key long, doc_tokens long, full array<long>, rest_crc long")


def cut_crcs(docs: DataFrame, cuts: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the pieces of the documents that are cut.

    cuts: doc_id, text_key and plan: the pieces, flattened, of a row that these identify.
    """
    end, whole = np.array([end_id], "<u4"), proven(vocabulary)

    def make():
        tokens = ChunkTokens.get(vocabulary, whole, ids=True)

        def fn(rows):
            out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for i, ids, plan in zip(rows["doc_id"], tokens.encoded(rows["text"]), rows["plan"], strict=True):
                ids = np.append(ids, end)
                for start, n, sequence, offset in zip(*[iter(plan)] * 4, strict=True):
                    for k, v in zip(out, (i, start, n, zlib.crc32(ids[start : start + n]), len(ids), sequence, offset), strict=True):
                        out[k].append(v)
            return out

        return fn

    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    c = cuts.alias("c")
    found = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")))
    found = found.select("d.doc_id", "d.text_key", "d.text", "c.plan").dropDuplicates(["doc_id", "text_key"])
    return map_rows(found.select("doc_id", "text", "plan"), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def bounds(total: int, length: int) -> list[tuple[int, int]]:
    """Starts and lengths of the sequences of powers of two into which the last, partly filled one is cut."""
    at, rest, out = total - total % length, total % length, []
    while rest:
        n = 1 << (rest.bit_length() - 1)
        out.append((at, n))
        at, rest = at + n, rest - n
    return out


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `length` tokens.

    docs: doc_id, text; other columns, whatever their names, are not read. A document is its ids, without added special tokens,
    then end_id, so that null, empty and blank texts have one token. Null doc_ids and repeated rows are documents of their own.
    Each id lies in exactly one piece; pieces of a sequence lie gapless from offset 0. An empty table gives no rows.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece.
    """
    spark = docs.sparkSession
    rest = F.col("doc_tokens") % length
    coded = stash(encoded(docs, vocabulary, length, end_id).withColumn("class", F.ceil(rest / STEP).cast("int")))
    histogram = {r["class"]: (r["n"], r["full"], r["tokens"]) for r in coded.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("full"), F.sum(rest).alias("tokens")).collect()}
    plan = plan_patterns({k: n for k, (n, _, _) in histogram.items() if k}, length, {k: t for k, (_, _, t) in histogram.items() if k})

    # ranks: salted groups of each class, whose counts give them their first rank; in an order that tells nothing of the length, so that
    # any part of a class has its mean
    base, rows = 0, []
    for k in sorted(histogram):
        rows.append((k, max(1, -(-histogram[k][0] // GROUP_ROWS)), plan.first.get(k, 0), base))
        base += histogram[k][1]
    classes = F.broadcast(spark.createDataFrame(rows or [(0, 1, 0, 0)], "class int, salts int, first long, first_full long"))
    narrow = coded.join(classes, "class").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("salts")))
    group = narrow.groupBy("class", "salt").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("n_full"))
    ahead = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("class", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.coalesce(F.sum("n_full").over(ahead), F.lit(0)).alias("before_full"))
    within = Window.partitionBy("class", "salt").orderBy("text_key", "doc_id")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    ranked = narrow.withColumn("rank", F.row_number().over(within) - 1).withColumn("rank_full", F.coalesce(F.sum(F.size("full")).over(earlier), F.lit(0)))
    ranked = ranked.join(group, ["class", "salt"])
    ranked = ranked.withColumn("position", F.when(F.col("class") > 0, F.col("first") + F.col("before") + F.col("rank")))
    ranked = ranked.withColumn("full_at", F.col("first_full") + F.col("before_full") + F.col("rank_full"))

    starts, sequence, slot = plan.starts, plan.sequence, plan.slot

    @F.pandas_udf("struct<sequence: long, slot: long>")
    def place(position: pd.Series) -> pd.DataFrame:
        at = position.fillna(0).to_numpy().astype(np.int64)
        k = np.searchsorted(starts, at, side="right") - 1
        return pd.DataFrame({"sequence": np.where(sequence[k] >= 0, sequence[k] + at - starts[k], -1), "slot": slot[k]})

    placed = stash(ranked.withColumn("place", place("position")).select("doc_id", "text_key", "doc_tokens", "full", "rest_crc", "class", "salt", "position", "full_at", F.col("place.sequence").alias("sequence"), F.col("place.slot").alias("slot"), rest.alias("rest")))

    # remainders in patterns
    order = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where("class > 0 and sequence >= 0").withColumn("offset", F.coalesce(F.sum("rest").over(order), F.lit(0)))
    whole = whole.select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")

    # remainders laid end to end: tokens of salted groups give them their first place
    laid = placed.where("class > 0 and sequence < 0")
    totals = {r["class"]: r["n"] for r in laid.groupBy("class").agg(F.sum("rest").alias("n")).collect()}
    total, rows = 0, []
    for k in sorted(totals):
        rows.append((k, total))
        total += totals[k]
    lines = F.broadcast(spark.createDataFrame(rows or [(0, 0)], "class int, line long"))
    group = laid.groupBy("class", "salt").agg(F.sum("rest").alias("n")).select("class", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    line = Window.partitionBy("class", "salt").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("ahead", F.coalesce(F.sum("rest").over(line), F.lit(0))).join(group, ["class", "salt"]).join(lines, "class")
    laid = stash(laid.select("doc_id", "text_key", "doc_tokens", "rest", "rest_crc", (F.col("line") + F.col("before") + F.col("ahead")).alias("at")))
    tail, even = bounds(total, length), total // length
    pieces = F.concat(
        F.transform(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("rest") - 1) / length)), lambda s: F.struct((s * length).alias("from"), F.lit(length).cast("long").alias("size"), (s + plan.sequences).alias("sequence"))),
        F.array(*(F.struct(F.lit(a).cast("long").alias("from"), F.lit(n).cast("long").alias("size"), F.lit(plan.sequences + even + k).cast("long").alias("sequence")) for k, (a, n) in enumerate(tail))).cast("array<struct<from:bigint,size:bigint,sequence:bigint>>"),
    )
    in_one = (F.floor(F.col("at") / length) == F.floor((F.col("at") + F.col("rest") - 1) / length)) & (F.col("at") + F.col("rest") <= even * length)
    uncut = laid.where(in_one).select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", (F.floor(F.col("at") / length) + plan.sequences).alias("sequence_id"), (F.col("at") % length).alias("offset"))
    cut = laid.where(~in_one).select("doc_id", "text_key", "doc_tokens", "rest", "at", F.explode(pieces).alias("p")).where(F.col("p.from") + F.col("p.size") <= total)
    cut = cut.withColumn("a", F.greatest("at", "p.from")).withColumn("b", F.least(F.col("at") + F.col("rest"), F.col("p.from") + F.col("p.size"))).where("a < b")
    start = F.col("doc_tokens") - F.col("rest") + F.col("a") - F.col("at")
    # written, so that its size is known and the texts are only shuffled for it where it is large
    cuts = stash(cut.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list(F.array(start, F.col("b") - F.col("a"), F.col("p.sequence"), F.col("a") - F.col("p.from")))).alias("plan")))
    parts = cut_crcs(docs, cuts, vocabulary, end_id)

    # full sequences
    last = plan.sequences + even + len(tail)
    full = placed.where("size(full) > 0").select("doc_id", "doc_tokens", "full_at", F.posexplode("full").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("full_at") + F.col("k") + last).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(uncut).unionByName(parts).unionByName(full)
