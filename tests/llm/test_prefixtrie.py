import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tablewright.llm import prefixtrie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute_force(rows):
    """Nodes by prefix, counted one conversation after another."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        s = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *own[c][h:])
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], ([], []))[0].append(c)
        nodes[s][1].append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for s in nodes:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    for s, (members, _) in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(m[0], len(s), nodes[s[:-1]][0][0] if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], digest(e)) for s, (m, e) in nodes.items()]


def talk(seed, n=150):
    """Conversations with hot first turns, copies, prefixes of others, one long one, nulls, and ids without conversation."""
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "été", None, ""]
    rows, made = [], []
    for c in rng.sample(range(3 * n), n):
        if made and rng.random() < 0.4:
            s = list(rng.choice(made))[: rng.randint(1, 9)]
        else:
            s = [("system", "hot")] * (rng.random() < 0.6) + [(rng.choice(["user", "assistant", None]), rng.choice(words)) for _ in range(rng.randint(1, 8))]
        made.append(s)
        rows += [(c, k if k else rng.choice([None, 0]), *t) for k, t in enumerate(s)]
    rows += [(3 * n + 7, k, "user", f"t{k}") for k in range(120)] + [(3 * n + 12, k, "user", f"t{k}") for k in range(119)]
    rows += [(5 * n + k, 0, "user", "same") for k in range(60)] + [(None, 0, "user", "no conversation"), (6 * n + 3, 5, "user", "after"), (-3, 0, "user", "below zero")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limits", "partitions"), [(prefixtrie.LIMITS, 2), ((3, 4), 2), ((40, 7), 9), ((1, 1), 1)])
def test_nodes(spark, limits, partitions):
    rows = talk(partitions)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS first", "2 AS depth", "3 AS parent")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, prefixtrie.prefix_trie(df, limits=limits).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(brute_force(rows), key=str)


def test_ties_and_repeats_are_stable(spark):
    rows = [(5, 1, "user", t) for t in "abcabc"] + [(5, None, "system", "s")] * 2
    runs = {tuple(sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), SCHEMA)).collect()), key=str)) for k in range(2)}
    assert len(runs) == 1 and len(runs.pop()) == 9  # the root and eight turns, repeated ones included


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(empty).count() == 0
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its own turn goes, its group's first is not there
    (root,) = prefixtrie.prefix_trie(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_double_array_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(3)
    trie, states, known = prefixtrie.DoubleArray(), [0], {}
    for _ in range(12):
        parents = rng.choice(states, min(40, len(states)), replace=False)
        pairs = sorted({(int(p), int(t)) for p in parents for t in rng.integers(0, 300, rng.integers(1, 9))} - known.keys())
        pairs = [(p, t) for p, t in pairs if p not in {q for q, _ in known}]
        if pairs:
            a, b = np.array(pairs).T
            trie.add(a, b)
            cells = trie.step(a, b)
            assert len(set(cells.tolist())) == len(cells) and not set(cells.tolist()) & set(states)
            known |= dict(zip(pairs, cells.tolist(), strict=True))
            states += cells.tolist()
    a, t = np.repeat(states, 300), np.tile(np.arange(300), len(states))
    assert {(int(p), int(x)): int(c) for p, x, c in zip(a, t, trie.step(a, t), strict=True) if c >= 0} == known
