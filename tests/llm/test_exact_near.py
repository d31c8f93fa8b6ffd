import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import components, exactdup, neardup
from tests.llm.helpers import WORD, corpus, frame, sentence


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_fingerprint_composes():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    for cut in (1, 17, 2500, 4999):
        for k in (0, 1):
            whole = exactdup.chunk_hash(data, k)
            assert exactdup.combine(exactdup.chunk_hash(data[:cut], k), exactdup.chunk_hash(data[cut:], k), len(data) - cut, k) == whole
    long = data * 40
    assert exactdup.fingerprint(long) != exactdup.fingerprint(long[:-1] + b"!")


def expected_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


def test_exact_duplicates(spark):
    rows = corpus()
    got = [tuple(r) for r in exactdup.exact_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(expected_exact(rows), key=str)


def test_long_texts_are_hashed_in_parallel(spark):
    """Chunks that are hashed apart make the fingerprint of the whole."""
    rng = random.Random(3)
    long = sentence(rng, 60_000)
    rows = [(1, long, "s", "en"), (2, long.upper(), "s", "en"), (1, long, "s", "en"), (3, long[:-1] + "!", "s", "en"), (4, None, "s", "en"), (None, long, "s", "en")]
    got = exactdup.fingerprints(frame(spark, rows), long=1000).collect()
    assert sorted((str(r.doc_id), r.fp, r.n_bytes, r.text_sha256) for r in got) == sorted(
        (str(i), exactdup.fingerprint(lower(t).encode()), len(lower(t).encode()), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows
    )


def test_exact_collision(spark, monkeypatch):
    """Texts of equal fingerprint and length that differ are told apart."""
    monkeypatch.setattr(exactdup, "fingerprints", lambda d, f=exactdup.fingerprints: f(d).withColumn("fp", exactdup.F.lit(5).cast("long")))
    monkeypatch.setattr(exactdup, "chunks", lambda d, f=exactdup.chunks: f(d).withColumn("fp", exactdup.F.lit(5).cast("long")))
    rows = [(1, "abc", "s", "en"), (2, "abd", "s", "en"), (3, "ABC", "s", "en")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdup.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_exact_keep_one(spark):
    rows = corpus()
    got = exactdup.keep_one(frame(spark, rows))
    texts = [lower(r.text) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t, *_ in rows})
    unique = [r for r in rows[:-2]]
    kept = {r.doc_id for r in exactdup.keep_one(frame(spark, unique)).collect()}
    assert kept == {i for i, _, _, k, _ in expected_exact(unique) if k}


@pytest.mark.parametrize("op", [exactdup.exact_duplicates, exactdup.keep_one, neardup.near_duplicates, neardup.keep_one])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def chain(seed, n=40):
    """Each text a few words further from the first: neighbours are linked, the ends are not."""
    rng = random.Random(seed)
    words, out = sentence(rng, 120).split(), []
    for i in range(n):
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"new{i}_{rng.random()}"
        out.append(((i * 17) % n, " ".join(words), "s", "en"))
    return out


@pytest.mark.parametrize("rows", [corpus(1), chain(4, 60)], ids=["corpus", "chain"])
def test_near_duplicates(spark, rows):
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_hot_group_links(spark):
    """A group of copies edited at many rates: some are linked to the smallest id, some only to others, some to none."""
    rng = random.Random(5)
    words, rows = sentence(rng, 100).split(), []
    for i in range(150):
        w = list(words)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(w), "s", "en"))
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()} == want


def test_large_buckets_are_dealt(spark, monkeypatch):
    """Buckets above SPLIT, here nearly all, give the same groups."""
    monkeypatch.setattr(neardup, "SPLIT", 3)
    monkeypatch.setattr(neardup, "MEET", 4)
    rows = corpus(2) + [(5000 + i, t, s, x) for i, t, s, x in chain(5, 50)]
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect() if r.doc_id is not None} == want


def test_signature_distance_guarantee():
    """Signatures that differ in CHUNKS * (ERRORS + 1) - 1 symbols share a chunk with one symbol left out."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 1 << 16, neardup.SYMBOLS)
        y = x.copy()
        y[rng.choice(neardup.SYMBOLS, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)] += 1
        differ = (x != y).reshape(neardup.CHUNKS, neardup.WIDTH).sum(axis=1)
        assert (differ <= neardup.ERRORS).any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
