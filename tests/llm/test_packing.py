import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from tablewright.llm import packing
from tests.llm.helpers import corpus, frame, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(tokenizer().encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.mark.parametrize("length", [64, 256])
def test_round_trip(spark, length):
    rng = random.Random(1)
    rows = corpus()[:-2] + [(1000 + i, sentence(rng, rng.randint(1, 90)), "s", "en") for i in range(250)] + [(None, "no id", "s", "en")]
    got = [r.asDict() for r in packing.pack(frame(spark, rows), PATH, length=length).collect()]
    for i, t, *_ in rows:
        ids, at = ids_of(t), 0
        for p in sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    fill = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(fill.values()) <= length and sorted(fill) == list(range(len(fill)))
    padding = sum(length - n for n in fill.values() if n & (n - 1))
    assert padding <= 0.02 * sum(fill.values())


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f", "s", "en")] * 7 + [(2, None, "s", "en")] * 3
    got = packing.pack(frame(spark, rows), PATH, length=16).collect()
    assert sum(r.length for r in got) == 7 * 7 + 3
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len(places) == len(set(places))


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_knapsack():
    rng = np.random.default_rng(1)
    sizes, prices = np.array([3, 5, 7, 11]), rng.random(4)
    best = max(float(np.array(c) @ prices) for c in np.ndindex(9, 6, 4, 3) if np.array(c) @ sizes <= 25)
    worth, pattern = packing.knapsack(prices, sizes, 25)
    assert abs(worth - best) < 1e-12 and pattern @ sizes <= 25 and abs(pattern @ prices - worth) < 1e-12


def test_column_generation_reaches_the_optimum():
    """Rolls of 100 cut into 45, 36, 31 and 14: the known least is 452.25 rolls."""
    sizes, demand = np.array([14, 31, 36, 45]), np.array([211.0, 395.0, 610.0, 97.0])
    got = packing.column_generation(sizes, demand, 100, gap=0)
    assert np.allclose((got.patterns * got.times).sum(axis=1), demand) and ((got.patterns.T * sizes).sum(axis=1) <= 100).all()
    assert abs(got.times.sum() - 452.25) < 1e-6 and got.rounds > 0


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_column_generation_is_within_its_proven_gap(n):
    lengths = np.exp(np.random.default_rng(1).normal(5.8, 1.0, n)).astype(int) % 2048
    sizes, demand = np.unique(-(-lengths[lengths > 0] // packing.STEP), return_counts=True)
    got = packing.column_generation(sizes, demand.astype(float), 2048 // packing.STEP)
    assert got.rounds > 0 and got.bound <= got.times.sum() <= got.bound * (1 + packing.GAP)
    assert np.allclose((got.patterns * got.times).sum(axis=1), demand, rtol=0, atol=0.01)


def padding_share(plan, tokens, length=2048):
    """Share of the pattern sequences' room that stays empty, of all tokens; what patterns do not take is cut without padding."""
    ends = np.append(plan.starts[1:], len(tokens))
    used = sum(int(tokens[a:b].sum()) for a, b, q in zip(plan.starts, ends, plan.sequence, strict=True) if q >= 0)
    return (plan.sequences * length - used) / tokens.sum()


@pytest.mark.parametrize("lengths", [[1200], [1400, 1600], range(1100, 2001), range(1, 2048), [3], [5], [700, 1300]])
def test_padding_is_small_whatever_the_lengths(spark, lengths):
    """Planned after the session's start, in whose process a threaded matrix product may never end."""
    tokens = np.sort(np.random.default_rng(1).choice(list(lengths), 20_000))
    classes = -(-tokens // packing.STEP)
    kinds, n = np.unique(classes, return_counts=True)
    total = np.bincount(classes, weights=tokens)[kinds]
    plan = packing.plan_patterns(dict(zip(kinds.tolist(), n.tolist(), strict=True)), 2048, dict(zip(kinds.tolist(), total.tolist(), strict=True)))
    for k, c in enumerate(kinds):  # ranks tell nothing of the length
        np.random.default_rng(k).shuffle(tokens[plan.first[int(c)] : plan.first[int(c)] + n[k]])
    assert padding_share(plan, tokens) <= 0.01


def test_plan_places_every_document_once(spark):
    rng = random.Random(2)
    counts = {k: rng.randint(1, 60) for k in rng.sample(range(1, 513), 200)}
    plan = packing.plan_patterns(counts, 2048)
    fill, laid = {}, 0
    for k, n in counts.items():
        for rank in range(n):
            at = plan.first[k] + rank
            i = int(np.searchsorted(plan.starts, at, side="right")) - 1
            if plan.sequence[i] < 0:
                laid += 1
                continue
            key = int(plan.sequence[i] + at - plan.starts[i])
            fill.setdefault(key, []).append((int(plan.slot[i]), k))
    assert set(fill) == set(range(plan.sequences)) and all(sum(k for _, k in v) <= 512 for v in fill.values())
    assert all(len({s for s, _ in v}) == len(v) for v in fill.values()) and laid < sum(counts.values()) / 5


@pytest.mark.parametrize("tokens", [[35], [3], [5], [35, 3, 5]])
def test_skewed_lengths_are_not_padded(spark, tokens):
    """Remainders that cannot be combined into full sequences are cut, whatever their number."""
    rows = [(i, " a" * (tokens[i % len(tokens)] - 1), "s", "en") for i in range(400)]
    assert [len(ids_of(t)) for _, t, *_ in rows[: len(tokens)]] == tokens
    fill, seen = {}, {}
    for p in sorted(packing.pack(frame(spark, rows), PATH, length=64).collect(), key=lambda p: (p["sequence_id"], p["offset"])):
        ids = ids_of(rows[p["doc_id"]][1])
        assert p["offset"] == fill.get(p["sequence_id"], 0) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        fill[p["sequence_id"]] = p["offset"] + p["length"]
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for i, t, *_ in rows:
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at
            at += n
        assert at == len(ids_of(t))
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 64
    assert sum(64 - n for n in fill.values() if n & (n - 1)) <= 0.02 * sum(fill.values())


def test_plan_uses_full_patterns_only():
    assert packing.plan_patterns({275: 1000}, 2048).sequences == 0
    assert packing.plan_patterns({1: 5120}, 2048, {1: 3 * 5120}).sequences == 0
    assert packing.plan_patterns({1: 5120}, 2048).sequences == 10
