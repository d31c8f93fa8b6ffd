"""Members of large buckets that are linked with the bucket's smallest id alone."""

import random

from tablewright.llm import neardup


def test_members_of_a_large_bucket_meet_its_smallest_id(spark, monkeypatch):
    """Texts that are each linked with text 0 and with none of the others: no part's head gives the link."""
    rng, base = random.Random(4), [f"w{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for i in range(1, 121):
        at = rng.sample(range(6, 98), 3)
        rows.append((i, " ".join(f"x{i}" if k in at[:2] else w for k, w in enumerate(base))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(100)} for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {i for i in sets if linked(0, i)}
    assert len(want) > 100 and sum(linked(a, b) for a in want for b in want if 0 < a < b) < 0.2 * len(want) ** 2
    monkeypatch.setattr(neardup, "SPLIT", 4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in got if got[i] == 0} >= want
