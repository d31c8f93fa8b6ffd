import inspect
import os

import pytest

import corpus_pipeline
from tests.llm.helpers import corpus, frame
from tests.llm.test_exact_near import brute_components, expected_exact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, SF))
        assert docs.columns == columns, name
        kept[name] = (before, docs)
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    a, b = kept["quality"]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    left = {i for i, _ in rows(b)}
    assert len(good & left) >= 0.97 * len(good) and len(bad & left) <= 0.2 * len(bad)
    a, b = kept["exact_duplicates"]
    assert sorted(i for i, _ in rows(b)) == sorted(i for i, _, _, k, _ in expected_exact(rows(a)) if k)
    a, b = kept["near_duplicates"]
    assert sorted(i for i, _ in rows(b)) == sorted(i for i, (_, c) in brute_components(rows(a)).items() if i == c)
    a, b = kept["source_mix"]
    assert {i for i, _ in rows(b)} <= {i for i, _ in rows(a)} and b.count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_signatures():
    assert [len(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [3] * 5


@pytest.mark.parametrize("rows", [[], corpus(2)], ids=["empty", "odd"])
def test_stages_take_odd_rows(spark, rows):
    """Nulls, empty and blank texts, repeated rows, a row without id, columns with clashing names, and tables without rows."""
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert bool(kept) == bool(rows), name
        assert {(r.doc_id, r.text) for r in kept} <= {(i, t) for i, t, *_ in rows}, name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert got.count() >= len(rows) and bool(got.count()) == bool(rows)


def test_classifier_without_documents(spark):
    """No labelled text: every text scores 0.5, and a threshold below keeps all."""
    from tablewright.llm import classifier

    none, some = frame(spark, []), frame(spark, corpus(2))
    model = classifier.train(none, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert classifier.score(none, model).count() == classifier.accepted(none, model, 0.3).count() == 0
    assert {r.score for r in classifier.score(some, model).collect()} == {0.5} and classifier.accepted(some, model, 0.3).count() == some.count()
