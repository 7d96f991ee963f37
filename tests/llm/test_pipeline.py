"""The pipeline, stage by stage, on odd documents and on tables with known copies."""

import random

import corpus_pipeline
import pytest
from tests.llm import cases
from tests.llm.test_copies import closure, plain_print, plain_repeats

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    cases.documents(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (8, None, None)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("clashing", [False, True])
def test_stages_take_odd_documents(spark, folder, clashing):
    docs = cases.documents(spark, clashing)
    n = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        n[name] = out.count()
    lettered = sum(any(c.isalpha() for c in t or "") for _, t in cases.texts())
    assert n["language"] <= lettered
    assert n["toxicity"] == n["repeats"] == len(cases.texts())


def test_no_documents(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.none_at_all(spark), folder).count() == 0


def test_one_document_of_each_group_stays(spark, folder):
    prints = [(k, plain_print(t), t) for k, t in cases.texts()]
    keyed = [(k, p) for k, p, _ in prints if k is not None]
    group = closure({k for k, _ in keyed}, [(a, b) for a, p in keyed for b, q in keyed if (p ^ q).bit_count() <= 4])
    known = {p for _, p in keyed}
    want = sorted(set(group.values())) + [None for p in {p for k, p, _ in prints if k is None and p not in known}]
    got = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, cases.documents(spark), folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_leave_the_text(spark, folder):
    out = corpus_pipeline.without_repeats(spark, cases.documents(spark), folder).collect()
    removed = {(k, n): gone for (k, n, gone, _) in plain_repeats(cases.texts(), 20)}
    for r in out:
        words = len((r.text or "").split())
        assert any(k == r.doc_id and n - gone == words for (k, n), gone in removed.items())
        assert r.n_chars == len(r.text or "")


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    assert 1 not in kept and 2 not in kept and 0 in kept  # copies of the first
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
