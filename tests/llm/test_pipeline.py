"""The pipeline's stages against plain versions of their decisions."""

import re

import corpus_pipeline
from shelfwise.llm import quality, secrets, toxicity
from shelfwise.llm.common import table

from .test_dedup import brute
from .test_scans import base_spans


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    labels = table(spark, sf_dir, "labels")
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES

    one = first(spark, docs, sf_dir).cache()
    m = quality.train(docs, labels)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if m.scores([r.text or ""])[0] >= 0.5}

    two = second(spark, one, sf_dir).cache()
    t = toxicity.train(one, labels)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect() if t.score(r.text or "") < 0.5}

    three = third(spark, two, sf_dir).cache()
    want = brute([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert {r.doc_id for r in three.collect()} == {i for i, (_, _, kept) in want.items() if kept}

    four = fourth(spark, three, sf_dir).cache()
    before = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id] or not re.search(secrets.TOKEN, r.text)
    assert one.columns == two.columns == three.columns == four.columns == columns

    five = fifth(spark, four, sf_dir)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_run_and_odd_tables(spark, sf_dir, odd, empty):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for docs, n in ((odd, None), (empty, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            docs = out
        got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
        assert n is None or got == n
