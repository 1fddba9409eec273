"""All words of the corpus have their own ranks, however documents are cut into blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np

from rankloom.llm import quality, reading
from rankloom.llm.words import words
from tests.llm.test_reading import tables, text


def watched(monkeypatch, spark, docs, labels, **options):
    seen = []
    fit = reading.LevelModel.fit.__func__
    monkeypatch.setattr(reading.LevelModel, "fit", classmethod(lambda cls, sample, passes=2: seen.append(sample) or fit(cls, sample, passes)))
    got = sorted(map(tuple, reading.reading_levels(docs, labels, quality.ProseModel(), **options).collect()))
    monkeypatch.undo()
    return seen[0], got


def test_ranks_and_grades_do_not_depend_on_blocks(spark, monkeypatch):
    docs, labels = tables(spark)
    uses = Counter(w for r in docs.collect() for w in words(r["text"]))
    expected = {w: sum(n >= uses[w] for n in uses.values()) for w in uses}
    results = []
    for size in (reading.BLOCK_WORDS, 300, 1):
        sample, got = watched(monkeypatch, spark, docs, labels, block_words=size)
        assert {w: sample.corpus[n] for w, n in sample.number.items()} == {w: expected[w] for w in sample.number}
        listed = list(sample.number)
        texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
        assert all([listed[c] for c in codes] == texts[key] for key, _, codes, _ in sample.docs)
        results.append(got)
    assert len(results[0]) == 120 and results[0] == results[1] == results[2]


def test_long_documents_are_graded_but_not_fitted_on(spark, monkeypatch):
    docs, labels = tables(spark)
    long = " ".join(text(3, n) for n in range(50))
    docs = docs.where("doc_id <> 302").union(spark.createDataFrame([(302, long)], "doc_id long, text string"))
    sample, got = watched(monkeypatch, spark, docs, labels, train_words=1000)
    assert 302 not in {d[0] for d in sample.docs} and 302 in {k for k, _ in got}
    assert max(len(d[2]) for d in sample.docs) <= 1000 and len(got) == 120
    assert np.isfinite([x for d in sample.docs for x in d[3]]).all()
