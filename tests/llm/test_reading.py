from __future__ import annotations

import math
import random

import numpy as np

from rankloom.llm import quality, reading

EASY = "el gato come pan . la niña ve el sol . mi mamá está en la casa y el perro corre . hay un pez en el mar .".split(" . ")
MIDDLE = "la comarca conserva un castillo que fue ampliado en el siglo pasado . el ayuntamiento publica cada año los precios del mercado . la carretera pasa junto al puente y cruza la villa antigua .".split(" . ")
HARD = "la fosforilación enzimática presupone una conceptualización epistemológica que trasciende el sincretismo . el determinismo estratigráfico desestabiliza la permeabilidad transmembranal en cuanto categoría analítica .".split(" . ")


def text(grade, seed):
    """Twelve sentences of the grade's words in ever other order, so that none is repeated."""
    rng = random.Random(seed)
    pool = " ".join((EASY, MIDDLE, HARD)[grade - 1]).split()
    return " ".join(" ".join(rng.sample(pool, min(len(pool), 9))).capitalize() + "." for _ in range(12))


def tables(spark):
    docs = [(100 * g + i, text(g, 1000 * g + i)) for g in (1, 2, 3) for i in range(40)]
    labels = [(k, k // 100 if k % 20 else 1 + k // 100 % 3, "a") for k, _ in docs if k % 2 == 0] + [(100, None, "b"), (102, 1, "b"), (102, 1, "c"), (102, 2, "d"), (None, 2, "a"), (104, 9, "a")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int, annotator string")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r["grade"] for r in reading.reading_levels(docs, labels, quality.ProseModel()).collect()}
    held = [k for k in got if k % 2]
    assert len(got) == 120 and sum(got[k] == k // 100 for k in held) / len(held) >= 0.95


def test_what_is_left_out(spark):
    docs, labels = tables(spark)
    more = [(1, None), (2, ""), (3, " "), (4, "cómo llegar al faro"), (5, "\n".join(f"- cosa {i}" for i in range(40))), (None, text(1, 1)), (6, text(1, 1)), (6, text(1, 1)), (7, " ".join(text(2, n) for n in range(200)))]
    got = [r["doc_id"] for r in reading.reading_levels(docs.union(spark.createDataFrame(more, "doc_id long, text string")), labels, quality.ProseModel()).collect()]
    assert len(got) == len(set(got)) and {6, 7} <= set(got) and not {1, 2, 3, 4, 5, None} & set(got)


def test_empty(spark):
    docs, labels = tables(spark)
    assert reading.reading_levels(docs.limit(0), labels, quality.ProseModel()).count() == 0
    assert reading.reading_levels(docs, labels.limit(0), quality.ProseModel()).count() == 0


def test_coverage_is_the_smallest_head():
    ranks = {w: i for i, w in enumerate("abcdef", 1)} | {"zz": reading.UNKNOWN_RANK}
    docs = [list("aabf"), ["zz"], list("fedcba")]
    own = np.array([ranks[w] for d in docs for w in d])
    got = np.exp(reading.coverage(own, np.array([len(d) for d in docs]), (0.5, 0.75, 1.0))).round(6)
    assert got.tolist() == [[1, 2, 6], [reading.UNKNOWN_RANK] * 3, [3, 5, 6]]


def test_complexity_of_texts_together():
    texts = ["Uno, dos. Tres!", "extraordinario 12 12"]
    vocabulary = ["uno", "dos", "tres", "extraordinario", "12"]
    got = reading.complexity(texts, np.array([0, 1, 2, 3, 4, 4]), np.array([3, 3]), vocabulary)
    assert np.allclose(got[0], [math.log(1.5), 10 / 3, 0, 1 / 3, 1, 0])
    assert np.allclose(got[1], [math.log(3), 18 / 3, 1 / 3, 0, 2 / 3, 2 / 3])
    assert reading.complexity([], np.empty(0, int), np.empty(0, int), vocabulary).shape == (0, 6)


def test_vocabulary_counts_all_blocks(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [2, 1, 1]), (["b", "d"], [1, 1]), ([], [])], "words array<string>, uses array<int>")
    assert {tuple(r) for r in reading.corpus_ranks(df).collect()} == {("a", 2, 2), ("b", 2, 2), ("c", 1, 4), ("d", 1, 4)}
