"""Columns of delimiters, indentation period and line-length autocorrelation take part in the judgement of a text."""

from __future__ import annotations

import random

import numpy as np

from rankloom.llm import quality

WORDS = "el rio baja lento entre sauces y la gente del pueblo cruza por un puente de madera que nadie recuerda nuevo".split()


def line(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def indented(rng, periodic):
    places = [0, 4, 8] * 10
    if not periodic:
        rng.shuffle(places)
    return "\n".join(" " * i + line(rng, 8) for i in places)


def lengths(rng, periodic):
    sizes = [7, 13] * 15
    if not periodic:
        rng.shuffle(sizes)
    return "\n".join(line(rng, n) for n in sizes)


def columns(rng, standing):
    """Two cells behind words of differing lengths, in a column or wherever they come."""
    rows = [(line(rng, 2), line(rng, 2)) for _ in range(20)]
    return "\n".join(f"{a:<24}  {b}" if standing else a + " " * rng.choice([2, 5, 9, 14]) + b for a, b in rows)


def agreement(make):
    rng = random.Random(4)
    docs = [(n % 2 == 0, make(rng, n % 2 == 0)) for n in range(120)]
    measured = quality.stretch_features([t for _, t in docs])
    model = quality.ProseModel.fit([(y, rows) for (y, _), (rows, _) in zip(docs[:60], measured[:60], strict=True)])
    shares = quality.other_shares([t for _, t in docs[60:]], model)
    return np.mean([(s > 0.5) == y for (y, _), s in zip(docs[60:], shares, strict=True)])


def test_layout_by_indentation_alone():
    assert agreement(indented) >= 0.9


def test_layout_by_line_lengths_alone():
    assert agreement(lengths) >= 0.9


def test_columns_of_delimiters():
    rng = random.Random(2)
    assert agreement(columns) >= 0.9
    fixed, free = quality.text_shape(columns(rng, True)), quality.text_shape(columns(rng, False))
    assert fixed["delimiter_columns"] == 1.0 and free["delimiter_columns"] < 0.5
    assert fixed["delimiter_alignment"] == free["delimiter_alignment"] == 1.0  # as many in each line, wherever they stand
    wandering = "\n".join("x" * (1 + n % 7) + "   dos" for n in range(14))
    assert quality.text_shape(wandering)["delimiter_columns"] == 0.0
    tabs = "\n".join(f"{'ab' * (1 + n % 3)}\t{n}" for n in range(9))
    assert quality.text_shape(tabs)["delimiter_columns"] == 1.0
    assert quality.text_shape("| a\n| b\n| c")["delimiter_columns"] == 0.0  # what leads a line is no column


def test_texts_together_as_by_themselves():
    rng = random.Random(9)
    texts = [indented(rng, True), "una linea", lengths(rng, True), indented(rng, False), columns(rng, True), None, " ", "| a | b |\n| c | d |"]
    model = quality.ProseModel()
    assert quality.text_shapes(texts, model) == [quality.text_shape(t, model) for t in texts]
    shares = quality.other_shares(texts, model)
    assert all(a["other_share"] == b or abs(a["other_share"] - b) < 1e-12 for a, b in zip(quality.text_shapes(texts, model), shares, strict=True))
    texts = [t for t in texts if t and t.strip()]
    for (rows, _), t in zip(quality.stretch_features(texts), texts, strict=True):
        assert np.array_equal(rows, quality.stretch_features([t])[0][0])
