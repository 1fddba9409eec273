"""Both ways to join large and small test sets give the same rows."""

from __future__ import annotations

import random

import pytest

from rankloom.llm import leakage

RNG = random.Random(21)
SYLLABLES = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u")]


def some(n):
    return [RNG.choice(SYLLABLES) + RNG.choice(SYLLABLES) + RNG.choice(SYLLABLES) for _ in range(n)]


NOTICE = some(30)
PATTERN = "un pleito de {} folios enfrentó a {} con {} por el uso de la {} y del {}".split()


def patterned():
    return [some(1)[0] if w == "{}" else w for w in PATTERN * 3]


OWN = [some(40) for _ in range(4)]
ITEMS = [(n, " ".join(w + NOTICE)) for n, w in enumerate(OWN)] + [(10, "tres palabras raras"), (11, "Unica"), (12, "tres palabras raras")] + [(20 + n, " ".join(patterned())) for n in range(40)]
FILL = some(60)
DOCS = [
    (1, FILL + NOTICE + FILL),  # a notice that four items share
    (2, FILL + OWN[0] + FILL),
    (3, FILL + "tres palabras raras".split() + FILL),  # shorter than a fingerprint
    (4, FILL + ["unica"]),
    (5, FILL + patterned() + FILL),  # the pattern with other names
    (6, FILL + OWN[1][:30] + NOTICE + FILL),
    (7, "tres palabras".split()),
]
EXPECTED = {(2, 0), (3, 10), (3, 12), (4, 11), (6, 1)}


@pytest.mark.parametrize("most", [leakage.MAX_ITEM_WORDS, 0])
def test_short_items_notices_and_patterns(spark, most):
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in DOCS], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(docs, items, max_item_words=most).collect()} == EXPECTED
