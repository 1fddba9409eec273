from __future__ import annotations

import random

import numpy as np

from rankloom.llm import leakage
from rankloom.llm.words import gram_hashes, word_hashes, words

random.seed(5)
SYLLABLES = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u")]


def word():
    return "".join(random.choice(SYLLABLES) for _ in range(3))


ITEM = [word() for _ in range(60)]
OTHER = [word() for _ in range(60)]
QUESTION = [word() for _ in range(12)]
FILL = [word() for _ in range(200)]


def doc(*parts):
    return " ".join(" ".join(p) for p in (FILL[:50], *parts, FILL[50:90]))


def changed(tokens, every, how):
    out = []
    for i, w in enumerate(tokens):
        if i % every == every - 1:
            out += {"swap": [word()], "drop": [], "add": [w, word()]}[how]
        else:
            out.append(w)
    return out


CASES = {
    1: (doc(ITEM), {1, 2}),
    2: (doc(ITEM[10:36]), {1, 2}),
    3: (doc(ITEM[10:30]), set()),
    4: (doc(changed(ITEM, 7, "swap")), {1, 2}),
    5: (doc(changed(ITEM, 6, "drop")), {1, 2}),
    6: (doc(changed(ITEM, 8, "add")), {1, 2}),
    7: (doc(QUESTION), {4}),
    8: (doc(QUESTION[:8]), set()),
    9: ("<b>" + doc([w.upper() for w in ITEM]).replace(" ", ",\n") + "</b>", {1, 2}),
    10: (doc(ITEM[:14], FILL[100:130], ITEM[14:30]), {1, 2}),
    11: (doc(OTHER), {3}),
    12: (None, set()),
    13: ("", set()),
    14: ("¡…!", set()),
}
ITEMS = [(1, " ".join(ITEM)), (2, " ".join(ITEM)), (3, " ".join(OTHER)), (4, "¿" + " ".join(QUESTION) + "?"), (5, None), (6, ""), (None, " ".join(ITEM))]


def tables(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in CASES.items()] + [(1, CASES[1][0], "y"), (None, CASES[1][0], "y")], "doc_id long, text string, item_id string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


EXPECTED = {(k, i) for k, (_, found) in CASES.items() for i in found}


def test_cases_joined_in_tasks(spark):
    docs, items = tables(spark)
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == EXPECTED


def test_cases_joined_by_shuffle(spark):
    docs, items = tables(spark)
    assert {tuple(r) for r in leakage.leaked_items(docs, items, max_item_words=0).collect()} == EXPECTED


def test_empty(spark):
    docs, items = tables(spark)
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(6)
    for _ in range(200):
        shared = [word() for _ in range(leakage.K + leakage.WINDOW - 1)]
        a = [rng.choice(FILL) for _ in range(rng.randrange(30))] + shared + [rng.choice(FILL) for _ in range(rng.randrange(30))]
        b = [word() for _ in range(rng.randrange(30))] + shared + [word() for _ in range(5)]
        kept = [set(g[leakage.winnow(g)].tolist()) for g in (gram_hashes(word_hashes(t), leakage.K) for t in (a, b))]
        assert kept[0] & kept[1]
    assert leakage.winnow(np.empty(0, np.uint64)).size == 0


def test_pattern_with_other_names_is_no_copy(spark):
    pattern = "un pleito de {} folios enfrentó a {} con {} por el uso de la {} y del {}".split()
    make = lambda: [word() if w == "{}" else w for w in pattern]
    items = spark.createDataFrame([(i, " ".join(make() + make() + make())) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(make() + make() + make()))], "doc_id long, text string")
    assert leakage.leaked_items(docs, items).count() == 0


def test_words_of_changed_forms():
    assert words("Cаsа") == ["casa"]  # Cyrillic а
    assert words("cálido CÁLIDO c​alido cÃ¡lido <i>cálido</i> c&aacute;lido cáli-\ndo") == ["calido"] * 7
    assert words(None) == words("") == words("  ") == []
