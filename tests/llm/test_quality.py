from __future__ import annotations

import random

from rankloom.llm import quality

random.seed(7)
PROSE = [
    "La casa que compró mi abuelo está junto al río, y cuando llueve el agua llega hasta la puerta. ",
    "En el pueblo se dice que el molino fue de un conde que lo perdió todo en una noche de juego. ",
    "Aunque nadie lo sabe con certeza, parece que la iglesia es más antigua que las murallas. ",
    "The bridge was built by the people who lived on the other side, and it has been there for years. ",
]
NAMES = ["Torla", "Zamira", "Beltor", "Quina", "Darlo", "Melva", "Ruste", "Valdor"]


def prose(i):
    rng = random.Random(i)
    return "".join(rng.sample(PROSE, 4)) + f"Eso pasó en {1500 + i} y no se ha vuelto a ver desde entonces."


def listing(i):
    return "\n".join(f"- {random.choice(NAMES)} ({1400 + i + n})" for n in range(20))


def grid(i):
    return "\n".join(f"| {random.choice(NAMES)} | {random.randrange(9999)} | {random.randrange(99)},{i % 10} | — |" for _ in range(15))


def junk(i):
    return [" ".join(f"{random.getrandbits(60):015x}" for _ in range(30)), PROSE[0] * 30, "".join(random.choice("qwrtpsdfgjklñ ") for _ in range(400)), "*" * 300][i % 4]


def tables(spark):
    kinds = {"prose": prose, "list": listing, "table": grid, "junk": junk}
    rows = [(f"{k}{i}", f(i)) for k, f in kinds.items() for i in range(40)]
    labels = [(f"{k}{i}", k if i else "prose") for k in kinds for i in range(0, 40, 2)] + [("prose1", None), (None, "list")]
    return spark.createDataFrame(rows, "docid string, text string"), spark.createDataFrame(labels, "docid string, label string")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    found = {r["docid"] for r in quality.not_prose(docs, labels).collect()}
    held = [f"{k}{i}" for k in ("prose", "list", "table", "junk") for i in range(1, 40, 2)]
    right = sum((d in found) == (not d.startswith("prose")) for d in held)
    assert right / len(held) >= 0.95


def test_dirt(spark):
    docs, labels = tables(spark)
    more = spark.createDataFrame([("n", None), ("e", ""), ("b", " \n "), (None, listing(1)), ("two", prose(3)), ("two", listing(3)), ("list3", listing(3))], "docid string, text string")
    found = [r["docid"] for r in quality.not_prose(docs.union(more), labels).collect()]
    assert len(found) == len(set(found)) and "two" in found and not {"n", "e", "b", None} & set(found)
    assert quality.not_prose(docs.limit(0), labels).count() == 0
    plain = {r["docid"] for r in quality.not_prose(docs, labels.limit(0)).collect()}
    assert {"list1", "table1"} <= plain and "prose1" not in plain


def test_statistics(spark):
    texts = [None, "", "  ", "uno dos tres.", listing(0), grid(0), PROSE[0] * 20, "palabra " * 30_000]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "id int, text string, claimed int, words string")
    rows = {r["id"]: r for r in quality.text_statistics(df, "text", claimed="claimed").collect()}
    assert [rows[i]["words"] for i in range(4)] == [0, 0, 0, 3] and rows[7]["words"] == 30_000
    assert [rows[i]["words_claimed_right"] for i in (0, 3)] == [False, True]
    assert rows[4]["bullet_line_share"] == 1.0 and rows[4]["ended_line_share"] == 0.0
    assert rows[5]["delimiter_alignment"] == 1.0
    assert rows[6]["repeated_share"] > 0.9 and rows[6]["common_word_share"] > 0.4
    assert rows[3]["ended_line_share"] == 1.0 and rows[0]["lines"] == 0


def test_indentation_and_line_lengths():
    text = "\n".join(("clave" if n % 3 == 0 else "    valor") + " " * (n % 3) + "x" * (n % 3) for n in range(30))
    shape = quality.text_shape(text)
    assert shape["indent_period"] > 0.8
    assert quality.text_shape("uno\ndos\ntres")["indent_period"] == 0.0
