from __future__ import annotations

import random

from rankloom.llm.packing import OpenBins, pack_items


def test_best_fit_and_closing():
    bins = OpenBins(10, 2)
    assert [bins.place(6), bins.place(7), bins.place(3), bins.place(4)] == [0, 1, 1, 0]
    assert [bins.place(5), bins.place(8), bins.place(9)] == [2, 3, 4]  # the fullest, 3, closed
    assert bins.still_open() == {2: 5, 4: 1}
    assert bins.place(0) == 4


def packed(spark, items, capacity=512, **options):
    df = spark.createDataFrame(items, "id string, words int, container string")
    return pack_items(df, "id", "words", capacity, **options).collect()


def test_whole_items_within_capacity(spark):
    random.seed(2)
    items = [(f"d{i}", random.choice([5, 40, 90, 200, 400, 511, 512, 513, 1300]), "x") for i in range(3000)]
    rows = packed(spark, items)
    total: dict[int, int] = {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["words"]
    assert max(total.values()) <= 512
    by_id: dict[str, list] = {}
    for r in rows:
        by_id.setdefault(r["id"], []).append(r)
    assert len(by_id) == 3000
    for name, words, _ in items:
        own = by_id[name]
        assert sum(r["words"] for r in own) == words
        assert len(own) == max(1, -(-words // 512)) == own[0]["pieces"]
    assert sum(total.values()) / (512 * len(total)) > 0.93


def test_dirt(spark):
    rows = packed(spark, [("a", 10, "x"), ("a", 30, "x"), ("a", 30, "x"), (None, 5, "x"), ("b", None, "x"), ("c", -4, "x"), ("d", 0, "x")])
    assert {(r["id"], r["words"]) for r in rows} == {("a", 30), ("b", 0), ("c", 0), ("d", 0)}
    assert packed(spark, []) == []


def test_same_on_every_run_and_few_tails(spark):
    items = [(f"d{i}", 1 + i % 300, "x") for i in range(2000)]
    assert sorted(packed(spark, items)) == sorted(packed(spark, items[::-1]))
    few = packed(spark, [(f"d{i}", 10, "x") for i in range(40)], tasks=16)
    assert len({r["container"] for r in few}) == 1


def test_a_tree_of_tasks(spark):
    rng = random.Random(4)
    sizes = {f"d{i}": rng.choice([rng.randrange(1, 120), 700]) for i in range(4000)}
    rows = packed(spark, [(k, n, "x") for k, n in sizes.items()], tasks=300, open_bins=4)
    total: dict[int, int] = {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["words"]
    assert sum(total.values()) == sum(sizes.values()) and max(total.values()) <= 512
    assert sum(total.values()) / (512 * len(total)) > 0.93
