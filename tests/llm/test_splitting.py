from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.splitting import spans, split_texts, within_character


def check(text, limit, overlap, slack=40):
    cuts = spans(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < c and b < d and max(0, overlap - slack) <= b - c <= overlap
    assert all(b - a <= limit for a, b in cuts)
    return cuts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,é́", max_size=900), st.integers(20, 120), st.integers(0, 19))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_are_at_sentence_ends_and_balanced():
    text = " ".join(f"Frase número {i} de este texto largo y llano." for i in range(200))
    cuts = check(text, 2000, 200)
    assert all(text[:b].endswith(". ") for _, b in cuts[:-1])
    assert all(text[a - 1].isspace() for a, _ in cuts[1:])
    lengths = [b - a for a, b in cuts]
    assert min(lengths) > 0.7 * max(lengths)
    assert len(cuts) <= 6


def test_stronger_boundaries_win():
    part = "palabra " * 190
    text = part.strip() + ".\n\n" + part
    cut = check(text, 2000, 200)[0][1]
    assert text[:cut].endswith(".\n\n")


def test_text_without_boundaries_is_cut_hard_but_not_within_a_character():
    check("x" * 20_000, 2000, 200)
    text = "á" * 3000
    assert all(text[b - 1] == "́" for _, b in check(text, 2000, 200)[:-1])


def test_at_the_limit_nothing_is_cut():
    assert spans("x" * 2000) == [(0, 2000)]
    assert len(spans("x" * 2001)) == 2
    assert spans("") == [(0, 0)]


def test_rows(spark):
    random.seed(1)
    long = " ".join(random.choice(["casa", "río", "monte.", "🏛️", "agua,\n"]) for _ in range(3000))
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, long, None), (3, long, None), (4, "corto", "k")], "id int, text string, piece string")
    rows = split_texts(df, "text").collect()
    assert {r["id"] for r in rows} == {2, 3, 4}
    assert [r["piece_text"] for r in rows if r["id"] in (2, 4)] == ["", "corto"]
    own = sorted((r for r in rows if r["id"] == 3), key=lambda r: r["piece"])
    assert len(own) == 2 * own[0]["pieces"]
    assert all(len(r["piece_text"]) <= 2000 and r["piece_text"] == long[r["start"] : r["stop"]] for r in own)
    assert split_texts(df.limit(0), "text").count() == 0


def test_no_piece_begins_or_ends_within_a_character():
    family, flag, tone = "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f1ea\U0001f1f8", "\U0001f44d\U0001f3fd"
    for unit in ("a\u0301\u0323", family, flag, tone, "❤\ufe0f"):
        text = unit * (9000 // len(unit))
        cuts = check(text, 2000, 200)
        assert all(a % len(unit) == 0 and (b % len(unit) == 0) for a, b in cuts)
    assert not within_character(flag * 2, 2) and within_character(flag * 2, 3) and within_character("a\r\n", 2) and not within_character("ab", 1)


def test_tiny_limits_still_cut_at_boundaries():
    cuts = check("ab cd ef gh ij kl", 4, 1)
    assert all(text_end == " " for text_end in ("ab cd ef gh ij kl"[b - 1] for _, b in cuts[:-1]))


def test_long_texts_take_time_in_proportion():
    import time

    rng = random.Random(3)
    text = "".join(rng.choice(["casa ", "río ", "monte. ", "x" * 90, "agua,\n"]) for _ in range(500_000))
    began = time.perf_counter()
    cuts = check(text, 2000, 200)
    taken = time.perf_counter() - began
    began = time.perf_counter()
    check(text[: len(text) // 8], 2000, 200)
    assert taken < 16 * (time.perf_counter() - began) + 0.5
    assert len(cuts) <= 1.1 * (len(text) - 200) / 1800


def test_the_function_runs_once(spark):
    df = spark.createDataFrame([(1, "palabra " * 600)], "id int, text string")
    plan = split_texts(df, "text").where("pieces > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
