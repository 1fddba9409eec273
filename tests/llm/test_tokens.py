from __future__ import annotations

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import tokens


@pytest.fixture(scope="module")
def codec():
    return tokens.codec(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_hard_texts(codec, reference):
    texts = ["a" * 5000, " " * 3000, "<|endoftext|>", "0" * 777, "ab" * 1000, "\n" * 301 + "a", "ñ" * 999, "日本語テキスト" * 50, "👩‍👩‍👧" * 40, "don't  we'll\t\r\n x", "é​﻿", "\x00\x01"]
    for text in texts:
        assert codec.encode(text) == reference(text)
        assert codec.decode(codec.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(codec, reference, text):
    assert codec.encode(text) == reference(text)
    assert codec.decode(codec.encode(text)) == text


def test_all_documents(codec, reference, data):
    for text in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist():
        assert codec.encode(text) == (reference(text) if text else [])


def test_small_caches_change_nothing(codec):
    small = tokens.Transducer(codec.transducer.ranks, max_states=50)
    for word in ("internationalisation", "xyzzyqwv" * 9, "aaaaaaaaaaaaaaaaaaaaab"):
        assert small.encode_word(word.encode()) == codec.transducer.merge(word.encode())


def test_utf8_stream_is_incremental():
    data = "aé漢😀".encode() + b"\xff\xc3(\xe2\x82"
    for size in (1, 2, 3, 100):
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        assert "".join(tokens.utf8_stream(chunks)) == data.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hola", "x"), (3, "hola", "x")], "id int, text string, ids string")
    rows = tokens.encode_texts(df, "text").orderBy("id").collect()
    assert [r["ids"] for r in rows[:2]] == [[], []] and rows[2]["ids"] == rows[3]["ids"] and len(rows) == 4
    back = tokens.decode_ids(tokens.encode_texts(df, "text"), "ids").orderBy("id").collect()
    assert [r["text"] for r in back] == ["", "", "hola", "hola"]
    assert tokens.encode_texts(df.limit(0), "text").count() == 0


def test_states_are_bounded_within_a_word():
    rng = random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)).encode()
    ranks = tokens.load_ranks(tokens.vocabulary_path())
    small, whole = tokens.Transducer(ranks, max_states=500), tokens.Transducer(ranks)
    assert small.encode_word(word) == whole.encode_word(word)
    assert len(small.states) <= 502
