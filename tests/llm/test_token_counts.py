import random

import public_tokenizers as tokenizers
import pytest
from tokenizers import Tokenizer

from nightjar.llm import token_counts as tc

PATH = tokenizers.path("word_bpe_49k.json")


def brute(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


_ONE = tc.load(PATH)


def brute_with(text):
    return len(_ONE.encode(text, add_special_tokens=False).ids)


def counted(df, **more):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in tc.count(df.select("doc_id", "text", "ids"), PATH, **more).collect())


def test_odd_rows(odd_docs, odd_rows):
    expected = [(d, t) for d, t in odd_rows + [odd_rows[0], odd_rows[5], (None, odd_rows[7][1])]]
    assert counted(odd_docs) == sorted((-1 if d is None else d, len((t or "").encode()), brute(t)) for d, t in expected)


def test_marks_special_strings_and_strange_spaces(spark):
    texts = [
        "It's <|endoftext|>HERE<|startoftext|> <|ENDOFTEXT|> we'll", "é ́x Å Å ΑΣ Σ ς İI", "a\x1cb\x1dc \x1e\x1f d\x85e\xa0f g　h i",
        "1234 5,6.7 ½ ٣٤ 三四 ไทย 한국어 \U0001f600‍\U0001f680", "\x00 ﻿​", "z" * 3000 + " " + "z" * 3000, "ab1," * 5000, "<|endoftext|>" * 50,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'i' AS ids")
    assert counted(df) == [(k, len(t.encode()), brute(t)) for k, t in enumerate(texts)]


def test_small_tables_and_caches_change_nothing(docs, monkeypatch):
    expected = counted(docs)
    assert counted(docs, entries=3) == expected
    lengths = tc.Lengths(tc.load(PATH), ["ho"], [1])
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 2)
    monkeypatch.setattr(tc, "PART_CHARS", 7)
    text = "one two three hamburgers ho ho unbelievably four five\nsix " * 5
    assert lengths.of(text) == brute(text) and len(lengths.cache) <= 2


def test_parts_are_those_of_the_library():
    rng = random.Random(2)
    lengths = tc.Lengths(tc.load(PATH), [], [])
    assert lengths.plain
    for _ in range(6000):
        token = "".join(rng.choice("abcXYZ019.,-<|>'_\x1c\x00endoftextéÀßñÇöÖÿ÷×µªº\u0301İſ") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "<|endoftext|>", "'ll", "é"])
        assert lengths[token] == brute_with(token), token


def test_frequent_holds_every_heavy_word(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(10**6)}"]) for _ in range(50)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(70)
    assert {"the", "of"} <= set(tc.frequent(df, entries=8)[:8])  # 70 summaries of 8 counters: merged in two rounds
    assert len(tc.frequent(df, entries=8)) <= 8


def test_empty_table(no_docs):
    assert tc.count(no_docs, PATH).collect() == []
    assert tc.count(no_docs, PATH).columns == ["doc_id", "lang", "source", "n_chars", "_row", "ids", "name", "found", "n_bytes", "n_tokens"]


def test_tokenizer_that_minds_white_space_is_refused(docs):
    with pytest.raises(ValueError, match="white space"):
        tc.count(docs, tokenizers.path("byte_bpe_50k.json"))


def test_query_on_a_whole_table(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n := brute(r["text"]), n > 2048) for r in rows}
