import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import language as L

SOUNDS = {"aa": ["the", "th", "ing", "er"], "bb": ["sch", "ung", "ich", "ß"], "cc": ["eau", "que", "é", "oi"]}


def word(rng, lang):
    return "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for k in range(300):
        lang = rng.choice(list(SOUNDS))
        out.append((k, " ".join(word(rng, lang) for _ in range(rng.randrange(3, 120))), lang))
    return out


@pytest.fixture(scope="module")
def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return L.fit(L.training_rows(labelled))


def brute_posteriors(e, start, trans):
    n, k = e.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        score = start[path[0]] + e[0, path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:])) + sum(e[t, path[t]] for t in range(1, n))
        for t in range(n):
            total[t, path[t]] += np.exp(score)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 100])
def test_forward_backward_is_exact(block):
    rng = np.random.default_rng(4)
    lengths = [0, 1, 7, 3, 2, 0, 5]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    e, start, trans = rng.normal(size=(starts[-1], 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got = L.posteriors(e, starts, start, trans, block)
    for a, b in zip(starts, starts[1:]):
        if b > a:
            assert np.allclose(got[a:b], brute_posteriors(e[a:b], start, trans))


def test_held_out_rule(labelled, rows):
    got = {r[0]: r[1] for r in labelled.select("doc_id", L.held_out(F.col("doc_id"))).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows}


def test_held_out_accuracy(labelled, model, rows):
    got = {r["doc_id"]: r for r in L.predict(labelled, model).collect()}
    out = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    truth = {k: lang for k, _, lang in rows}
    assert sum(got[k]["lang_pred"] == truth[k] for k in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_code_switched_words(spark, model):
    rng = random.Random(9)
    text = " ".join([word(rng, "aa") for _ in range(20)] + [word(rng, "bb") for _ in range(20)])
    (r,) = L.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_labels=True).collect()
    want = ["aa"] * 20 + ["bb"] * 20
    assert len(r["labels"]) == 40 and sum(a == b for a, b in zip(r["labels"], want)) >= 36


def test_odd_rows(odd_docs, odd_rows, model, no_docs, labelled):
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) + 3
    texts = dict(odd_rows)
    for r in rows:
        if r["doc_id"] is not None and not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert L.training_rows(odd_docs) == [] and L.fit([]) is None
    assert {r["lang_pred"] for r in L.predict(odd_docs, None).collect()} == {"und"}
    assert L.predict(no_docs, model).count() == 0
    kept = L.drop_rejected(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("trim(coalesce(text, '')) = ''").count() == 0
    assert L.drop_rejected(labelled, model).count() >= 0.99 * labelled.count()


def test_without_letters(spark, model):
    df = spark.createDataFrame([(1, "12 34 !!"), (2, "– … €"), (3, "a1"), (4, "ß")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(df, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"
