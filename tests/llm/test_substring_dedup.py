import hashlib

import numpy as np
import pytest
from conftest import words

from nightjar.llm import substring_dedup as S
from nightjar.llm.common import with_row_ids
from nightjar.llm.textnp import slices, words_of


def brute(rows, width):
    """rows sorted by id, equal ids together."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if first.setdefault(k, d) < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("width", [50, 8])
def test_matches_brute_force(docs, odd_rows, width):
    rows = S.remove_repeats(with_row_ids(docs.select("doc_id", "text")), width).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}
    assert got == brute([(d, t or "") for d, t in odd_rows], width)


def test_repeated_rows_and_null_ids(odd_docs, odd_rows, no_docs):
    rows = S.remove_repeats(with_row_ids(odd_docs.select("doc_id", "text", "found"))).collect()
    assert len(rows) == len(odd_rows) + 3
    want = brute([(d, t or "") for d, t in odd_rows], 50)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"]) == want[r["doc_id"]][:2]
        else:  # a null id comes after all others, and its text has a copy
            assert r["n_removed"] == (r["n_words"] if r["n_words"] >= 50 else 0)
    assert S.remove_repeats(with_row_ids(no_docs.select("doc_id", "text"))).count() == 0


def test_equal_substrings_get_equal_symbols():
    """A symbol whose reach lies inside a passage is found wherever the passage stands."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    passage = [f"p{rng.randrange(60)}" for _ in range(90)]
    texts = [" ".join([f"l{rng.randrange(99)}" for _ in range(n)] + passage + [f"r{rng.randrange(99)}" for _ in range(n + 3)]) for n in (0, 1, 17, 40)]
    (s,) = slices(pa.array(texts))
    w = words_of(s)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.doc_start))
    sym, begin, low, high = S.recompress(w.name, doc)
    seen = []
    for k, n in enumerate((0, 1, 17, 40)):
        at = w.doc_start[k] + n
        inside = (low >= at) & (high <= at + len(passage))
        seen.append({(int(x), int(b - at)) for x, b in zip(sym[inside], begin[inside])})
    assert seen[0] and all(x == seen[0] for x in seen)


def test_query_digest(spark, odd_rows, tmp_path):
    spark.createDataFrame(odd_rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept_sha256"] for r in S.op9_substring_dedup(spark, str(tmp_path)).collect()}
    want = brute([(d, t or "") for d, t in odd_rows], 50)
    assert got == {d: hashlib.sha256(k.encode()).hexdigest() for d, (_, _, k) in want.items()}


def test_a_symbol_of_more_windows_than_a_row_can_count(spark):
    """The copy of a text of 300 000 words that repeats one phrase goes as a whole."""
    text = "a b c d e f " * 50_000
    rows = S.remove_repeats(with_row_ids(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows} == {1: (300_000, 0), 2: (300_000, 300_000)}


def mirrored(n=1024):
    """The Thue-Morse word of n letters and its complement."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_texts_that_differ_in_mirrored_words_share_nothing(spark):
    a, b = mirrored()
    rest = [f"w{k}" for k in range(60)]
    texts = [" ".join(rest[:30] + [x] + rest[30:]) for x in (a, b)]
    letters = [" ".join(x * 2) for x in (a, b)]  # windows of the same patterns, letter by letter
    rows = list(enumerate(texts + letters))
    got = S.remove_repeats(with_row_ids(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute(rows, 50)


def test_a_long_periodic_text_beside_others(spark):
    """Over 300 000 words of one phrase, its shifted copy, and passages of it in other texts."""
    phrase = "a b"
    rows = [(1, f"{phrase} " * 160_000), (2, f"{phrase} " * 160_000 + "end"), (3, "x " + f"{phrase} " * 40 + "y"), (4, f"{phrase} " * 20)]
    got = S.remove_repeats(with_row_ids(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute(rows, 50)
