import hashlib
import re
from collections import Counter, defaultdict

import pytest

from nightjar.llm import exact_dedup
from nightjar.llm.common import with_row_ids


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


@pytest.mark.parametrize("block", [exact_dedup.BLOCK, 7])
def test_groups_match_brute_force(docs, odd_rows, block):
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[normal(t)].append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}
    rows = exact_dedup.groups(with_row_ids(docs), block).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)


def test_blocks_of_equal_prefix_and_length_stay_apart(spark):
    a, b = "x" * 5000 + "a" + "y" * 5000, "x" * 5000 + "b" + "y" * 5000
    rows = exact_dedup.groups(with_row_ids(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in rows} == {1: 1, 2: 2, 3: 1}


def test_repeated_rows_and_null_ids(odd_docs, odd_rows):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert Counter(normal(r["text"]) for r in rows) == Counter({normal(t) for _, t in odd_rows})
    assert all(r["doc_id"] is not None and r["_row"] == "r" for r in rows)


def test_empty(no_docs):
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert exact_dedup.groups(with_row_ids(no_docs.drop("_row"))).count() == 0
