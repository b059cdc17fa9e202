import random

import pytest
from conftest import lower_ascii, prose, words

from nightjar.llm import near_dedup
from nightjar.llm.common import with_row_ids
from nightjar.llm.graph import components


def sets_of(rows, width):
    out = {}
    for d, t in rows:
        w = words(lower_ascii(t))
        out[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute(rows, width, percent=80):
    sets, up = sets_of(rows, width), {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(docs, odd_rows, width):
    rows = near_dedup.near_groups(with_row_ids(docs), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(odd_rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def cluster(rng, n):
    base = prose(rng, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("region", [2048, 6])
def test_dense_groups_around_the_threshold(spark, monkeypatch, region):
    """Groups in which many pairs lie just below the threshold, also with regions above the limits."""
    rng = random.Random(11)
    rows = list(enumerate(t for n in (60, 25, 8) for t in cluster(rng, n)))
    want = {d: c for d, (_, c) in brute(rows, 4).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", max(2, region // 2))
    got = near_dedup.near_groups(with_row_ids(df), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_links_by_matrix_product():
    rng = random.Random(7)
    texts = cluster(rng, 40) + cluster(rng, 10)
    import numpy as np
    import pyarrow as pa

    from nightjar.llm.textnp import slices, words_of

    (s,) = slices(pa.array(texts))
    names, starts = near_dedup.shingle_sets(words_of(s, lower=True), 4)
    label = near_dedup.linked_labels(np.split(names, starts[1:-1]), 80)
    assert [int(x) for x in label] == [c for _, c in brute(list(enumerate(texts)), 4).values()]


def test_large_regions_are_searched_by_leaders():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 16, 64)
    sig = np.where(rng.random((3000, 64)) < 0.05, rng.integers(0, 16, (3000, 64)), base).astype(np.uint32)
    search = near_dedup._Search(near_dedup.least_agreement(80))
    search.large(1, np.arange(3000), near_dedup.packed(sig))
    linked = {b for a, b, _, _ in search.out if a != b} | {a for a, b, _, _ in search.out if a != b}
    assert len(linked) == 3000


def test_repeated_rows_nulls_and_columns(odd_docs, odd_rows, no_docs):
    kept = near_dedup.drop_near(odd_docs, 4)
    assert kept.columns == odd_docs.columns
    want = {d for d, (_, c) in brute(odd_rows, 4).items() if d == c}
    texts = dict(odd_rows)
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and words(texts[r["doc_id"]])]
    assert sorted(ids) == sorted(d for d in want if words(texts[d]))
    assert near_dedup.drop_near(no_docs).count() == 0


def test_components_in_many_tasks(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(280)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {x: find(x) for x in range(400) if find(x) != x}
    for task_edges in (1000, 50):
        assert dict(components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()) == want


def found_groups(spark, monkeypatch, rows, candidates):
    """The links that come from the candidates of some entries (region, deep, id, sketch)."""
    import pyarrow as pa

    own = spark.createDataFrame(rows, "_row long, text string")
    out = [x for part in candidates for b in near_dedup._candidates(80)(iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["region", "deep", "id", "sketch"])])) for x in b.to_pylist()]
    found = spark.createDataFrame([(x["a"], x["b"], x["region"], x["spare"]) for x in out], near_dedup._EDGES)
    return {frozenset((r["a"], r["b"])) for r in near_dedup._all_links(found, own, 4, 80).collect()}


def entries(texts):
    """The sketch of each text."""
    import numpy as np
    import pyarrow as pa

    from nightjar.llm.textnp import slices, words_of

    (s,) = slices(pa.array(texts))
    names, starts = near_dedup.shingle_sets(words_of(s, lower=True), 4)
    return [np.asarray(x).tobytes() for x in near_dedup.packed(near_dedup.signatures(names, starts)[:, :64])]


def test_entries_alone_in_their_run_of_a_large_region(spark, monkeypatch):
    """Linked entries of a region above the limit of which no two agree in the further values."""
    rng = random.Random(3)
    texts = [prose(rng, 120) for _ in range(8)]
    texts[7] = texts[2] + " end"
    monkeypatch.setattr(near_dedup, "REGION", 6)
    part = [(1, k, k, sk) for k, sk in enumerate(entries(texts))]
    assert found_groups(spark, monkeypatch, list(enumerate(texts)), [part]) == {frozenset((2, 7))}


def test_regions_cut_by_a_partition_border(spark, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 120) for _ in range(6)]
    texts[5] = texts[1] + " end"
    part = [(1, k, k, sk) for k, sk in enumerate(entries(texts))]
    assert found_groups(spark, monkeypatch, list(enumerate(texts)), [part[:3], part[3:]]) == {frozenset((1, 5))}


def test_members_of_different_leaders_are_compared(spark, monkeypatch):
    """All candidates to the leaders hold, and one link joins members of two leaders."""
    rng = random.Random(5)
    w = prose(rng, 120).split()
    texts = [" ".join(w[:103] + [f"{p}{k}" for k in range(n)]) for p, n in (("x", 17), ("z", 0), ("y", 17))]
    texts += [prose(rng, 120) for _ in range(5)]
    lone = [(k * 37 % 256).to_bytes(1, "big") * 32 for k in range(8)]
    lone[1] = lone[0]  # the second text agrees with the first leader only, and with no other
    monkeypatch.setattr(near_dedup, "REGION", 4)
    part = [(1, 9, k, sk) for k, sk in enumerate(lone)]
    assert {frozenset((0, 1)), frozenset((1, 2))} <= found_groups(spark, monkeypatch, list(enumerate(texts)), [part])


def test_texts_of_mirrored_words_are_not_linked(spark):
    from test_substring_dedup import mirrored

    a, b = mirrored()
    rows = list(enumerate([a, b, a.upper(), " ".join(a), " ".join(b), f"x y z {a} u v w", f"x y z {b} u v w", "short", "short two", "short two three", "SHORT two"]))
    got = near_dedup.near_groups(with_row_ids(spark.createDataFrame(rows, "doc_id long, text string")), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_runs_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    region = sorted(rng.choice([1, 1, 1, 2, 3, 4, 5, 6]) for _ in range(200))
    rows = [(r, k, bytes([k % 256] * 2)) for k, r in enumerate(region)]
    for size in (1, 3, 50, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[x : x + size]), (pa.int64(), pa.int64(), pa.binary()))], ["region", "id", "m"]) for x in range(0, 200, size)]
        got = [(int(c[0][x]), c[1][x:y].tolist()) for c, begin, end in near_dedup._runs(iter(parts), 2) for x, y in zip(begin, end)]
        assert got == [(r, [k for k in range(200) if region[k] == r]) for r in sorted(set(region))]
        assert all(np.array_equal(c[2][:, 0], c[1] % 256) for c, _, _ in near_dedup._runs(iter(parts), 2))
