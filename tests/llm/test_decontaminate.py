import random

from conftest import prose

from nightjar.llm import decontaminate as D
from nightjar.llm.common import with_row_ids


def test_finds_passages_with_substitutions_and_leaves_others(spark, odd_docs):
    rng = random.Random(6)
    items = [(k, prose(rng, n, 5000)) for k, n in enumerate((9, 20, 35, 50))] + [(8, ""), (9, None), (10, "too short here")]
    docs, want = [], set()
    for k in range(60):
        body = prose(rng, 60, 5000).split()
        item, text = rng.choice(items[:4])
        passage = text.split()
        if k % 3 == 1:  # every sixth token replaced
            passage = [f"z{k}{j}" if j % 6 == 5 else w for j, w in enumerate(passage)]
        if k % 3 < 2:
            body[30:30] = passage
            want.add((k, item))
        elif k % 2:  # the same words in another order are no passage
            rng.shuffle(passage)
            body += passage
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "one two")]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string")
    b = spark.createDataFrame(items + items[:1], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in D.leaks(with_row_ids(d), b).collect()]
    assert set(found) == want
    assert len(found) == len(want) + 2  # repeated rows are judged alike
    clean = {r["doc_id"] for r in D.drop_leaks(d, b).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in want}
    assert D.drop_leaks(odd_docs, b).count() == odd_docs.count()


def test_both_join_paths_agree(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 25)) for k in range(5)]
    docs = [(k, prose(rng, 30) + " " + items[k % 5][1]) for k in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pick = lambda: sorted((r["doc_id"], r["item_id"], r["place"]) for r in D.leaks(with_row_ids(d), b).collect())
    small = pick()
    monkeypatch.setattr(D, "SEED_ROWS", 0)
    monkeypatch.setattr(D, "ALIGNMENT_ROWS", 0)
    assert pick() == small == sorted((k, k % 5, 30) for k in range(20))


def test_empty(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert D.drop_leaks(no_docs, some).count() == 0
    assert D.leaks(with_row_ids(some.withColumnRenamed("item_id", "doc_id")), none).count() == 0


def test_masks_cover_all_allowed_substitutions():
    """Also for stretches of a window, by the masks that every text is hashed with."""
    assert D.covers(D.MASKS, D.WINDOW, D.allowed(D.WINDOW))
    for n in range(D.LEAST, D.WINDOW):
        assert D.covers(D.masks_for(n), n, D.allowed(n)), n


def definition(docs, items, window=16, percent=80, least=5):
    """All alignments, compared token by token."""
    import re

    cut = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    out = {}
    for d, text in docs:
        t = cut(text)
        for item, q in {(i, tuple(cut(q))) for i, q in items}:
            w = min(len(q), window)
            if len(q) < least:
                continue
            for shift in range(-len(q), len(t)):
                same = [0 <= shift + j < len(t) and t[shift + j] == x for j, x in enumerate(q)]
                m = max(sum(same[k : k + w]) for k in range(len(q) - w + 1))
                if m * 100 >= w * percent:
                    out[d, item] = max(out.get((d, item), 0), m)
    return out


def test_every_allowed_substitution_of_short_items_is_found(spark):
    rng = random.Random(12)
    items = [(n, prose(rng, n, 5000)) for n in range(3, 21)] + [(5, prose(rng, 9, 5000)), (None, prose(rng, 12, 5000)), (30, "a b a b a b a b a b")]
    docs = []
    for item, text in items:
        q = text.split()
        for _ in range(12):
            lost = set(rng.sample(range(len(q)), min(len(q), D.allowed(min(len(q), 16)) + rng.randrange(2))))
            body = [f"z{k}" if k in lost else x for k, x in enumerate(q)]
            docs.append((len(docs), " ".join(prose(rng, rng.randrange(6), 5000).split() + body + prose(rng, rng.randrange(6), 5000).split())))
    docs += [(len(docs) + k, " ".join(items[9][1].split()[: 12 - k])) for k in range(4)]  # cut off at the end
    docs += [(len(docs), "a b " * 3000), (len(docs) + 1, "A, b; " * 4 + "c " * 20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "n", 1) for x in items], "item_id long, text string, q string, n long")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in D.leaks(with_row_ids(d), b).collect()}
    assert got == definition(docs, items) and len(got) > 100
