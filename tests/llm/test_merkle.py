import random
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from nightjar.llm import merkle
from nightjar.llm.merkle import Local, Mountains, fold, manifest, sha, steps

FIELDS = merkle.FIELDS


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, idx, fanout):
    """(those before, those after) on each level."""
    for level in tree[:-1]:
        run = idx // fanout * fanout
        yield "".join(level[run:idx]), "".join(level[idx + 1 : run + fanout])
        idx //= fanout


def brute(rows, fanout=2):
    """rows: dicts of FIELDS -> sorted output of the manifest with the contract's tampering."""
    def leaf(r):
        return sha("".join("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS))

    by = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    groups = [sorted(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=by), by)]
    trees = [levels([leaf(r) for r in g], fanout) for g in groups]
    top = levels([t[-1][0] for t in trees], fanout) if trees else []
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            path = [*siblings(tree, i, fanout), *siblings(top, k, fanout)]
            digest = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                digest = leaf(r | {"n_chars": r["n_chars"] + 1})
            for a, b in path:
                digest = sha(a + digest + b)
            out.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def run(df, **more):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted((tuple(r) for r in manifest(df, tampered={"n_chars": F.col("n_chars") + 1}, when=tamper, **more).collect()), key=repr)


def made(rng, n, langs):
    rows = [{"doc_id": rng.choice([None, k, k // 2, -k]), "source": rng.choice([None, "web", "é"]), "lang": rng.choice(langs), "n_chars": rng.choice([None, k]), "text": rng.choice([None, "", "ünï", "x" * k])} for k in range(n)]
    return rows + rows[: n // 10]  # exact repeats


@pytest.mark.parametrize(("n", "langs", "more"), [(60, [None, "de", "en", ""], {"part_rows": 7, "peaks": 5}), (90, ["en"], {"part_rows": 16, "fanout": 3, "peaks": 9}), (1, ["en"], {}), (12, [None, "a", "é", "z", "{", "ab"], {"fanout": 5})])
def test_against_brute_force(spark, n, langs, more):
    rows = made(random.Random(n), n, langs)
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, part int, idx long, key string, _row_of_leaf int"
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) + ("g", "leaf", 1, 2, "key", 3) for r in rows], schema).repartition(3)
    assert run(df, **more) == brute(rows, more.get("fanout", 2))


def test_hot_group_and_long_text(spark):
    rows = [{"doc_id": k, "source": "s", "lang": "en" if k % 10 else f"l{k}", "n_chars": 1, "text": "y" * (200_000 if k == 5 else 3)} for k in range(150)]
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert run(df, part_rows=20, peaks=8) == brute(rows)


def test_empty_table(no_docs):
    assert run(no_docs) == []


def test_records_are_every_inner_node(spark):
    rows = [("", k, sha(str(k))) for k in range(77)]
    t = merkle.tree(spark.createDataFrame(rows, "g string, k long, leaf string"), ["k"], fanout=3, part_rows=10, peaks=6)
    full = levels([r[2] for r in rows], 3)
    assert {(r["level"], r["idx"]): r["digest"] for r in t.records().collect()} == {(k, i): d for k, level in enumerate(full) if k for i, d in enumerate(level)}


def test_stack_and_local_proofs_for_any_cut():
    rng = random.Random(1)
    for _ in range(100):
        n, fanout = rng.randrange(1, 120), rng.choice([2, 2, 3, 5])
        full = levels([sha(str(i)) for i in range(n)], fanout)
        cuts = [0, *sorted(rng.randrange(n + 1) for _ in range(rng.randrange(6))), n]
        nodes, waiting = {}, []
        for s, e in zip(cuts, cuts[1:], strict=False):
            stack = Mountains(fanout, False)
            for i in range(s, e):
                stack.add("g", n, 0, i, full[0][i])
            stack.close()
            waiting += [x[2:5] for x in stack.out if x[5] == "peak"]
            nodes |= {x[2:4]: x[4] for x in stack.out}
        assert len(waiting) <= 2 * fanout * len(full) * len(cuts)
        last = Mountains(fanout, True)
        for level, i, d in sorted(waiting, key=lambda x: x[1] * fanout ** x[0]):
            last.add("g", n, level, i, d)
        last.close()
        nodes |= {x[2:4]: x[4] for x in last.out}
        assert all(full[level][i] == d for (level, i), d in nodes.items()) and not [x for x in last.out if x[5] == "peak"]
        for s, e in zip(cuts, cuts[1:], strict=False):
            for i, path in zip(range(s, e), Local(fanout, n, s, full[0][s:e], nodes).paths(()), strict=True) if s < e else ():
                assert list(steps(path)) == list(siblings(full, i, fanout)) and fold(full[0][i], path) == full[-1][0]


def test_query_and_sql(spark):
    got = sorted(tuple(r) for r in merkle.op12_manifest(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == sorted(con.sql(merkle.ORACLE["op12_manifest"]).fetchall())
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*FIELDS).collect()]
    assert sorted(got, key=repr) == brute(rows)
