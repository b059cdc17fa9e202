import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import hard_negatives as hn
from nightjar.llm.hard_negatives import Mining, mine

SCHEMA = "vec_id long, embedding array<double>, label int, row long, q string, norm2 string, bucket int, block int, grp int, rank int, lows int"


def brute(rows, mining, every):
    taken = [
        (i, place, label, [math.floor(mining.scale * x) for x in v])
        for place, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, place, label, q in taken:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j, p, m) for j, p, m, w in taken if p != place)  # noqa: B905
        for s, j, _, _ in [x for x in scored if x[3] == label][: mining.positives]:
            fit = [x for x in scored if x[3] != label and mining.low * -s <= 100 * -x[0] <= mining.high * -s][: mining.negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "q", "n", 2, 3, 4, 5, 6) for i, v, label in rows], SCHEMA).coalesce(1)


def made(seed, n, spread, width=6):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = 10 ** rng.uniform(-spread, spread)
        rows.append((k, [rng.gauss(0.3, 1) * size for _ in range(width)], rng.randrange(4)))
    hot = [0.5] * width
    for k in range(n // 3):  # a third of the rows is one vector
        rows.append((n + k, hot, k % 5))
    rows += rows[:7]  # repeated rows
    rows += [(None, hot, 1), (9001, None, 1), (9002, hot, None), (9003, [1.0, None], 1), (9004, [float("nan")], 2), (9005, [float("inf"), 1.0], 2), (9010, [], 1), (9020, [1.0, 2.0], 3), (9030, [-1.0] * width, 77)]
    return rows


@pytest.mark.parametrize(("seed", "n", "spread", "bytes_"), [(1, 120, 0.0, 1 << 21), (2, 150, 1.0, 700), (3, 150, 2.5, 1500)])
def test_against_brute_force(spark, monkeypatch, seed, n, spread, bytes_):
    monkeypatch.setattr(hn, "BUCKET_BYTES", bytes_)
    monkeypatch.setattr(hn, "BLOCK_BYTES", max(400, bytes_ // 3))
    monkeypatch.setattr(hn, "TIERS", 5)
    rows, mining = made(seed, n, spread), Mining(positives=3, negatives=4)
    assert sorted(tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 10 == 0, mining=mining).collect()) == brute(rows, mining, 10)


def test_every_cell_meets_its_rows_in_any_number_of_tasks(spark, monkeypatch):
    """Vectors of one norm, so that no cell is ruled out, with the cells dealt to many tasks."""
    monkeypatch.setattr(hn, "BUCKET_BYTES", 400)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 200)
    rng = random.Random(11)
    rows = []
    for k in range(150):
        v = [rng.gauss(0.3, 1) for _ in range(6)]
        size = math.sqrt(sum(x * x for x in v))
        rows.append((k, [x / size for x in v], k % 4))
    mining = Mining(positives=3, negatives=4)
    adaptive, partitions = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 10 == 0, mining=mining).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == brute(rows, mining, 10)


def test_bounds_leave_cells_out(spark, monkeypatch):
    """With norms that differ, most cells beyond the first are never shuffled, and the result is whole."""
    asked, materialize = [], hn.materialize

    def counting(df, name):
        out = materialize(df, name)
        if name == "cells":
            asked.append(out.count())
        return out

    monkeypatch.setattr(hn, "materialize", counting)
    monkeypatch.setattr(hn, "BUCKET_BYTES", 500)
    rng = random.Random(5)
    rows = [(k, [abs(rng.gauss(1, 0.2)) * (0.98**k if k % 10 else 1) for _ in range(4)], k % 3) for k in range(400)]
    mining = Mining(positives=3, negatives=4)
    got = sorted(tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 10 == 0, mining=mining).collect())
    assert got == brute(rows, mining, 10)
    assert len(asked) == 4 and asked[0] == 1 and asked[1] + asked[3] <= 4  # of 12 cells each


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(2**27, 2**28)) for _ in range(5)], k % 2) for k in range(60)]
    mining = Mining(positives=2, negatives=3, scale=1)
    assert sorted(tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 10 == 0, mining=mining).collect()) == brute(rows, mining, 10)


def test_empty_table_and_no_anchor(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert mine(frame(spark, made(1, 10, 0)), F.lit(False)).collect() == []


def test_best_prefers_earlier_places():
    assert sorted(hn.best(np.array([1, 5, 5, 3, 5, 9]), 3).tolist()) == [1, 2, 5]
    assert sorted(hn.best(np.array([1, 1]), 3).tolist()) == [0, 1]


def test_query_and_sql(spark):
    got = sorted(tuple(r) for r in hn.op13_hard_negatives(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert got == sorted(con.sql(hn.ORACLE["op13_hard_negatives"]).fetchall()) and got
