"""The deduplicating stream against a plain fold over the same arrivals."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from nightjar.operators import episodes
from nightjar.operators.episodes import Episode, Fold
from nightjar.streaming import stateful

T0 = datetime(2026, 1, 1)
SCHEMA = "fingerprint string, ts timestamp, event_id long, score int"


def plain(rows, window, stored=()):
    """A linear search per alert, as the rule says."""
    out = {f: list(x) for f, x in stored}
    for f, ts, event_id, score in rows:
        mine = out.setdefault(f, [])
        fit = [e for e in mine if e["open"] and e["last"] >= ts - window and e["first"] <= ts + window]
        if fit:
            e = max(fit, key=lambda e: e["last"])
            e |= {"n": e["n"] + 1, "first": min(e["first"], ts), "last": max(e["last"], ts), "score": max(e["score"], score), "z": event_id}
        else:
            mine.append({"episode": max([e["episode"] for e in mine], default=0) + 1, "n": 1, "first": ts, "last": ts, "score": score, "a": event_id, "z": event_id, "open": True})
    return sorted((f, e["episode"], e["n"], e["first"], e["last"], e["score"], e["a"], e["z"]) for f, x in out.items() for e in x)


def arrivals(seed, n=160):
    rng = random.Random(seed)
    return [(rng.choice("fffgh"), T0 + timedelta(minutes=rng.randrange(60 * 24 * 4) if rng.random() < 0.5 else k * 30), k, rng.randrange(100)) for k in range(n)]


def run(spark, tmp_path, batches, stored=None, delay="30 days"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    out = []
    # a file source reads the oldest file first
    for k in range(len(batches)):
        for f in (tmp_path / "in" / f"b{k}").glob("*.parquet"):
            import os

            os.utime(f, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (
        stateful.dedup_stream(stream, hours=6, delay=delay, stored=stored).writeStream.outputMode("update")
        .foreachBatch(lambda df, i: out.append(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = {}
    for batch in out:
        for r in batch:
            last[r["fingerprint"], r["episode"]] = (r["fingerprint"], r["episode"], r["occurrence_count"], r["first_seen"], r["last_seen"], r["score"], r["first_event_id"], r["last_event_id"])
    return last, q


def test_out_of_order_arrivals_over_batches_equal_a_plain_fold(spark, tmp_path):
    rows = arrivals(1)
    got, _ = run(spark, tmp_path, [rows[:40], rows[40:41], rows[41:110], rows[110:]])
    assert sorted(got.values()) == plain(rows, timedelta(hours=6))


def test_stream_goes_on_from_stored_episodes(spark, tmp_path):
    rows = arrivals(2)
    before = episodes.fold_arrivals(spark.createDataFrame(rows[:80], SCHEMA), hours=6)
    before = before.withColumn("state", F.when(F.col("episode") == 1, "resolved").otherwise("new"))
    got, _ = run(spark, tmp_path, [rows[80:120], rows[120:]], stored=before)
    stored = {}
    for f, k, n, a, z, s, i, j in plain(rows[:80], timedelta(hours=6)):
        stored.setdefault(f, []).append({"episode": k, "n": n, "first": a, "last": z, "score": s, "a": i, "z": j, "open": k != 1})
    expected = plain(rows[80:], timedelta(hours=6), stored.items())
    untouched = {x[:2]: x for x in plain(rows[:80], timedelta(hours=6))}
    assert sorted((untouched | got).values()) == expected


def test_state_of_old_episodes_is_dropped(spark, tmp_path):
    rows = [("f", T0 + timedelta(days=k), k, 1) for k in range(6)]
    got, q = run(spark, tmp_path, [[r] for r in rows], delay="1 hour")
    assert [x[2] for x in sorted(got.values())] == [1] * 6  # a day apart: six episodes with six numbers
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state and state[-1] <= state[1] + 6


def test_fold_equals_linear_search():
    for seed in range(30):
        rows, window = arrivals(seed, 120), timedelta(hours=random.Random(seed).choice([1, 6, 24]))
        us = lambda t: (t - T0) // timedelta(microseconds=1)
        for name in "fgh":
            fold = Fold(us(T0 + window))
            mine = [r for r in rows if r[0] == name]
            for _, ts, event_id, score in mine:
                fold.add(us(ts), score, event_id)
            assert sorted((name, e.episode, e.occurrence_count, T0 + timedelta(microseconds=e.first_seen), T0 + timedelta(microseconds=e.last_seen), e.score, e.first_event_id, e.last_event_id) for e in fold.episodes()) == plain(mine, window)
    assert Fold(5, [Episode(3, 1, 0, 0, 1, 1, 1, "resolved")]).add(1, 1, 2).episode == 4
