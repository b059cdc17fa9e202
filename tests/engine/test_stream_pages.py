"""State of the deduplicating stream in pages: as many calls as pages, and the results of a plain fold."""

import random
from datetime import datetime, timedelta
from functools import partial

import pandas as pd
from pyspark.sql import functions as F
from test_stream_state import SCHEMA, T0, plain, run

from nightjar.streaming import stateful
from nightjar.streaming.ingest import fold_available


class Kept:
    """State of one key that counts its calls."""

    def __init__(self):
        self.maps, self.values, self.timers, self.calls = {}, {}, set(), 0

    def _state(self, rows):
        kept = self

        class State:
            def called(self, key=None):
                kept.calls += 1
                return key

            def exists(self):
                return bool(self.called(rows))

            def getValue(self, key):
                return rows.get(self.called(key))

            def updateValue(self, key, value):
                rows[self.called(key)] = value

            def removeKey(self, key):
                rows.pop(self.called(key), None)

            def get(self):
                return rows.get(self.called(()))

            def update(self, value):
                rows[self.called(())] = value

        return State()

    def getMapState(self, name, *_):
        return self._state(self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return self._state(self.values.setdefault(name, {}))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_the_state_are_few_for_many_fingerprints():
    rng, us = random.Random(5), lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    rows = [(rng.choice(["hot", f"f{rng.randrange(3000)}"]), T0 + timedelta(minutes=rng.randrange(60 * 24)), k, rng.randrange(100)) for k in range(6000)]
    rows = [(f if k % 50 else None, *r) for k, (f, *r) in enumerate(rows)]
    hashes = {f: rng.randrange(-(2**43), 2**43) for f in {r[0] for r in rows}}
    kept, out = Kept(), {}
    # few, many, one, many, few
    for batch in (rows[:5], rows[5:2000], rows[2000:2001], rows[2001:5990], rows[5990:]):
        op = stateful.EpisodeState(us(T0 + timedelta(hours=6)) - us(T0))
        op.init(kept)
        pdf = pd.DataFrame([(f, k, us(ts), score, k, hashes[f]) for f, ts, k, score in batch], columns=["fingerprint", "at", "us", "score", "event_id", "hash"])
        before = kept.calls
        for part in op.handleInputRows((0,), iter([pdf[::2], pdf[1::2]]), Clock(0)):
            out |= {(r[0], r[1]): tuple(r[:8]) for r in part.itertuples(index=False)}
        assert kept.calls - before <= 20 + 4 * len(batch) and (len(batch) < 1000 or kept.calls - before < len(batch) / 4)
    order = lambda x: (x[0] or "", x[1])
    expected = [(f, e, n, us(a), us(z), s, i, j) for f, e, n, a, z, s, i, j in _plain_with_null(rows)]
    assert sorted(out.values(), key=order) == sorted(expected, key=order)
    pages = kept.maps["pages"].values()
    assert sum(len(v[0]) for v in pages) == len(hashes) and max(len(v[0]) for v in pages) < 4 * stateful.PAGE
    assert len(kept.timers) <= 6
    # a window past the last alert no episode is left, but the numbers are
    op = stateful.EpisodeState(us(T0 + timedelta(hours=6)) - us(T0))
    op.init(kept)
    numbers = {f: n for v in kept.maps["pages"].values() for f, n in zip(v[0], v[2], strict=True)}
    before = kept.calls
    for _ in kept.timers:
        assert not list(op.handleExpiredTimer((0,), Clock(max(kept.timers)), None))
    assert kept.calls - before <= 2 + 2 * len(kept.maps["pages"])
    assert all(not v[4] and not any(v[3]) for v in kept.maps["pages"].values())
    assert {f: n for v in kept.maps["pages"].values() for f, n in zip(v[0], v[2], strict=True)} == numbers


def _plain_with_null(rows):
    return [(None if f == "" else f, *r) for f, *r in plain([(f or "", *r) for f, *r in rows], timedelta(hours=6))]


def test_many_fingerprints_over_batches_equal_a_plain_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "dedup_stream", partial(stateful.dedup_stream, groups=2))
    rng = random.Random(7)
    rows = [(f"f{rng.randrange(1200)}", T0 + timedelta(minutes=rng.randrange(60 * 24 * 4)), k, rng.randrange(100)) for k in range(3000)]
    got, q = run(spark, tmp_path, [rows[:3], rows[3:1500], rows[1500:1501], rows[1501:]])
    assert sorted(got.values()) == plain(rows, timedelta(hours=6))
    state = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) < 300


def test_replay_keeps_alerts_however_late(spark):
    rows = [("f", T0 + timedelta(days=50 - k, hours=k % 2), k, 1) for k in range(40)]
    alerts = spark.createDataFrame(rows, SCHEMA)
    out = fold_available(alerts, "event_id", F.floor(F.col("event_id") / 20), 2, hours=6)
    assert out.groupBy("batch_id").agg(F.sum("occurrence_count").alias("n")).agg(F.sum("n")).collect()[0][0] == 40
    assert out.select("episode").distinct().count() == 40
