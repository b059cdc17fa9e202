"""The store's commits: crashes, two writers, what is read, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from nightjar.operators import episodes
from nightjar.operators.store import Conflict, Store, Transaction
from nightjar.rules.builtin import RULES
from nightjar.streaming import ingest

from test_detect_and_chains import alert_rows
from test_sources_and_surface import alerts_frame

EVENT = ["event_id", "ts", "platform", "process_name", "command_line", "user", "process_id", "parent_process_name", "parent_process_id", "working_directory", "raw", "host"]


class Crash(RuntimeError):
    pass


def test_a_crash_between_any_two_writes_changes_no_count(spark, tmp_path, monkeypatch):
    batch = alerts_frame(spark).select(*EVENT)
    steps = [0]
    write_layer, publish = Store.write_layer, Store.publish

    def counted(f, after):
        def run(*args):
            steps[0] -= 1
            if steps[0] == 0 and not after:
                raise Crash
            out = f(*args)
            if steps[0] == 0:
                raise Crash
            return out

        return run

    for after in (False, True):
        for broken in range(1, 4):
            store = Store(spark, str(tmp_path / f"s{broken}{after}"))
            with monkeypatch.context() as m:
                m.setattr(Store, "write_layer", counted(write_layer, after))
                m.setattr(Store, "publish", counted(publish, after))
                sink = ingest.store_sink(store, RULES)
                steps[0] = broken
                try:
                    sink(batch, 0)
                    crashed = False
                except Crash:
                    crashed = True
            assert crashed == (broken <= 2)  # one layer and the manifest
            sink = ingest.store_sink(store, RULES)
            sink(batch, 0)
            sink(batch, 0)
            assert [r["occurrence_count"] for r in store.read("alerts").collect()] == [1]
            sink(batch, 1)
            assert [r["occurrence_count"] for r in store.read("alerts").collect()] == [2]


def test_two_writers_lose_nothing(spark, tmp_path):
    errors = []

    def writer(k):
        try:
            store = Store(spark, str(tmp_path / "s"))
            for j in range(2):
                store.save_episodes("alerts", alert_rows(spark, [j], fingerprint="f"))
                store.append("rows", spark.createDataFrame([(k, j)], "k int, j int"))
                store.add_suppression(f"other{k}", "global", None, "me", "r", 1)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    store = Store(spark, str(tmp_path / "s"))
    assert sorted(store.read("rows").collect()) == [(k, j) for k in range(3) for j in range(2)]
    assert [r["occurrence_count"] for r in store.read("alerts").collect()] == [6]
    assert sorted(r["suppression_id"] for r in store.read("suppressions").collect()) == [1, 2, 3, 4, 5, 6]


def test_publishing_is_a_compare_and_set(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append("t", spark.range(1))
    a, b = store.version(), store.version()
    store.publish(a)
    with pytest.raises(Conflict):
        store.publish(b)
    assert store.version().number == 2


def test_lookups_open_only_their_buckets(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("fingerprint"), "id")
    store.insert_absent("t", keys, "fingerprint")
    opened = []
    layer = Store.layer
    monkeypatch.setattr(Store, "layer", lambda self, x, buckets=None: opened.append(len(x.buckets if buckets is None else [b for b in x.buckets if b in buckets])) or layer(self, x, buckets))
    some = spark.createDataFrame([("k7", 0), ("new", 1)], "fingerprint string, id long")
    assert dict(store.insert_absent("t", some, "fingerprint").collect()) == {"k7": True, "new": False}
    assert sum(opened) <= 2  # of 32
    opened.clear()
    many = spark.range(400, 900).select(F.concat(F.lit("k"), "id").alias("fingerprint"), "id")
    assert store.insert_absent("t", many, "fingerprint").where("is_duplicate").count() == 100
    assert store.read("t").count() == 901 and store.read("t").select("fingerprint").distinct().count() == 901


def test_compaction_and_vacuum_keep_the_rows(spark, tmp_path, monkeypatch):
    from nightjar.operators import store as module

    monkeypatch.setattr(module, "LAYERS", 3)
    store = Store(spark, str(tmp_path / "s"))
    for k in range(5):
        store.transact(lambda tx, k=k: tx.upsert("t", spark.createDataFrame([("a", k), (f"b{k}", k)], "key string, n int"), "key"))
    assert len(store.version().tables["t"].layers) <= 3
    expected = {("a", 4)} | {(f"b{k}", k) for k in range(5)}
    assert set(map(tuple, store.read("t").collect())) == expected
    older = store.read("t")
    store.append("u", spark.range(2))
    assert set(map(tuple, older.collect())) == expected
    assert store.vacuum(keep=1) > 0 and set(map(tuple, store.read("t").collect())) == expected and store.read("u").count() == 2
    assert store.vacuum(keep=1) == 0


def test_empty_and_mixed_layers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], "key string, n int")
    store.transact(lambda tx: tx.upsert("t", none, "key"))
    assert store.read("t").count() == 0 and store.read("other") is None
    store.transact(lambda tx: tx.upsert("t", spark.createDataFrame([("a", 1, 2.0)], "key string, n int, more double"), "key"))
    assert store.read("t").collect()[0].asDict() == {"key": "a", "n": 1, "more": 2.0}
    with pytest.raises(ValueError, match="keyed"):
        store.append("t", none)


def test_episodes_keep_event_data_and_audit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save_episodes("alerts", alert_rows(spark, [0]))
    (first,) = store.read("alerts").collect()
    store.save_episodes("alerts", alert_rows(spark, [60]).withColumn("command_line", F.lit("later")))
    (row,) = store.read("alerts").collect()
    assert row["event_data"] == first["event_data"] and '"later"' in row["last_event_data"] and row["occurrence_count"] == 2
    store.set_state("alerts", row["alert_id"], "resolved", "me", "done")
    (trail,) = store.audit_trail().collect()
    assert (trail["previous_state"], trail["new_state"], trail["state"], trail["author"], trail["occurrence_count"]) == ("new", "resolved", "resolved", "me", 2)


def test_changes_of_several_tables_are_whole_or_absent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))

    def half(tx: Transaction):
        tx.append("a", spark.range(3))
        raise Crash

    with pytest.raises(Crash):
        store.transact(half)
    assert store.read("a") is None and store.version().number == 0
    assert store.vacuum() == 1  # the layer that no version names
    assert episodes.Store is Store
