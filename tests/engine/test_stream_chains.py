"""Chains whose stages come in different micro-batches."""

from pyspark.sql import functions as F

from nightjar.operators import chains, lineage
from nightjar.operators import store as module
from nightjar.operators.store import Store
from nightjar.rules.builtin import CHAINS, RULES
from nightjar.rules.model import Chain, Stage
from nightjar.streaming import ingest

from test_detect_and_chains import events, random_rows

WEB = [
    dict(event_id=1, process_name="nginx", command_line="nginx", process_id=10, ts=0),
    dict(event_id=2, process_name="bash", command_line="bash -c x", process_id=11, parent_process_id=10, ts=60),
    dict(event_id=3, process_name="curl", command_line="curl http://x.example/a", process_id=12, parent_process_id=11, ts=120),
]


def fingerprints(df):
    return sorted(r["fingerprint"] for r in df.select("fingerprint").collect())


def test_a_chain_over_three_batches_is_found_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sink = ingest.store_sink(store, RULES, CHAINS)
    for k, row in enumerate(WEB):
        sink(events(spark, [row]), k)
        assert store.read("incidents").count() == (k == 2)
    sink(events(spark, [WEB[2]]), 2)  # a replay
    sink(events(spark, [dict(event_id=9, process_name="ls", process_id=13, parent_process_id=12, ts=200)]), 3)
    assert fingerprints(store.read("incidents")) == fingerprints(chains.incidents(lineage.build(events(spark, WEB)), CHAINS))


def test_random_batches_equal_one_run(spark, tmp_path):
    chain = Chain("CHAIN-LNX-901", "t", "linux", "high", 40, (Stage("0", {"process_name_any": ["a", "pid-3"]}), Stage("1", {"process_name_any": ["b"]}, "descendant")))
    rows = sorted(random_rows(8, 90), key=lambda r: r.get("ts", 0))
    rows = [dict(r, event_id=k) for k, r in enumerate(rows)]
    store = Store(spark, str(tmp_path / "s"))
    for k in range(0, 90, 30):
        part = events(spark, rows[k : k + 30])
        store.transact(lambda tx, part=part: tx.insert_absent("incidents", ingest.correlate(tx, part, [chain]), "fingerprint"))
    expected = fingerprints(chains.incidents(lineage.build(events(spark, rows)), [chain]))
    assert fingerprints(store.read("incidents")) == expected and expected


def test_old_events_go_but_long_lived_parents_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "LAYERS", 3)
    monkeypatch.setattr(ingest, "LAYERS", 3)
    day, store = 86_400, Store(spark, str(tmp_path / "s"))
    sink = ingest.store_sink(store, RULES, CHAINS)
    sink(events(spark, [dict(event_id=100 + k, process_name="idle", process_id=500, ts=k) for k in range(20)] + [WEB[0]]), 0)
    for k in range(1, 4):
        sink(events(spark, [dict(event_id=200 + k, process_name="idle", process_id=501, ts=k * day)]), k)
    kept = {r["event_id"] for r in store.read("recent").collect()}
    assert 1 in kept and 119 in kept and not kept & set(range(100, 119))
    # the old web server is still the parent of a new shell, too long ago for the chain
    late = [dict(WEB[1], ts=4 * day), dict(WEB[2], ts=4 * day + 5)]
    sink(events(spark, late), 4)
    everything = store.read("recent").drop("_host")
    parents = {r["event_id"]: r["parent_key"] for r in lineage.build(everything).where("event_id IS NOT NULL").collect()}
    assert parents[2] == "h|10|1" and store.read("incidents").count() == 0
    assert store.read("recent").select(F.countDistinct("event_id")).first()[0] == store.read("recent").count()
