import hashlib
import json
from datetime import datetime, timedelta

from test_text_and_scores import collapse

from nightjar import queries
from nightjar.operators.detect import detect
from nightjar.rules.builtin import RULES
from nightjar.schema import as_events

COMMANDS = [
    ("linux", "bash", 'bash -c  "echo aGk=  | base64 -d | bash"'), ("macos", "osascript", 'osascript -e  \'do shell script  "id"\''),
    ("linux", "bash", "bash -c  'echo aGk=  | base64 -d | bash'"), ("linux", "bash", 'echo aGk= |  base64 -d | bash "'),
]


def quoted(spark):
    rows = [(k, datetime(2026, 1, 1) + timedelta(hours=k // 8), p, n, c, "joe", "h1") for k, (p, n, c) in enumerate(COMMANDS * 4)]
    return detect(as_events(spark.createDataFrame(rows, "event_id long, ts timestamp, platform string, process_name string, command_line string, user string, host string")), RULES)


def test_alerts_with_quotes_are_printed_like_by_the_state_machine(spark, monkeypatch):
    monkeypatch.setattr(queries, "_alerts", lambda spark, sf_dir: quoted(spark))
    alerts = {(r["event_id"], r["rule_id"]): r for r in quoted(spark).collect()}
    want = {}
    for k, r in alerts.items():
        fields = {"v": 1, "rule_id": r["rule_id"], "platform": r["platform"], "process_name": r["process_name"], "command_line": collapse(r["command_line"]), "user": "joe", "parent_process_name": "", "host": "h1"}
        want[k] = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert {c for _, _, c in COMMANDS} == {r["command_line"] for r in alerts.values()}
    assert {(r["event_id"], r["rule_id"]): r["fingerprint"] for r in queries.fingerprint_alerts(spark, "").collect()} == want
    for q in (queries.dedup_episodes, queries.dedup_arrival_fold):
        rows = q(spark, "").collect()
        assert sum(r["occurrence_count"] for r in rows) == len(want) and {r["fingerprint"] for r in rows} == set(want.values())
    assert {(r["event_id"], r["rule_id"]) for r in queries.suppression_filter(spark, "").collect()} == set(want)


def processes(spark, rows):
    """rows: event_id, host, seconds, platform, name, command, pid, parent's name and pid."""
    data = [(k, datetime(2026, 1, 1) + timedelta(seconds=t), p, n, c, pid, pn, ppid, h) for k, h, t, p, n, c, pid, pn, ppid in rows]
    return as_events(spark.createDataFrame(data, "event_id long, ts timestamp, platform string, process_name string, command_line string, process_id long, parent_process_name string, parent_process_id long, host string"))


def test_all_incidents_of_the_filter(spark, monkeypatch):
    rows = [(k, f"h{k}", k, "windows", "powershell.exe", "powershell -enc AAAA", 11, "winword.exe", 10) for k in range(130)]
    monkeypatch.setattr(queries, "process_events", lambda spark, sf_dir: processes(spark, rows))
    assert {r["host"] for r in queries.incident_filters(spark, "").collect()} == {f"h{k}" for k in range(130)}


def test_chains_below_a_phantom_parent(spark, monkeypatch):
    rows = [(1, "h", 5, "macos", "sh", "sh -c x", 11, "osascript", 10), (2, "h", 9, "macos", "curl", "curl http://x.example", 12, "sh", 11)]
    rows += [(3, "g", 0, "macos", "osascript", "osascript x", 10, "launchd", 1), (4, "g", 5, "macos", "sh", "sh -c x", 11, "osascript", 10), (5, "g", 9, "macos", "curl", "curl http://x.example", 12, "sh", 11)]
    monkeypatch.setattr(queries, "process_events", lambda spark, sf_dir: processes(spark, rows))
    for q in (queries.chain_child, queries.chain_window):
        assert {(r["anchor"], r["last"]) for r in q(spark, "").collect()} == {("h|phantom|10|osascript|", "h|11|1"), ("g|10|3", "g|11|4")}
    assert {(r["anchor"], r["k1"], r["k2"]) for r in queries.chain_descendant(spark, "").collect()} == {("h|phantom|10|osascript|", "h|11|1", "h|12|2"), ("g|10|3", "g|11|4", "g|12|5")}
