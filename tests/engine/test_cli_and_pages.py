"""The command line over a store, pages of any number, NFC in fingerprints."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from nightjar import cli
from nightjar.functions.fingerprint import alert_fingerprints
from nightjar.operators import alerts as Q
from nightjar.operators.store import Store
from nightjar.rules.builtin import CHAINS, RULES
from nightjar.service import Service
from nightjar.streaming.ingest import ingest_logs

from test_detect_and_chains import alert_rows
from test_sources_and_surface import AUDIT, es_line


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)

    def go(*args):
        capsys.readouterr()
        code = cli.main(["--store", str(tmp_path / "store"), *args])
        out = capsys.readouterr()
        return code, out.out, out.err

    return go


def test_command_line(run, tmp_path):
    log = tmp_path / "audit.log"
    log.write_text(AUDIT)
    assert run("alerts")[0] == 1 and run("scan", "linux", str(tmp_path / "none.log"))[0] == 1
    assert run("scan", "linux", str(log), "--allow", str(tmp_path / "other"))[0] == 1
    code, out, _ = run("scan", "linux", str(log), "--save", "--correlate")
    assert code == 0 and json.loads(out.strip().split("\n")[-1]) == {"new": 2, "duplicate": 0, "suppressed": 0}
    code, out, _ = run("alerts", "--format", "json")
    rows = json.loads(out)
    assert code == 0 and {r["rule_id"] for r in rows} == {"LNX-001", "LNX-006"}
    newest = max(rows, key=lambda r: r["ts"])
    code, out, _ = run("alerts", "--format", "csv")
    table = list(csv.DictReader(io.StringIO(out)))
    assert list(table[0]) == ["id", "timestamp", "severity", "score", "rule_id", "rule_name", "platform", "process_name", "user", "command_line", "mitre_attack", "description"] and len(table) == 2
    other = next(r["rule_id"] for r in rows if r is not newest)
    assert json.loads(run("alerts", "--format", "json", "--limit", "1", "--rule-id", other)[1]) == []  # the limit comes first
    out = run("alerts")[1]
    assert "LNX-001" in out and "percent" in out.lower() or "share" in out.lower() or "severity" in out
    assert "command_line:" in run("alerts", "--verbose", "--no-summary")[1]
    assert len(run("export", "--format", "cef")[1].strip().split("\n")) == 2 and run("incidents", "--format", "json")[0] == 0
    assert run("state", newest["alert_id"], "resolved", "--author", "me")[0] == 0 and run("state", "none-1", "new", "--author", "me")[0] == 1
    assert next(r for r in json.loads(run("alerts", "--format", "json")[1]) if r["alert_id"] == newest["alert_id"])["state"] == "resolved"
    assert json.loads(run("suppress", newest["fingerprint"], "--author", "me", "--reason", "r", "--scope", "host", "--host", "h")[1]) == {"id": 1}
    assert run("suppress", "f", "--author", "me", "--reason", "r", "--hours", "0")[0] == 1
    assert "LNX-001" in run("rules")[1]


def test_ingest_reads_new_files_once(spark, run, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text(AUDIT)
    assert json.loads(run("ingest", "linux", str(logs))[1]) == {"batches": 1} and json.loads(run("ingest", "linux", str(logs))[1]) == {"batches": 0}
    (logs / "b.log").write_text(AUDIT.replace("1767225601.000:8", "1767225661.000:9"))
    assert json.loads(run("ingest", "linux", str(logs))[1]) == {"batches": 1}
    assert sorted(r["occurrence_count"] for r in json.loads(run("alerts", "--format", "json")[1])) == [2, 2]
    mac = tmp_path / "mac"
    mac.mkdir()
    (mac / "x.ndjson").write_text(es_line())
    assert ingest_logs(spark, Store(spark, str(tmp_path / "m")), "macos", str(mac), str(tmp_path / "c"), RULES, CHAINS) == 1


def test_pages_reach_every_row_once(spark, tmp_path):
    rows = spark.range(23).select(F.concat(F.lit("a"), "id").alias("alert_id"), F.when(F.col("id") % 5 != 4, F.timestamp_seconds(F.floor(F.col("id") / 3))).alias("ts"))
    everything = [r["alert_id"] for r in Q.newest(rows, None, "ts", "alert_id").collect()]
    seen, after = [], None
    while part := Q.page_after(rows, 4, after).collect():
        seen += [r["alert_id"] for r in part]
        after = (part[-1]["ts"] and part[-1]["ts"].isoformat(), part[-1]["alert_id"])
    assert seen == everything and len(seen) == 23


def test_service_pages(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    found = alert_rows(spark, [0, 200_000, 400_000, 600_000, 800_000]).withColumns({"severity": F.lit("high"), "platform": F.lit("linux")})
    store.save_episodes("alerts", found)
    service = Service(spark, store, RULES)
    seen, after = [], "start"
    while after:
        answer = service.alerts({"after": after, "limit": "2", "severity": "high"})
        seen += [r["alert_id"] for r in answer["alerts"]]
        lines = service.export({"after": after, "limit": "2"})
        assert lines["count"] == answer["count"] and lines.get("next") == answer.get("next")
        after = answer.get("next")
    assert len(seen) == len(set(seen)) == 5
    assert service.handle("GET", "/api/alerts?after=odd")[0] in (400, 401)


def test_fingerprints_compose_text(spark):
    rows = [("curl caf\u00e9", "zo\u00eb"), ("curl cafe\u0301", "zoe\u0308")]
    df = spark.createDataFrame([(*r, "R", "linux", "curl", None, "h", None) for r in rows], "command_line string, user string, rule_id string, platform string, process_name string, parent_process_name string, host string, raw string")
    assert df.select(alert_fingerprints()["fingerprint"]).distinct().count() == 1
