import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nightjar.operators import chains, episodes, lineage
from nightjar.operators.detect import detect
from nightjar.rules.builtin import CHAINS, RULES
from nightjar.rules.model import Chain, RuleError, Stage, load_rules, parse_chain, parse_rule, rule_by_id
from nightjar.schema import as_events

T0 = datetime(2026, 3, 1, 10)


def events(spark, rows):
    """rows: dicts of event fields; ts as seconds after T0."""
    base = dict(platform="linux", process_name="x", command_line="", user="u", process_id=1, parent_process_name=None, parent_process_id=None, working_directory=None, raw=None, host="h")
    names = ["event_id", "ts", *base]
    data = [tuple((base | {"event_id": k} | r | {"ts": T0 + timedelta(seconds=r.get("ts", k))})[n] for n in names) for k, r in enumerate(rows)]
    return as_events(spark.createDataFrame(data, "event_id long, ts timestamp, platform string, process_name string, command_line string, user string, process_id long, parent_process_name string, parent_process_id long, working_directory string, raw string, host string"))


def rule(**detection):
    white = detection.pop("whitelist", {})
    return parse_rule({"id": "WIN-900", "name": "t", "platform": "windows", "severity": "high", "detection": detection, "whitelist": white})


EVENT = dict(platform="windows", process_name="C:\\W\\PowerShell.EXE", command_line="powershell -NoP  IEX http://x", user="CORP\\admin", parent_process_name="C:\\Office\\WINWORD.exe", working_directory="C:\\Users\\Bob")


@pytest.mark.parametrize("detection,hit", [
    (dict(process_name="powershell.exe"), True), (dict(process_name="cmd.exe"), False),
    (dict(command_contains=["iex", "HTTP"]), True), (dict(command_contains=["iex", "ftp"]), False),
    (dict(command_contains_any=["ftp", "http"]), True), (dict(command_contains_any=["ftp"]), False),
    (dict(command_regex="nop\\s+iex"), True), (dict(command_regex="^iex"), False),
    (dict(parent_process="winword.exe"), True), (dict(parent_process="excel.exe"), False),
    (dict(user_pattern="corp\\\\adm"), True), (dict(user_pattern="^adm"), False),
    (dict(process_name="powershell.exe", command_contains_any=["ftp"]), False),
    (dict(process_name="powershell.exe", whitelist={"users": ["corp\\ADMIN"]}), False), (dict(process_name="powershell.exe", whitelist={"users": ["admin"]}), True),
    (dict(process_name="powershell.exe", whitelist={"parent_processes": ["WinWord.exe"]}), False), (dict(process_name="powershell.exe", whitelist={"paths": ["\\users\\"]}), False),
])
def test_every_criterion(spark, detection, hit):
    assert (detect(events(spark, [EVENT]), [rule(**detection)]).count() == 1) == hit


def test_other_platforms_do_not_match(spark):
    assert detect(events(spark, [EVENT | {"platform": "linux"}]), [rule(process_name="powershell.exe")]).count() == 0


# Golden scores: event, rule, confidence, score.
GOLDEN = [
    (dict(platform="linux", process_name="curl", command_line="curl http://x.example/a.sh", user="1000"), "LNX-001", 50, 70),
    (dict(platform="linux", process_name="nc", command_line="nc -l -p 4444", user="1000"), "LNX-006", 51, 71),
    (dict(platform="macos", process_name="spctl", command_line="spctl --master-disable", user="uid:501"), "MAC-004", 51, 95),
    (dict(platform="macos", process_name="osascript", command_line='osascript -e do shell script "curl x"', user="uid:501"), "MAC-001", 61, 80),
]


@pytest.mark.parametrize("event,rule_id,conf,score", GOLDEN)
def test_golden_scores(spark, event, rule_id, conf, score):
    (r,) = detect(events(spark, [event]), [rule_by_id(RULES, rule_id)]).collect()
    assert (r["confidence_subscore"], r["score"]) == (conf, score)


def test_many_rules(spark):
    many = [parse_rule({"id": f"LNX-{k:03d}", "name": "t", "platform": "linux", "severity": "low", "detection": {"process_name": f"p{k % 5}", "command_contains": [f"c{k % 10}"]}}) for k in range(150)]
    rows = [dict(process_name=f"p{k % 5}", command_line=f"run c{k % 10}") for k in range(20)]
    assert detect(events(spark, rows), many).count() == 20 * 15
    assert detect(events(spark, rows), []).count() == 0


def test_rule_validation(tmp_path):
    good = {"id": "LNX-001", "name": "n", "platform": "linux", "severity": "low", "detection": {"process_name": "x"}}
    parse_rule(good)
    for bad in ({"id": "X-1"}, {"platform": "bsd"}, {"severity": "urgent"}, {"detection": {}}, {"detection": {"odd": 1}}, {"detection": {"command_contains": []}}, {"detection": {"command_regex": "("}}, {"mitre_attack": ["T1"]}):
        with pytest.raises(RuleError):
            parse_rule(good | bad)
    chain = {"id": "CHAIN-LNX-001", "name": "n", "platform": "linux", "severity": "low", "window_seconds": 5, "stages": [{"name": "a", "match": {"process_name": "x"}}] * 2}
    parse_chain(chain)
    for bad in ({"window_seconds": 0}, {"window_seconds": 86_401}, {"stages": chain["stages"][:1]}, {"stages": [{"name": "a", "match": {}}] * 2}, {"extra": 1}):
        with pytest.raises(RuleError):
            parse_chain(chain | bad)
    import json

    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good))
    (tmp_path / "c.json").write_text("{")
    assert [r.id for r in load_rules(tmp_path)] == ["LNX-001"] and load_rules(tmp_path, "windows") == []
    assert len(RULES) == 27 and len(CHAINS) == 5


# ------------------------------------------------------------- lineage and chains


def brute_parents(rows):
    """Parent of each event, by a loop over all candidates in order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["ts"], rows[k]["process_id"], k))
    out = {}
    for c in order:
        best = None
        for p in order:
            a, b = rows[p], rows[c]
            if p != c and a["host"] == b["host"] and a["process_id"] == b["parent_process_id"] and a["ts"] <= b["ts"] and (not b["parent_process_name"] or a["process_name"] == b["parent_process_name"]):
                best = p
        out[c] = best
    return out


def random_rows(seed, n=60):
    rng = random.Random(seed)
    return [dict(host=f"h{rng.randrange(2)}", ts=rng.randrange(25), process_id=rng.randrange(12), parent_process_id=rng.choice([None, *range(12)]), process_name=rng.choice("abc"), parent_process_name=rng.choice([None, None, "a", "b"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parents_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(lineage, "SPAN_ROWS", 60 if seed % 2 else 7)  # one span, and many
    rows = random_rows(seed)
    want = brute_parents(rows)
    nodes = {r["key"]: r for r in lineage.build(events(spark, rows)).collect()}
    by_event = {r["event_id"]: r for r in nodes.values() if not r["is_phantom"]}
    for k, row in enumerate(rows):
        parent = nodes.get(by_event[k]["parent_key"])
        if want[k] is not None:
            assert parent["event_id"] == want[k]
        elif row["parent_process_id"] is None and not row["parent_process_name"]:
            assert parent is None
        else:
            assert parent["is_phantom"] and parent["pid"] == row["parent_process_id"]
            assert parent["process_name"] == row["parent_process_name"] or not parent["process_name"].startswith("pid-") or row["parent_process_name"] is None


@pytest.mark.parametrize("seed", [4, 5])
def test_closure_matches_brute_force(spark, seed):
    nodes = lineage.build(events(spark, random_rows(seed)))
    rows = nodes.collect()
    kids = {}
    for r in rows:
        kids.setdefault(r["parent_key"], []).append(r["key"])
    want = set()
    for r in rows:
        seen, frontier = {r["key"]}, [r["key"]]
        while frontier:
            frontier = [k for f in frontier for k in kids.get(f, []) if k not in seen]
            seen |= set(frontier)
        want |= {(r["key"], k) for k in seen - {r["key"]}}
    got = lineage.all_descendants(nodes, nodes).select("anc", "key").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def brute_paths(rows, chain):
    """First complete path of each anchor by depth-first search in sorted order."""
    kids, by = {}, {r["key"]: r for r in rows}
    for r in rows:
        kids.setdefault(r["parent_key"], []).append(r["key"])
    order = lambda k: (not by[k]["is_phantom"], by[k]["ts"] or T0, -1 if by[k]["pid"] is None else by[k]["pid"], k)

    def below(k):
        seen, frontier = {k}, [k]
        while frontier:
            frontier = [x for f in frontier for x in kids.get(f, []) if x not in seen]
            seen |= set(frontier)
        return seen - {k}

    def extend(path):
        if len(path) == len(chain.stages):
            return path
        s = chain.stages[len(path)]
        for c in sorted((x for x in (below(path[-1]) if s.relation == "descendant" else kids.get(path[-1], [])) if by[x]["process_name"] in s.match["process_name_any"]), key=order):
            times = [by[x]["ts"] for x in path if by[x]["ts"]]
            if by[c]["ts"] and times and (by[c]["ts"] < max(times) or (by[c]["ts"] - min(times)).total_seconds() > chain.window_seconds):
                continue
            if found := extend([*path, c]):
                return found
        return None

    starts = [k for k, r in by.items() if r["platform"] == chain.platform and r["process_name"] in chain.stages[0].match["process_name_any"]]
    return {k: tuple(p) for k in starts if (p := extend([k]))}


@pytest.mark.parametrize("seed,relation,window", [(6, "descendant", 6), (7, "child", 10), (8, "descendant", 100)])
def test_chains_match_depth_first_search(spark, seed, relation, window):
    names = [["a", "pid-3"], ["a", "b"], ["b", "c"]]
    chain = Chain("CHAIN-LNX-900", "t", "linux", "high", window, tuple(Stage(str(k), {"process_name_any": n}, relation) for k, n in enumerate(names)))
    from nightjar.storage import materialize

    nodes = materialize(lineage.build(events(spark, random_rows(seed, 90))), "t")
    got = {r["anchor"]: tuple(s["node_key"] for s in r["stages"]) for r in chains.match_chains(nodes, [chain]).collect()}
    assert got == brute_paths(nodes.collect(), chain)


def test_office_chain_scores_and_window(spark):
    def run(gap):
        rows = [dict(platform="windows", process_name="WINWORD.EXE", process_id=10, ts=0), dict(platform="windows", process_name="powershell.exe", command_line="powershell -enc AAAA", process_id=11, parent_process_id=10, parent_process_name="winword.exe", ts=gap)]
        return chains.incidents(lineage.build(events(spark, rows)), CHAINS).collect()

    (r,) = run(300)
    assert (r["chain_id"], r["confidence"], r["score"], r["risk_band"]) == ("CHAIN-WIN-001", 80, 128, "critical")
    assert run(301) == []
    phantom = [dict(platform="windows", process_name="powershell.exe", command_line="powershell -enc AAAA", process_id=11, parent_process_id=10, parent_process_name="winword.exe")]
    (r,) = chains.incidents(lineage.build(events(spark, phantom)), CHAINS).collect()
    assert (r["confidence"], r["score"], r["stages"][0]["phantom"]) == (70, 116, True)


# ------------------------------------------------------------- episodes


def alert_rows(spark, times, fingerprint="f"):
    df = events(spark, [dict(ts=t) for t in times])
    return df.withColumn("fingerprint", F.lit(fingerprint)).withColumn("score", F.lit(70)).withColumns({c: F.lit("x") for c in ("rule_id", "rule_name", "severity", "fp_host", "activity_fingerprint", "risk_band", "description")}).withColumn("mitre_attack", F.array(F.lit("T1")))


def test_gap_sessions_and_arrival_fold(spark):
    day = 86_400
    a = alert_rows(spark, [0, day, 2 * day + 1, 2 * day + 2])
    got = sorted(r["occurrence_count"] for r in episodes.episodes(a).collect())
    assert got == [2, 2]  # exactly a day apart still belongs together
    late = episodes.fold_arrivals(alert_rows(spark, [0, 3 * day, day])).collect()
    assert sorted(r["occurrence_count"] for r in late) == [1, 2]
    assert {r["occurrence_count"]: r["first_seen"] for r in late}[2] == T0


def test_store_lifecycle(spark, tmp_path):
    store = episodes.Store(spark, str(tmp_path / "s"))
    assert store.read("alerts") is None
    assert store.save_episodes("alerts", alert_rows(spark, [0, 10])) == {"new": 1, "duplicate": 1, "suppressed": 0}
    assert store.save_episodes("alerts", alert_rows(spark, [20])) == {"new": 0, "duplicate": 1, "suppressed": 0}
    (row,) = store.read("alerts").collect()
    assert row["occurrence_count"] == 3
    assert store.set_state("alerts", row["alert_id"], "resolved", "me") and not store.set_state("alerts", "nope", "new", "me")
    with pytest.raises(ValueError):
        store.set_state("alerts", row["alert_id"], "odd", "me")
    assert store.read("audit").select("previous_state", "new_state").first() == ("new", "resolved")
    assert store.save_episodes("alerts", alert_rows(spark, [30])) == {"new": 1, "duplicate": 0, "suppressed": 0}  # closed ones take no more
    store.add_suppression("f", "host", "x", "me", "known", 1)
    assert store.save_episodes("alerts", alert_rows(spark, [40]))["suppressed"] == 1
    store.add_suppression("other", "global", None, "me", "known", 1)
    assert [r["suppression_id"] for r in store.read("suppressions").orderBy("suppression_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        store.add_suppression("f", "host", None, "me", "r", 1)
    one = spark.createDataFrame([("k", 1)], "fingerprint string, n int")
    assert [r[1] for r in store.insert_absent("i", one, "fingerprint").collect()] == [False]
    assert [r[1] for r in store.insert_absent("i", one, "fingerprint").collect()] == [True] and store.read("i").count() == 1


def test_repeated_events_make_one_node_each_and_deep_lineage(spark):
    """An event read twice, and a line of processes deeper than any fixed number of joins below it."""
    from datetime import datetime, timedelta

    from nightjar.operators import lineage
    from nightjar.schema import as_events

    rows = [(k, datetime(2026, 1, 1) + timedelta(seconds=k), "linux", "sh", "sh", k, k - 1 if k else None, "h") for k in range(80)]
    rows += rows[3:4] * 2 + rows[70:71]
    events = as_events(spark.createDataFrame(rows, "event_id long, ts timestamp, platform string, process_name string, command_line string, process_id long, parent_process_id long, host string"))
    nodes = lineage.build(events)
    assert nodes.count() == 80 and nodes.select("key").distinct().count() == 80
    found = {(r["key"], r["anc"]): r["depth"] for r in lineage.ancestors(nodes).collect()}
    assert found == {(f"h|{a}|{a}", f"h|{b}|{b}"): a - b for a in range(80) for b in range(max(0, a - 64), a)}


def test_log_folders_are_read_by_file_name(spark, tmp_path):
    from nightjar.sources import read_events

    line = 'type=EXECVE msg=audit(1700000000.5:{0}): argc=1 a0="ls"\n'
    for name, n in (("audit.log", 1), ("audit.log.1", 2), ("other.txt", 3)):
        (tmp_path / name).write_text(line.format(n))
    assert read_events(spark, "linux", str(tmp_path)).count() == 2
    assert read_events(spark, "linux", str(tmp_path / "other.txt")).count() == 1
    assert read_events(spark, "windows", str(tmp_path)).count() == 0
    (tmp_path / "e.xml").write_text('<Event><System><EventID>1</EventID></System><EventData><Data Name="ProcessId">5</Data><Data Name="Image">a.exe</Data><Data Name="CommandLine">a</Data><Data Name="User">u</Data><Data Name="UtcTime">2026-01-01 00:00:00.000</Data></EventData></Event>')
    assert read_events(spark, "windows", str(tmp_path)).count() == 1


def test_orphans_of_one_key_are_not_multiplied(spark):
    """Two differing records of one host, pid and event id: a node each, two children of the unseen parent."""
    from nightjar.schema import as_events

    rows = [(1, 0, "macos", "sh", c, 5, 4, "h") for c in ("sh -c a", "sh -c b")]
    found = spark.createDataFrame(rows, "event_id long, us long, platform string, process_name string, command_line string, process_id long, parent_process_id long, host string")
    made = as_events(found.selectExpr("*", "timestamp_micros(us) AS ts"))
    nodes = lineage.build(made)
    assert sorted((r["is_phantom"], r["command_line"]) for r in nodes.collect()) == [(False, "sh -c a"), (False, "sh -c b"), (True, "")]
    assert [tuple(r) for r in lineage.phantoms(made).collect()] == [("h|phantom|4||", 2, "pid-4")]
