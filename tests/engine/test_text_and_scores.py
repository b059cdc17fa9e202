import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nightjar.functions import anomalies as A
from nightjar.functions import scoring as S
from nightjar.functions import text as X
from nightjar.functions.fingerprint import alert_fingerprints


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"k long, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def collapse(text):
    """White space outside quotes to one space, by a state machine."""
    out, quote = [], ""
    for c in text.strip():
        if quote:
            quote = "" if c == quote else quote
            out.append(c)
        elif c in "\"'":
            quote = c
            out.append(c)
        elif c.isspace():
            if out and not out[-1].isspace():
                out.append(" ")
        else:
            out.append(c)
    return "".join(out).strip()


def test_command_normalisation(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("ab \t\"'\n") for _ in range(rng.randrange(25))) for _ in range(500)] + ['A  "b  c" d', "open ' x  y"]
    assert column(spark, values, lambda c: X.normalize_command(c, F.lit("linux"))) == [collapse(v) for v in values]
    assert column(spark, ["A  B"], lambda c: X.normalize_command(c, F.lit("windows"))) == ["a b"]


def test_basenames(spark):
    values = ["C:\\Windows\\PowerShell.exe ", "/usr/bin/bash", " sh", "", None, "a/b\\c", "dir/"]
    assert column(spark, values, lambda c: X.process_basename(c, F.lit("windows"))) == ["powershell.exe", "bash", "sh", "", "", "c", ""]
    assert column(spark, ["/bin/Bash"], lambda c: X.process_basename(c, F.lit("linux"))) == ["Bash"]


def test_json_strings_like_python(spark):
    values = ["", "a\"b\\c", "\x00\x01\x1f\b\t\n\f\r\x7f", "é ☃ /"]
    assert column(spark, values, X.json_string) == [json.dumps(v, ensure_ascii=False) for v in values]


def test_entropy(spark):
    values = ["", "a", "aab", "abcdef" * 20, "é☃é"]
    want = [-sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0.0 for v in values]
    assert column(spark, values, X.entropy) == pytest.approx(want)


def test_hosts_and_text(spark):
    values = ['{"hostname": "", "host": "WS01."}', '{"Computer": " Srv "}', "{}", None, "no json"]
    assert column(spark, values, X.host_of) == ["ws01", "srv", "", "", ""]
    assert column(spark, ["abcdefgh", "abc"], lambda c: X.truncate(c, 6)) == ["abc...", "abc"]


def test_anomalies(spark):
    cases = {
        "": [], "powershell -EncodedCommand x": ["encoded_payload", "suspicious_flags"], "curl http://x": ["download_cradle"], "p`ower": ["obfuscation"], "c^m d": [], "c^md": ["obfuscation"],
        "'a' + 'b'": ["obfuscation"], "$ENV:x": ["obfuscation"], "C:\\Temp\\x": ["unusual_path"], "x" * 300: ["high_entropy_argument"], "a" * 90: [], "".join(map(chr, range(65, 91))) * 4: ["high_entropy_argument"],
    }
    assert column(spark, list(cases), A.anomalies) == list(cases.values())


@pytest.mark.parametrize("severity", ["low", "medium", "high", "critical"])
def test_score_formula(spark, severity):
    sub = S.SEVERITY[severity]
    got = [r[0] for r in spark.range(0, 101).orderBy("id").select(S.score(F.lit(sub), F.col("id"))).collect()]
    assert got == [max(0, min(150, math.floor(sub * (0.25 + 0.75 * c / 100) * 1.5 + 0.5))) for c in range(101)]


def test_bands_and_errors(spark):
    assert column(spark, [0, 59, 60, 89, 90, 119, 120, 150], S.risk_band, "int") == ["low", "low", "medium", "medium", "high", "high", "critical", "critical"]
    assert column(spark, [0, 30, 60], S.interpret, "int")[1].startswith("Low")
    with pytest.raises(Exception, match="unknown severity"):
        spark.range(1).select(S.severity_subscore(F.lit("urgent"))).collect()


def test_context_deltas(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")

    def conf(**over):
        base = dict(severity=F.lit("high"), configured=arr("a", "b"), matched=arr("a", "b"), parent_reason=F.lit("neutral_lineage"), user_reason=F.lit("neutral"), indicators=arr())
        r = spark.range(1).select(*[c.alias(n) for n, c in S.assess(**(base | over)).items()]).first()
        return r["confidence_subscore"], r["score_breakdown"]["confidence"]

    assert conf()[0] == 51
    assert conf(parent_reason=F.lit("suspicious_parent_match"))[0] == 66
    assert conf(indicators=arr(*A.WEIGHTS))[0] == 51 + 25
    assert conf(whitelist_reason=F.lit("exact_match"))[0] == 21
    assert conf(admin_reason=F.lit("full_approved_context"))[0] == 31
    c, b = conf(admin_reason=F.lit("full_approved_context"), user_reason=F.lit("system_interactive_shell"))
    assert c == 66 and b["factors"][5]["reason"] == "not_applied_due_to_user_anomaly"
    assert conf(missing=F.lit(True))[0] == 36
    c, b = conf(semantics=F.lit("or"), configured=arr("a", "b", "c"), matched=arr("a"))
    assert c == 35 + 5 - 8 and [f["name"] for f in b["factors"]] == ["detection_criteria", "parent_context", "user_context", "command_anomaly", "whitelist_adjacency", "admin_context", "partial_match"]
    assert conf(matched=arr(), partially=arr("x"))[0] == 30


def test_fingerprint_is_hash_of_canonical_json(spark):
    row = ("WIN-001", "windows", "WS1.", "C:\\x\\A.EXE", 'A.exe  "Q  z" é', "Dom\\ Joe", None, None)
    df = spark.createDataFrame([row], "rule_id string, platform string, host string, process_name string, command_line string, user string, parent_process_name string, raw string")
    got = df.select(*[c.alias(n) for n, c in alert_fingerprints(unicode_form=True).items()]).first()
    fields = {"v": 1, "rule_id": "WIN-001", "platform": "windows", "host": "ws1", "process_name": "a.exe", "command_line": 'a.exe "q  z" é', "user": "dom\\ joe", "parent_process_name": ""}
    text = lambda d: hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got["fingerprint"] == text(fields) and got["fp_host"] == "ws1"
    del fields["host"]
    assert got["activity_fingerprint"] == text(fields)
