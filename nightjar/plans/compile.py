"""Compiles rules and chain stages into predicates.

A rule becomes SQL text, which Spark parses into one Catalyst expression: rule
sets of any size cost one call from Python.  The predicates read these columns,
computed once per event by ``prepare``: ``_cmd`` (command line), ``_cmd_l``
(lower case), ``_proc`` and ``_parent`` (normalised base names), ``_user``,
``_user_l``, ``_cwd_l``, ``_wide`` (the command line is not all ASCII).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import process_basename
from ..rules.model import Rule, Stage
from ..rules.patterns import required

#: Dialect of rule patterns: case-insensitive, Unicode classes, only LF ends a line.
FLAGS = "(?idU)"
PREPARED = ("_cmd", "_cmd_l", "_proc", "_parent", "_user", "_user_l", "_cwd_l", "_wide")


def prepare(events: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    platform = F.col("platform")
    return events.select(
        "*", text("command_line").alias("_cmd"), F.lower(text("command_line")).alias("_cmd_l"),
        process_basename(F.col("process_name"), platform).alias("_proc"), process_basename(F.col("parent_process_name"), platform).alias("_parent"),
        text("user").alias("_user"), F.lower(text("user")).alias("_user_l"), F.lower(text("working_directory")).alias("_cwd_l"),
        (F.length(text("command_line")) != F.octet_length(text("command_line"))).alias("_wide"),
    )


def basename(name: str, platform: str) -> str:
    """The same normalisation for a name that a rule holds."""
    base = name.strip().replace("\\", "/").rsplit("/", 1)[-1]
    return base.lower() if platform == "windows" else base


def literal(text: str) -> str:
    """``text`` as a SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _contains(column: str, parts, word: str) -> str:
    return "(" + f" {word} ".join(f"contains({column}, {literal(p.lower())})" for p in parts) + ")" if parts else "false"


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(literal(v) for v in values)})"


def _matches(column: str, pattern: str) -> str:
    return f"{column} RLIKE {literal(FLAGS + pattern)}"


def contains_all(parts) -> Column:
    return F.expr(_contains("_cmd_l", parts, "AND"))


def contains_any(parts) -> Column:
    return F.expr(_contains("_cmd_l", parts, "OR"))


def matches(column: str, pattern: str) -> Column:
    return F.expr(_matches(column, pattern))


def criteria_sql(rule: Rule) -> list[str]:
    """One predicate per configured criterion, cheap ones first."""
    d, out = rule.detection, []
    for c in rule.criteria:
        if c == "process_name":
            out.append(f"_proc = {literal(basename(d[c], rule.platform))}")
        elif c == "command_contains":
            out.append(_contains("_cmd_l", d[c], "AND"))
        elif c == "command_contains_any":
            out.append(_contains("_cmd_l", d[c], "OR"))
        elif c == "command_regex":
            out.append(_matches("_cmd", d[c]))
        elif c == "parent_process":
            out.append(f"(coalesce(parent_process_name, '') <> '' AND _parent = {literal(basename(d[c], rule.platform))})")
        elif c == "user_pattern":
            out.append(_matches("_user", d[c]))
    return out


def criteria(rule: Rule) -> list[Column]:
    return [F.expr(c) for c in criteria_sql(rule)]


def whitelisted_sql(rule: Rule) -> str:
    w, out = rule.whitelist, []
    if w.get("users"):
        out.append("(_user <> '' AND " + _one_of("_user_l", [u.lower() for u in w["users"]]) + ")")
    if w.get("parent_processes"):
        out.append("(_parent <> '' AND " + _one_of("_parent", [basename(p, rule.platform) for p in w["parent_processes"]]) + ")")
    if w.get("paths"):
        out.append("(_cwd_l <> '' AND " + _contains("_cwd_l", w["paths"], "OR") + ")")
    return f"coalesce({' OR '.join(out)}, false)" if out else "false"


def whitelisted(rule: Rule) -> Column:
    return F.expr(whitelisted_sql(rule))


def criteria_hold(rule: Rule) -> str:
    """The rule's criteria hold and no allow list excuses the event, whatever its platform."""
    return " AND ".join([*(criteria_sql(rule) or ["true"]), *([f"NOT {whitelisted_sql(rule)}"] if rule.whitelist else [])])


def predicate(rule: Rule) -> Column:
    """The rule holds for the event and no allow list excuses it."""
    return F.expr(f"platform = {literal(rule.platform)} AND {criteria_hold(rule)}")


def _guard(rule: Rule) -> str | None:
    """A cheap test that holds for every event that the rule may fit, from literals its criteria need; None if they need none."""
    d, choices = rule.detection, []
    if d.get("command_contains"):
        choices.append((len(max(d["command_contains"], key=len)), _contains("_cmd_l", [max(d["command_contains"], key=len)], "OR")))
    if d.get("command_contains_any"):
        choices.append((min(map(len, d["command_contains_any"])), _contains("_cmd_l", d["command_contains_any"], "OR")))
    if d.get("command_regex") and (words := required(d["command_regex"])):
        # letters beyond ASCII may fold to ASCII ones
        choices.append((min(map(len, words)), f"(_wide OR {_contains('_cmd_l', sorted(words), 'OR')})"))
    return max(choices)[1] if choices else None


def _tested(rules: list[tuple[int, Rule]]) -> str:
    """The numbers of the rules that hold; rules of one guard are looked at only where it holds."""
    groups: dict[str | None, list[str]] = {}
    for k, r in rules:
        groups.setdefault(_guard(r), []).append(f"CASE WHEN {criteria_hold(r)} THEN {k} END")
    parts = [f"array({', '.join(hits)})" for g, hits in groups.items() if g is None]
    guarded = [f"CASE WHEN {g} THEN array({', '.join(hits)}) ELSE CAST(array() AS ARRAY<INT>) END" for g, hits in groups.items() if g is not None and len(hits) > 1]
    single = [f"CASE WHEN {g} THEN {hits[0]} END" for g, hits in groups.items() if g is not None and len(hits) == 1]
    parts += ([f"array({', '.join(single)})"] if single else []) + guarded
    return f"array_compact({parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'})"


def _by_name(named: list[tuple[str, str]]) -> str:
    """The value of the process name among ``named`` (name, value), by halving: each step is one look into a hash set."""
    if len(named) <= 4:
        return "CASE _proc " + " ".join(f"WHEN {literal(n)} THEN {v}" for n, v in named) + " ELSE CAST(array() AS ARRAY<INT>) END"
    half = len(named) // 2
    return f"CASE WHEN {_one_of('_proc', [n for n, _ in named[:half]])} THEN {_by_name(named[:half])} ELSE {_by_name(named[half:])} END"


def hit_numbers(rules: list[Rule]) -> Column:
    """The numbers of the rules that hold for an event.

    Only candidates are tested: rules of the event's platform, of those with a process name the ones for its
    name, and of rules that need a literal in the command line the ones whose literal is there.  Inside a higher-order function the
    predicates are evaluated one by one up to the first that fails; as generated code they make one method that is too
    large for the JVM to compile, which is many times slower.
    """
    cases = []
    for platform in sorted({r.platform for r in rules}):
        own = [(k, r) for k, r in enumerate(rules) if r.platform == platform]
        names: dict[str, list[tuple[int, Rule]]] = {}
        for k, r in own:
            if "process_name" in r.criteria:
                names.setdefault(basename(r.detection["process_name"], platform), []).append((k, r))
        parts = [_tested(rest)] if (rest := [(k, r) for k, r in own if "process_name" not in r.criteria]) else []
        if names:
            known = f"CASE WHEN {_one_of('_proc', sorted(names))} THEN {_by_name([(n, _tested(x)) for n, x in sorted(names.items())])} ELSE CAST(array() AS ARRAY<INT>) END"
            parts.append(known)
        cases.append(f"WHEN {literal(platform)} THEN {parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'}")
    return F.expr(f"transform(array(0), _ -> CASE platform {' '.join(cases)} END)[0]")


def stage_predicate(stage: Stage, platform: str, prefix: str = "") -> Column:
    """A chain stage over lineage nodes (name, cmd, user, is_phantom); names are normalised for the chain's platform.

    A phantom node has no command line or user and fails every criterion on them.
    """
    col = lambda c: F.col(prefix + c)
    name = process_basename(col("process_name"), F.lit(platform))
    cmd, out = F.coalesce(col("command_line"), F.lit("")), []
    for c, v in stage.match.items():
        if c == "process_name":
            out.append(name == basename(v, platform))
        elif c == "process_name_any":
            out.append(name.isin(*[basename(x, platform) for x in v]))
        else:
            seen = ~col("is_phantom")
            if c == "command_contains":
                test = reduce(and_, [F.lower(cmd).contains(x.lower()) for x in v])
            elif c == "command_contains_any":
                test = reduce(or_, [F.lower(cmd).contains(x.lower()) for x in v])
            elif c == "command_regex":
                test = cmd.rlike(FLAGS + v)
            else:
                test = F.coalesce(col("user"), F.lit("")).rlike(FLAGS + v)
            out.append(seen & test)
    return F.coalesce(reduce(and_, out), F.lit(False))
