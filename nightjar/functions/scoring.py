"""Severity, confidence and risk as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import anomalies as A

# Fixed values of the scoring formula.
SEVERITY = {"low": 25, "medium": 50, "high": 75, "critical": 100}
CRITERIA = {0: 0, 1: 5, 2: 16, 3: 25, 4: 30}
PARENT = {"missing_telemetry": 0, "suspicious_parent_match": 15, "anomalous_lineage": 8, "neutral_lineage": 0, "common_benign_lineage": -5}
USER = {"system_interactive_shell": 15, "non_admin_privileged_tool": 12, "unexpected_process_owner": 8, "unusual_user_baseline": 5, "neutral": 0, "missing_telemetry": 0}
WHITELIST = {"exact_match": -30, "high_similarity": -20, "moderate_similarity": -10, "no_match": 0, "not_evaluated": 0}
ADMIN = {"full_approved_context": -20, "three_conditions": -10, "two_conditions": -5, "not_admin_context": 0, "not_evaluated": 0}
BASE, VERSION, FORMULA = 35, 2, "severity_confidence_v2"
BANDS = ((120, "critical"), (90, "high"), (60, "medium"))
CHAIN_BASE, CHAIN_CONCRETE, CHAIN_STAGE = 70, 10, 5
READINGS = ((120, "Critical: Immediate action required"), (90, "High: Prioritize investigation"), (60, "Medium: Review when possible"), (30, "Low: Monitor for patterns"))
SYSTEM_USERS = ("SYSTEM", "NT AUTHORITY\\SYSTEM", "ROOT")


def lookup(name: Column, table: dict, default=0) -> Column:
    out = F.lit(default) if default is not None else F.lit(None)
    for k, v in table.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def severity_subscore(severity: Column) -> Column:
    """25 to 100; an unknown severity is an error."""
    s = F.lower(F.trim(severity))
    return F.coalesce(lookup(s, SEVERITY, None), F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(severity, F.lit("null")))).cast("int"))


def criteria_delta(n: Column) -> Column:
    return lookup(F.least(n, F.lit(4)), CRITERIA)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(*deltas: Column) -> Column:
    total = F.lit(BASE)
    for d in deltas:
        total = total + d
    return clamp(total, 0, 100).cast("int")


def score(severity: Column, conf: Column) -> Column:
    """severity x (0.25 + 0.75 x confidence / 100) x 1.5, rounded half up, from 0 to 150, in whole numbers."""
    return clamp(F.floor((severity * (F.lit(100) + conf * 3) * 3 + 400) / 800), 0, 150).cast("int")


def risk_band(points: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(points >= least, name).otherwise(out)
    return out


def interpret(points: Column) -> Column:
    out = F.lit("Informational: Low priority")
    for least, text in reversed(READINGS):
        out = F.when(points >= least, text).otherwise(out)
    return out


def partial_delta(semantics: Column, missing: Column, configured: Column, matched: Column, partially: Column) -> tuple[Column, Column]:
    """Penalty and reason of an incomplete match; ``configured`` and ``matched`` are counts, ``partially`` an array."""
    a = (semantics == "and") & missing
    b = (semantics == "or") & (configured >= 3) & (matched == 1)
    c = F.size(partially) > 0
    return F.when(a, -15).when(b, -8).when(c, -5).otherwise(0), F.when(a, "required_criteria_missing").when(b, "single_branch_of_broad_or").when(c, "criterion_partially_matched").otherwise("full_rule_match")


def _factor(name: str, delta: Column, reason: Column, evidence: dict[str, Column] | None = None) -> Column:
    values = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v)]
    proof = F.create_map(*values) if values else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), delta.cast("int").alias("delta"), reason.alias("reason"), proof.alias("evidence"))


def assess(severity: Column, configured: Column, matched: Column, parent_reason: Column, user_reason: Column, indicators: Column,
           whitelist_reason: Column | None = None, admin_reason: Column | None = None, semantics: Column | None = None,
           missing: Column | None = None, partially: Column | None = None, mitre: Column | None = None, explain: bool = True) -> dict[str, Column]:
    """The whole assessment from evidence columns: subscores, score, band and, with ``explain``, a breakdown.

    ``configured``, ``matched`` and ``partially`` are arrays of criteria names, ``indicators`` an array of anomaly names.
    """
    none = F.array().cast("array<string>")
    whitelist_reason = F.lit("no_match") if whitelist_reason is None else whitelist_reason
    admin_reason = F.lit("not_admin_context") if admin_reason is None else admin_reason
    semantics = F.lit("and") if semantics is None else semantics
    missing = F.lit(False) if missing is None else missing
    partially = none if partially is None else partially
    mitre = none if mitre is None else F.coalesce(mitre, none)
    configured, matched, partially, indicators = (F.array_sort(F.array_distinct(x)) for x in (configured, matched, partially, indicators))
    sub = severity_subscore(severity)
    n = F.size(matched)
    d_criteria, d_parent, d_user = criteria_delta(n), lookup(parent_reason, PARENT), lookup(user_reason, USER)
    d_anomaly, d_white = A.weight(indicators), lookup(whitelist_reason, WHITELIST)
    d_admin = F.when(d_user > 0, 0).otherwise(lookup(admin_reason, ADMIN))
    admin_text = F.when(d_user > 0, "not_applied_due_to_user_anomaly").otherwise(admin_reason)
    d_partial, partial_text = partial_delta(semantics, missing, F.size(configured), n, partially)
    deltas = (d_criteria, d_parent, d_user, d_anomaly, d_white, d_admin, d_partial)
    conf = confidence(*deltas)
    raw = F.lit(BASE)
    for d in deltas:
        raw = raw + d
    points = score(sub, conf)
    result = {"severity_subscore": sub.cast("int"), "confidence_subscore": conf, "score": points, "risk_band": risk_band(points), "scoring_version": F.lit(VERSION)}
    if not explain:
        return result
    factor = F.lit(0.25) + F.lit(0.75) * conf / 100.0
    text = lambda a: F.array_join(a, ",")
    factors = F.array(
        _factor("detection_criteria", d_criteria, F.concat(n.cast("string"), F.lit("_criteria_matched")), {"configured": text(configured), "matched": text(matched)}),
        _factor("parent_context", d_parent, parent_reason), _factor("user_context", d_user, user_reason),
        _factor("command_anomaly", d_anomaly, F.when(F.size(indicators) > 0, "command_anomalies_detected").otherwise("none_detected"),
                {"indicators": text(indicators), "uncapped_delta": A.weight(indicators, None).cast("string"), "cap": F.lit(str(A.CAP))}),
        _factor("whitelist_adjacency", d_white, whitelist_reason), _factor("admin_context", d_admin, admin_text),
        _factor("partial_match", d_partial, partial_text, {"partially_matched": text(partially)}),
    )
    breakdown = F.struct(
        F.struct(F.lower(F.trim(severity)).alias("rule_severity"), sub.alias("subscore"), mitre.alias("mitre_techniques"), F.lit(0).alias("mitre_contribution")).alias("severity"),
        F.struct(F.lit(BASE).alias("base"), raw.cast("int").alias("raw"), conf.alias("clamped"), factors.alias("factors")).alias("confidence"),
        F.struct(F.lit(FORMULA).alias("formula_version"), sub.alias("severity"), conf.alias("confidence"), F.round(factor, 6).alias("confidence_multiplier"),
                 F.lit(1.5).alias("scale"), F.round(sub * factor * 1.5, 6).alias("raw_score"), points.alias("rounded_score")).alias("combination"),
    )
    return result | {"score_breakdown": breakdown}


def simple_assess(severity: Column, configured: Column, command: Column, user: Column, parent: Column, rule_parent: Column) -> dict[str, Column]:
    """Assessment of a rule and an event alone: all criteria count as matched, the parent matches by substring, ROOT is no system user."""
    found = A.anomalies(command)
    bad = F.array_contains(found, "encoded_payload") | F.array_contains(found, "download_cradle")
    has = F.coalesce(parent, F.lit("")) != ""
    hit = has & (F.coalesce(rule_parent, F.lit("")) != "") & F.contains(F.lower(parent), F.lower(rule_parent))
    parent_reason = F.when(F.coalesce(hit, F.lit(False)), "suspicious_parent_match").when(has, "neutral_lineage").otherwise("missing_telemetry")
    user_reason = F.when(F.upper(F.coalesce(user, F.lit(""))).isin(*SYSTEM_USERS[:2]) & bad, "system_interactive_shell").otherwise("neutral")
    return assess(severity, configured, configured, parent_reason, user_reason, found)
