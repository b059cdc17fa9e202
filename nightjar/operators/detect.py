"""Detection: events against compiled rules, scored alerts.

All rules are one projection: each event gets an array with the numbers of the
rules that hold for it, empty for nearly all events, which is exploded.  Only the
rules of the event's platform are looked at.  Nothing is shuffled, no event is
sent to Python, and the costlier assessment runs only on the rows that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as S
from ..functions.anomalies import anomalies
from ..plans.compile import PREPARED, hit_numbers, prepare
from ..rules.model import Rule

_RULE = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("rule_id", "rule_name", "rule_platform", "severity", "description")]
    + [T.StructField(n, T.ArrayType(T.StringType(), False), False) for n in ("mitre_attack", "response", "criteria")]
    + [T.StructField(n, t, False) for n, t in (("has_parent", T.BooleanType()), ("semantics", T.StringType()), ("rule_no", T.IntegerType()))]
)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table (as many rows as rules)."""
    rows = [(r.id, r.name, r.platform, r.severity, r.description, list(r.mitre_attack), list(r.response), list(r.criteria), bool(r.detection.get("parent_process")), "or" if r.detection.get("command_contains_any") else "and", k) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, _RULE)


def matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per event and rule that holds: the event's columns and ``rule_no``."""
    ready = prepare(events)
    if not rules:
        return ready.where(F.lit(False)).withColumn("rule_no", F.lit(0))
    return ready.select("*", F.explode(hit_numbers(rules)).alias("rule_no"))


def matched_rules(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``matches`` with the rules' columns."""
    return matches(events, rules).join(F.broadcast(rules_table(events.sparkSession, rules)), "rule_no")  # as many rows as rules


def detect(events: DataFrame, rules: list[Rule], explain: bool = True) -> DataFrame:
    """Scored alerts: event columns, rule columns, scores and, unless ``explain`` is off, the breakdown of the scores."""
    found = matched_rules(events, rules)
    has_parent = F.coalesce(F.col("parent_process_name"), F.lit("")) != ""
    parent = F.when(~has_parent, "missing_telemetry").when(F.col("has_parent"), "suspicious_parent_match").otherwise("neutral_lineage")
    found = found.withColumn("anomalies", anomalies(F.col("_cmd")))
    bad = F.array_contains("anomalies", "encoded_payload") | F.array_contains("anomalies", "download_cradle")
    user = F.when(F.upper("_user").isin(*S.SYSTEM_USERS) & bad, "system_interactive_shell").otherwise("neutral")
    result = S.assess(F.col("severity"), F.col("criteria"), F.col("criteria"), parent, user, F.col("anomalies"), semantics=F.lit("and"), mitre=F.col("mitre_attack"), explain=explain)
    return found.select("*", *[c.alias(n) for n, c in result.items()]).drop("rule_no", "rule_platform", "has_parent", *PREPARED)
