"""Queries and statistics over stored alerts and incidents."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
BANDS = (("0-50", 0, 50), ("51-100", 51, 100), ("101-150", 101, 150))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def newest(df: DataFrame, limit: int | None = 100, by: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest first; a limit of 0 or None means all."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return ordered.limit(limit) if limit else ordered


def page_after(df: DataFrame, size: int, after: tuple[str | None, str] | None = None, by: str = "ts", tie: str = "alert_id") -> DataFrame:
    """The next ``size`` rows, newest first, behind the row with time and tie ``after`` (from the start, if not given).

    A page begins where the last one ended, by a comparison that the scan can prune with, so page 1000 costs what page 1 does
    and any number of rows can be reached.  Rows without a time come last.
    """
    if after is not None:
        at, mark = F.lit(after[0]).cast("timestamp"), F.col(tie) < F.lit(after[1])
        older = F.col(by).isNull() & mark if after[0] is None else (F.col(by) < at) | ((F.col(by) == at) & mark) | F.col(by).isNull()
        df = df.where(older)
    return newest(df, size, by, tie)


def in_time(df: DataFrame, start: Column | None = None, end: Column | None = None, by: str = "ts") -> DataFrame:
    """Rows between two times, both included."""
    if start is not None:
        df = df.where(F.col(by) >= start)
    return df.where(F.col(by) <= end) if end is not None else df


def get_alerts(alerts: DataFrame, start: Column | None = None, end: Column | None = None, limit: int | None = 100) -> DataFrame:
    return newest(in_time(alerts, start, end), limit)


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return newest(alerts.where(F.col("severity") == severity), None)


def by_platform(alerts: DataFrame, platform: str) -> DataFrame:
    return newest(alerts.where(F.col("platform") == platform), None)


def high_scores(alerts: DataFrame, least: int = 100) -> DataFrame:
    return alerts.where(F.col("score") >= least).orderBy(F.desc("score"), F.col("ts").desc_nulls_last(), F.desc("event_id"))


def query_first_filter(alerts: DataFrame, severity: str | None = None, platform: str | None = None, min_score: int | None = None, start: Column | None = None, end: Column | None = None, limit: int = 100) -> DataFrame:
    """The service's filter order: the first of severity, platform and score that is given decides alone and ignores the limit."""
    if severity:
        return by_severity(alerts, severity)
    if platform:
        return by_platform(alerts, platform)
    if min_score is not None:
        return high_scores(alerts, min_score)
    return get_alerts(alerts, start, end, limit)


def filter_all(df: DataFrame, severity: str | None = None, platform: str | None = None, min_score: int | None = None, rule_id: str | None = None) -> DataFrame:
    """All given filters together (command line, dashboard)."""
    for column, value in (("severity", severity), ("platform", platform), ("rule_id", rule_id)):
        if value:
            df = df.where(F.col(column) == value)
    return df.where(F.col("score") >= min_score) if min_score is not None else df


def export_selection(df: DataFrame, severity: str | None = None, platform: str | None = None, min_score: int | None = None, limit: int = 1000, tie: str = "event_id", by: str = "ts") -> DataFrame:
    """The newest ``limit`` rows first, and of these the ones that pass the filters."""
    return filter_all(newest(df, limit, by, tie), severity, platform, min_score)


def find_alert(alerts: DataFrame, alert_id: str, among: int = 10_000) -> DataFrame:
    """The alert with an id, among the newest ``among``."""
    return newest(alerts, among).where(F.col("alert_id") == alert_id)


def get_incidents(incidents: DataFrame, chain_id: str | None = None, severity: str | None = None, platform: str | None = None, min_score: int | None = None, limit: int | None = 100) -> DataFrame:
    if chain_id:
        incidents = incidents.where(F.col("chain_id") == chain_id)
    found = filter_all(incidents, severity, platform, min_score).orderBy(F.col("first_timestamp").desc_nulls_last(), F.desc("fingerprint"))
    return found.limit(limit) if limit else found


def page(df: DataFrame, number: int, size: int = 10, by: str = "ts") -> DataFrame:
    """A page of alerts, most severe and newest first (pages count from 1)."""
    return df.orderBy(severity_rank(F.col("severity")).desc(), F.col(by).desc_nulls_last(), F.desc("event_id")).offset((number - 1) * size).limit(size)


def display_order(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(severity_rank(F.col("severity")).desc(), F.col("ts").desc_nulls_last(), F.desc("event_id")).limit(limit)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame) -> DataFrame:
    """One row: how many scores lie in each band; zeros for no rows."""
    return df.agg(*[F.coalesce(F.sum(F.when(F.col("score").between(a, b), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"score_{a}_{b}") for _, a, b in BANDS])


def recent_count(df: DataFrame, now: Column, hours: int = 24, by: str = "ts") -> DataFrame:
    return df.agg(F.count_if(F.col(by) >= now - F.make_dt_interval(hours=F.lit(hours))).alias("n"))


def alert_stats(df: DataFrame, now: Column) -> DataFrame:
    """Total, bands and last-day count in one pass."""
    parts = [F.coalesce(F.sum(F.when(F.col("score").between(a, b), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"score_{a}_{b}") for _, a, b in BANDS]
    return df.agg(F.count(F.lit(1)).alias("total"), *parts, F.count_if(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(24))).alias("last_24h"))


def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count_distinct("process_name").alias("unique_processes"), F.count_distinct("user").alias("unique_users"))


def share_by(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values; severities in their own order, others sorted."""
    total = F.sum("n").over(Window.partitionBy())
    rows = count_by(df, column).select(column, "n", F.round(F.lit(100.0) * F.col("n") / total, 1).alias("percent"))
    return rows.orderBy(severity_rank(F.col(column)).desc(), column) if column == "severity" else rows.orderBy(column)


def top_rules(df: DataFrame, n: int = 5) -> DataFrame:
    return df.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def score_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return count_by(outcomes, "outcome")


def parse_timeframe(text: str) -> timedelta:
    """'24h', '7d', '2w' or '3m' (months of 30 days)."""
    m = re.fullmatch(r"([0-9]+)([hdwm])", text.strip().lower())
    if not m:
        raise ValueError(f"not a time frame: {text!r} (use e.g. 24h, 7d, 2w, 1m)")
    n = int(m[1])
    return {"h": timedelta(hours=n), "d": timedelta(days=n), "w": timedelta(weeks=n), "m": timedelta(days=30 * n)}[m[2]]

