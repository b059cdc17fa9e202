"""Command line: scan logs, ingest folders, query and export stored alerts and incidents, triage, list rules."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alerts as Q
from .operators import chains as C
from .operators import lineage
from .operators.detect import detect
from .operators.episodes import STATES, with_fingerprints
from .operators.store import Store
from .rules.builtin import CHAINS, RULES
from .rules.model import load_chains, load_rules
from .schema import PLATFORMS, SEVERITIES
from .session import builder
from .sinks.export import REPORT_CSV, format_records, report_rows, write_alerts
from .sources import read_events
from .sources.paths import SourceError, check_source
from .storage import materialize

ALERT_TABLE = ["alert_id", "ts", "rule_id", "severity", "score", "process_name", "occurrence_count"]
INCIDENT_TABLE = ["fingerprint", "chain_id", "severity", "score", "host", "first_timestamp"]


def _session() -> SparkSession:
    return builder().getOrCreate()


def table(df: DataFrame, columns: list[str], limit: int = 20) -> str:
    """A plain text table of at most ``limit`` rows."""
    rows = [[str(v) if v is not None else "-" for v in r] for r in df.select(*columns).limit(limit).collect()]
    width = [min(40, max(len(x) for x in col)) for col in zip(columns, *rows)]
    cut = lambda x, w: (x if len(x) <= w else x[: w - 3] + "...").ljust(w)
    return "\n".join("  ".join(cut(x, w) for x, w in zip(r, width)).rstrip() for r in [columns, ["-" * w for w in width], *rows])


def _stream(df: DataFrame) -> Iterator[dict]:
    """Rows in order, one partition at a time, as JSON objects."""
    return (json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator())


def show(df: DataFrame, fmt: str, columns: list[str], verbose: bool, rows: int) -> None:
    """Print alerts or incidents as a table, JSON or CSV."""
    if fmt == "json":
        print("[")
        for k, r in enumerate(_stream(df)):
            print(("," if k else "") + json.dumps(r))
        print("]")
    elif fmt == "csv":
        out = csv.DictWriter(sys.stdout, fieldnames=REPORT_CSV if "alert_id" in df.columns else columns, extrasaction="ignore")
        out.writeheader()
        out.writerows(_stream(report_rows(df) if "alert_id" in df.columns else df.select(*columns)))
    elif verbose:
        for r in _stream(df):
            print("\n".join(f"{k}: {v}" for k, v in r.items()), end="\n\n")
    else:
        print(table(df, columns, rows))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nightjar")
    p.add_argument("--store", default="nightjar-store")
    p.add_argument("--rules", help="a folder of rules instead of the built-in ones")
    p.add_argument("--chains", help="a folder of chains instead of the built-in ones")
    sub = p.add_subparsers(dest="action", required=True)

    def filters(s: argparse.ArgumentParser) -> argparse.ArgumentParser:
        s.add_argument("--severity", choices=SEVERITIES), s.add_argument("--platform", choices=PLATFORMS), s.add_argument("--min-score", type=int)
        s.add_argument("--limit", type=int, default=50, help="rows at most, 0 for all")
        return s

    s = sub.add_parser("scan", help="detect in logs")
    s.add_argument("platform", choices=PLATFORMS), s.add_argument("source"), s.add_argument("--allow", action="append", help="a folder that sources must lie in")
    s.add_argument("--save", action="store_true"), s.add_argument("--correlate", action="store_true"), s.add_argument("--output"), s.add_argument("--format", choices=("json", "csv"), default="json")
    s = sub.add_parser("ingest", help="read the new log files of a folder into the store")
    s.add_argument("platform", choices=PLATFORMS), s.add_argument("folder"), s.add_argument("--checkpoint")
    s = filters(sub.add_parser("alerts", help="query stored alerts"))
    s.add_argument("--rule-id"), s.add_argument("--last"), s.add_argument("--format", choices=("table", "json", "csv"), default="table")
    s.add_argument("--verbose", action="store_true"), s.add_argument("--no-summary", action="store_true"), s.add_argument("--summary", action="store_true", help="only the summary")
    s = filters(sub.add_parser("incidents", help="query stored incidents"))
    s.add_argument("--chain-id"), s.add_argument("--format", choices=("table", "json", "csv"), default="table"), s.add_argument("--verbose", action="store_true")
    s = filters(sub.add_parser("export", help="print stored records for another system"))
    s.add_argument("--type", choices=("alerts", "incidents"), default="alerts"), s.add_argument("--format", choices=("json", "cef"), default="json")
    s = sub.add_parser("state", help="change an alert's state")
    s.add_argument("alert_id"), s.add_argument("state", choices=STATES), s.add_argument("--author", required=True), s.add_argument("--reason", default="")
    s = sub.add_parser("suppress", help="suppress an activity")
    s.add_argument("fingerprint"), s.add_argument("--scope", choices=("global", "host"), default="global"), s.add_argument("--host"), s.add_argument("--author", required=True), s.add_argument("--reason", required=True), s.add_argument("--hours", type=int, default=24)
    sub.add_parser("rules", help="list the rules")
    return p


def _fail(message: object) -> int:
    print(f"error: {message}", file=sys.stderr)
    return 1


def _scan(a: argparse.Namespace, spark: SparkSession, store: Store, rules: list, chains: list) -> int:
    events = materialize(read_events(spark, a.platform, check_source(a.source, a.platform, a.allow)), "events")
    found = materialize(detect(events, rules), "alerts")
    print(table(Q.display_order(found, 20), ["rule_id", "severity", "score", "process_name", "command_line"]))
    incidents = materialize(C.incidents(lineage.build(events), chains), "incidents") if a.correlate else None
    if incidents is not None:
        print(table(C.in_report_order(incidents), ["chain_id", "host", "score", "first_timestamp"]))
    if a.save:
        alerts = with_fingerprints(found)

        def change(tx):
            if incidents is not None:
                tx.insert_absent("incidents", incidents, "fingerprint")
            return tx.save_episodes("alerts", alerts)

        print(json.dumps(store.transact(change)))
    if a.output:
        write_alerts(found, a.output, a.format)
    return 0


def _alerts(a: argparse.Namespace, df: DataFrame) -> int:
    df = df.withColumn("event_id", F.col("first_event_id"))
    start = F.lit(datetime.now(UTC) - Q.parse_timeframe(a.last)) if a.last else None
    found = Q.newest(Q.filter_all(Q.in_time(df, start), a.severity, a.platform, a.min_score), a.limit)
    if a.rule_id:  # of the newest ones, as the limit comes first
        found = found.where(F.col("rule_id") == a.rule_id)
    if not a.summary:
        show(found, a.format, ALERT_TABLE, a.verbose, a.limit or 2**31 - 1)
    if a.summary or (a.format == "table" and not a.no_summary):
        for part in (Q.share_by(found, "severity"), Q.share_by(found, "platform"), Q.score_summary(found), Q.top_rules(found)):
            print("\n" + table(part, part.columns))
    return 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    rules, chains = load_rules(a.rules) if a.rules else RULES, load_chains(a.chains) if a.chains else CHAINS
    if a.action == "rules":
        for r in rules:
            print(f"{r.id}  {r.platform:8} {r.severity:9} {r.name}")
        return 0
    spark = _session()
    store = Store(spark, a.store)
    try:
        if a.action == "scan":
            return _scan(a, spark, store, rules, chains)
        if a.action == "ingest":
            from .streaming.ingest import ingest_logs

            print(json.dumps({"batches": ingest_logs(spark, store, a.platform, a.folder, a.checkpoint or f"{a.store}/_ingest/{a.platform}", rules, chains)}))
            return 0
        if a.action == "state":
            return 0 if store.set_state("alerts", a.alert_id, a.state, a.author, a.reason) else _fail("no such alert")
        if a.action == "suppress":
            print(json.dumps({"id": store.add_suppression(a.fingerprint, a.scope, a.host, a.author, a.reason, a.hours)}))
            return 0
        df = store.read("incidents" if a.action == "incidents" else getattr(a, "type", "alerts"))
        if df is None:
            return _fail("nothing is stored")
        if a.action == "alerts":
            return _alerts(a, df)
        if a.action == "incidents":
            show(Q.get_incidents(df, a.chain_id, a.severity, a.platform, a.min_score, a.limit), a.format, INCIDENT_TABLE, a.verbose, a.limit or 2**31 - 1)
            return 0
        by, tie = ("ts", "first_event_id") if a.type == "alerts" else ("first_timestamp", "fingerprint")
        for r in format_records(Q.export_selection(df, a.severity, a.platform, a.min_score, a.limit, tie, by), a.format).toLocalIterator():
            print(r["line"])
        return 0
    except (ValueError, SourceError) as e:
        return _fail(e)


if __name__ == "__main__":
    sys.exit(main())
