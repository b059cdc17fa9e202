"""The service facade: what a REST layer or a command line calls, over the stored tables.

``Service.handle`` routes (method, path) with a key's scope and answers with a
status and a JSON payload, so any HTTP server can front it; ``serve`` uses the
standard library's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .auth import KeyStore
from .operators import alerts as Q
from .operators import chains as C
from .operators import lineage
from .operators.detect import detect
from .operators.episodes import with_fingerprints
from .operators.store import Store, Transaction
from .rules.model import Chain, Rule
from .schema import PLATFORMS, SEVERITIES
from .sinks import export
from .sources import read_events
from .sources.paths import SourceError, check_source
from .storage import materialize
from .streaming.service import IngestionService
from .streaming.tail import CheckpointFile

MAX_LIMIT = 10_000


class BadRequest(ValueError):
    status = 400


class NotFound(LookupError):
    status = 404


def _rows(df: DataFrame | None, limit: int = MAX_LIMIT) -> list[dict]:
    """Rows of one answer; an answer never holds more than ``limit``."""
    return [] if df is None else [json.loads(r["j"]) for r in df.limit(limit).select(F.to_json(F.struct("*")).alias("j")).collect()]


def _choice(value, known, name: str):
    if value and value not in known:
        raise BadRequest(f"unknown {name} {value!r}")
    return value


def _int(value, name: str, least: int = 0):
    if value is None:
        return None
    try:
        n = int(value)
    except (TypeError, ValueError):
        raise BadRequest(f"{name} must be a whole number") from None
    if n < least:
        raise BadRequest(f"{name} must be {least} at least")
    return n


def _time(value, name: str):
    if not value:
        return None
    try:
        return F.lit(datetime.fromisoformat(value))
    except ValueError:
        raise BadRequest(f"{name} must be an ISO time") from None


def _page(df: DataFrame, q: dict, by: str, tie: str) -> tuple[DataFrame, int]:
    """The page that a request with ``after`` asks for: all filters together, newest first."""
    found = Q.filter_all(df, _choice(q.get("severity"), SEVERITIES, "severity"), _choice(q.get("platform"), PLATFORMS, "platform"), _int(q.get("min_score"), "min_score"))
    size, after = min(_int(q.get("limit"), "limit", 1) or 100, MAX_LIMIT), None
    if q["after"] != "start":
        time, mark, key = q["after"].partition("|")
        if not mark or (time and _time(time, "after") is None):
            raise BadRequest("after is 'start' or the 'next' of another answer")
        after = (time or None, key)
    return Q.page_after(found, size, after, by, tie).withColumn("_next", F.concat(F.coalesce(F.date_format(by, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), F.lit("|"), F.col(tie))), size


def _answer(name: str, rows: list[dict], size: int) -> dict:
    """A page with the ``next`` to ask for; without one it is the last."""
    marks = [r.pop("_next") for r in rows]
    return {name: rows, "count": len(rows)} | ({"next": marks[-1]} if len(rows) == size else {})


class Service:
    def __init__(self, spark: SparkSession, store: Store, rules: list[Rule], chains: list[Chain] = (), keys: KeyStore | None = None, allowed: list[str] | None = None, checkpoints: str | None = None, hours: int = 24) -> None:
        self.spark, self.store, self.rules, self.chains, self.keys, self.allowed, self.hours = spark, store, rules, list(chains), keys, allowed, hours
        self.checkpoints = CheckpointFile(checkpoints) if checkpoints else None
        self.routes: dict[tuple[str, str], tuple[str | None, Callable]] = {
            ("GET", "health"): (None, lambda q, b: {"status": "ok"}),
            ("GET", "alerts"): ("read", self.alerts),
            ("GET", "alerts/*"): ("read", self.alert),
            ("GET", "export"): ("read", self.export),
            ("GET", "stats"): ("read", self.stats),
            ("GET", "rules"): ("read", self.rule_list),
            ("GET", "incidents"): ("read", self.incidents),
            ("POST", "scan"): ("scan", self.scan),
            ("POST", "ingest"): ("scan", self.ingest),
            ("POST", "alerts/*/state"): ("admin", self.set_state),
            ("POST", "suppressions"): ("admin", self.add_suppression),
        }

    # ---- reading

    def alerts(self, q: dict, _=None) -> dict:
        df = self.store.read("alerts")
        if df is None:
            return {"alerts": [], "count": 0}
        df = df.withColumn("event_id", F.col("first_event_id"))
        if "after" in q:
            found, size = _page(df, q, "ts", "alert_id")
            return _answer("alerts", _rows(found), size)
        limit = _int(q.get("limit"), "limit", 1) or 100
        found = Q.query_first_filter(df, _choice(q.get("severity"), SEVERITIES, "severity"), _choice(q.get("platform"), PLATFORMS, "platform"), _int(q.get("min_score"), "min_score"), _time(q.get("start_time"), "start_time"), _time(q.get("end_time"), "end_time"), min(limit, MAX_LIMIT))
        rows = _rows(found)
        return {"alerts": rows, "count": len(rows)}

    def alert(self, q: dict, _=None) -> dict:
        df = self.store.read("alerts")
        rows = [] if df is None else _rows(Q.find_alert(df.withColumn("event_id", F.col("first_event_id")), q["id"]))
        if not rows:
            raise NotFound("no such alert")
        return rows[0]

    def export(self, q: dict, _=None) -> dict:
        kind, fmt = q.get("type", "alerts"), q.get("format", "json")
        if kind not in ("alerts", "incidents") or fmt not in ("json", "cef"):
            raise BadRequest("type is alerts or incidents, format is json or cef")
        df = self.store.read(kind)
        if df is None:
            return {"format": fmt, "lines": [], "count": 0}
        if "after" in q:
            found, size = _page(df, q, *(("ts", "alert_id") if kind == "alerts" else ("first_timestamp", "fingerprint")))
            rows = materialize(found, "page")  # formatted and marked from the same rows
            marks = [r["_next"] for r in rows.select("_next").orderBy("_next").head(1)]
            lines = [r["line"] for r in export.format_records(rows.drop("_next"), fmt).collect()]
            return {"format": fmt, "lines": lines, "count": len(lines)} | ({"next": marks[0]} if len(lines) == size else {})
        by, tie = ("ts", "first_event_id") if kind == "alerts" else ("first_timestamp", "fingerprint")
        chosen = Q.export_selection(df, q.get("severity"), q.get("platform"), _int(q.get("min_score"), "min_score"), min(_int(q.get("limit"), "limit", 1) or 1000, MAX_LIMIT), tie, by)
        lines = [r["line"] for r in export.format_records(chosen, fmt).collect()]
        return {"format": fmt, "lines": lines, "count": len(lines)}

    def stats(self, q: dict | None = None, _=None) -> dict:
        df = self.store.read("alerts")
        if df is None:
            return {"total_alerts": 0, "by_severity": {}, "by_platform": {}, "scores": {}, "last_24h": 0}
        one = Q.alert_stats(df, F.current_timestamp()).first().asDict()
        groups = {c: {r[c]: r["n"] for r in Q.count_by(df, c).collect()} for c in ("severity", "platform")}
        return {"total_alerts": one.pop("total"), "last_24h": one.pop("last_24h"), "scores": one, "by_severity": groups["severity"], "by_platform": groups["platform"]}

    def rule_list(self, q: dict | None = None, _=None) -> dict:
        count = lambda f: {k: sum(getattr(r, f) == k for r in self.rules) for k in sorted({getattr(r, f) for r in self.rules})}
        return {"rules": [r.to_dict() for r in self.rules], "count": len(self.rules), "by_severity": count("severity"), "by_platform": count("platform")}

    def incidents(self, q: dict, _=None) -> dict:
        df = self.store.read("incidents")
        if df is not None and "after" in q:
            found, size = _page(df if not q.get("chain_id") else df.where(F.col("chain_id") == q["chain_id"]), q, "first_timestamp", "fingerprint")
            return _answer("incidents", _rows(found), size)
        rows = [] if df is None else _rows(Q.get_incidents(df, q.get("chain_id"), _choice(q.get("severity"), SEVERITIES, "severity"), _choice(q.get("platform"), PLATFORMS, "platform"), _int(q.get("min_score"), "min_score"), min(_int(q.get("limit"), "limit", 1) or 100, MAX_LIMIT)))
        return {"incidents": rows, "count": len(rows)}

    # ---- writing

    def _source(self, body: dict) -> tuple[str, str]:
        platform = _choice(body.get("platform"), PLATFORMS, "platform")
        if not platform or not isinstance(body.get("source") or body.get("log_path"), str):
            raise BadRequest("platform and source are needed")
        try:
            return platform, check_source(body.get("source") or body.get("log_path"), platform, self.allowed)
        except SourceError as e:
            raise BadRequest(str(e)) from e

    def scan(self, q: dict, body: dict) -> dict:
        platform, path = self._source(body)
        events = materialize(read_events(self.spark, platform, path, _time(body.get("start_time"), "start_time"), _time(body.get("end_time"), "end_time")), "events")
        n, fresh, saved = events.count(), 0, {"new": 0, "duplicate": 0, "suppressed": 0}
        if n:
            alerts = materialize(with_fingerprints(detect(events, self.rules)), "alerts")
            incidents = materialize(C.incidents(lineage.build(events), self.chains), "incidents") if self.chains else None

            def change(tx: Transaction) -> tuple[dict, int]:
                saved = tx.save_episodes("alerts", alerts, self.hours)
                return saved, tx.insert_absent("incidents", incidents, "fingerprint").where("NOT is_duplicate").count() if incidents is not None else 0

            saved, fresh = self.store.transact(change)
        return {"events_scanned": n, "alerts": saved, "incidents_new": fresh}

    def ingest(self, q: dict, body: dict) -> dict:
        if self.checkpoints is None:
            raise BadRequest("ingestion is not configured")
        platform, path = self._source(body)
        return IngestionService(self.spark, self.store, self.checkpoints, self.rules, self.chains, self.hours).ingest_file(path, platform)

    def set_state(self, q: dict, body: dict) -> dict:
        if not body.get("state") or not body.get("author"):
            raise BadRequest("state and author are needed")
        try:
            found = self.store.set_state("alerts", q["id"], body["state"], body["author"], body.get("reason") or "")
        except ValueError as e:
            raise BadRequest(str(e)) from e
        if not found:
            raise NotFound("no such alert")
        return {"id": q["id"], "state": body["state"]}

    def add_suppression(self, q: dict, body: dict) -> dict:
        if lost := [k for k in ("fingerprint", "scope", "author", "reason") if not body.get(k)]:
            raise BadRequest(f"missing {', '.join(lost)}")
        try:
            n = self.store.add_suppression(body["fingerprint"], body["scope"], body.get("scope_value"), body["author"], body["reason"], _int(body.get("duration_hours", 24), "duration_hours", 1))
        except ValueError as e:
            raise BadRequest(str(e)) from e
        return {"id": n}

    # ---- routing

    def handle(self, method: str, path: str, body: dict | None = None, authorization: str | None = None) -> tuple[int, dict]:
        """(status, payload) of a request to ``/api/...``."""
        url = urlsplit(path)
        parts = url.path.strip("/").split("/")
        parts = parts[1:] if parts[:1] == ["api"] else parts
        query = dict(parse_qsl(url.query))
        for (m, route), (scope, f) in self.routes.items():
            names = route.split("/")
            if m != method or len(names) != len(parts) or any(a not in ("*", b) for a, b in zip(names, parts)):
                continue
            if "*" in names:
                query["id"] = parts[names.index("*")]
            try:
                if scope and self.keys is not None:
                    self.keys.require(authorization, scope)
                return 200, f(query, body or {})
            except (PermissionError, BadRequest, NotFound) as e:
                return e.status, {"error": str(e)}
        return 404, {"error": "no such route"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server over ``handle``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(n) or b"{}") if n <= 1 << 20 else None
            except ValueError:
                body = None
            status, payload = service.handle(method, self.path, body, self.headers.get("Authorization")) if isinstance(body, dict) else (400, {"error": "a JSON object is needed"})
            data = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
