"""Formats alerts and incidents as CEF lines and ECS documents, and delivers lines."""

from __future__ import annotations

import socket
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VENDOR, PRODUCT, EXPORT_VERSION = "nightjar", "nightjar", "1"
# CEF severity of each risk band.
CEF_SEVERITY = {"critical": 10, "high": 8, "medium": 5, "low": 3}
ALERT_CSV = ["alert_id", "timestamp", "rule_id", "rule_name", "severity", "score", "platform", "process_name", "user", "command_line"]


def cef_header(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cef_value(text: Column) -> Column:
    out = text.cast("string")
    for a, b in (("\\", "\\\\"), ("=", "\\="), ("\n", " "), ("\r", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _present(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def _cef(sig: Column, name: Column, band: Column, fields: list[tuple[str, Column]]) -> Column:
    sev = F.lit(5)
    for k, v in CEF_SEVERITY.items():
        sev = F.when(F.coalesce(band, F.lit("low")) == k, v).otherwise(sev)
    head = F.concat(F.lit(f"CEF:0|{VENDOR}|{PRODUCT}|{EXPORT_VERSION}|"), cef_header(sig), F.lit("|"), cef_header(name), F.lit("|"), sev.cast("string"), F.lit("|"))
    parts = [F.when(_present(c).isNotNull(), F.concat(F.lit(k + "="), cef_value(c))) for k, c in fields]
    return F.concat(head, F.concat_ws(" ", *parts))


def _when_set(c: Column, label: str) -> Column:
    return F.when(_present(c).isNotNull(), F.lit(label))


def alert_fields(alerts: DataFrame) -> DataFrame:
    """Alerts with every exported field, missing ones empty. ``host`` is taken from the raw record's hostname or the host column."""
    have = set(alerts.columns)
    col = lambda n, d="": F.coalesce(F.col(n), F.lit(d)) if n in have else F.lit(d)
    raw_host = F.get_json_object("raw", "$.hostname") if "raw" in have else F.lit(None)
    none = F.array().cast("array<string>")
    return alerts.select(
        col("rule_id").alias("rule_id"), col("rule_name").alias("rule_name"), col("severity").alias("severity"), col("score", 0).alias("score"), col("risk_band", "low").alias("risk_band"),
        col("platform").alias("platform"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), col("process_name").alias("process_name"), col("command_line").alias("command_line"),
        col("user").alias("user"), col("parent_process_name").alias("parent_process_name"), F.coalesce(raw_host, F.lit("")).alias("hostname"),
        (F.coalesce("mitre_attack", none) if "mitre_attack" in have else none).alias("mitre_attack"), col("description").alias("description"),
    )


def incident_fields(incidents: DataFrame) -> DataFrame:
    chain = F.array_join(F.transform("stages", lambda s: F.coalesce(s["process_name"], F.lit("?"))), " -> ")
    t = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return incidents.select(
        "chain_id", "chain_name", "severity", "score", "risk_band", "confidence", "platform", "host", t("first_timestamp").alias("timestamp"), t("last_timestamp").alias("last_timestamp"),
        chain.alias("chain"), F.size("stages").alias("stage_count"), "mitre_attack", "description",
    )


def alerts_to_cef(alerts: DataFrame) -> DataFrame:
    """One column ``line``."""
    f = alert_fields(alerts)
    c = F.col
    fields = [
        ("rt", c("timestamp")), ("dvchost", c("hostname")), ("suser", c("user")), ("cs1", c("command_line")), ("cs1Label", _when_set(c("command_line"), "commandLine")), ("cat", F.lit("alert")),
        ("externalId", c("rule_id")), ("cn2", c("score")), ("cn2Label", F.lit("riskScore")), ("reason", F.array_join("mitre_attack", ",")), ("sproc", c("process_name")), ("sourceProcessName", c("parent_process_name")),
    ]
    return f.select(_cef(c("rule_id"), c("rule_name"), c("risk_band"), fields).alias("line"))


def incidents_to_cef(incidents: DataFrame) -> DataFrame:
    f = incident_fields(incidents)
    c = F.col
    fields = [
        ("rt", c("timestamp")), ("dvchost", c("host")), ("cat", F.lit("incident")), ("externalId", c("chain_id")), ("cn2", c("score")), ("cn2Label", F.lit("riskScore")), ("reason", F.array_join("mitre_attack", ",")),
        ("cs2", c("chain")), ("cs2Label", F.lit("processChain")), ("cn1", c("confidence")), ("cn1Label", F.lit("confidence")),
    ]
    return f.select(_cef(c("chain_id"), c("chain_name"), c("risk_band"), fields).alias("line"))


def _event(score: Column, kind: str, *more: Column) -> Column:
    return F.struct(F.lit("alert").alias("kind"), F.array(F.lit("process")).alias("category"), F.array(F.lit("info")).alias("type"), score.alias("risk_score"), score.alias("severity"), F.lit(f"{VENDOR}.{kind}").alias("dataset"), *more)


def _threat() -> Column:
    return F.when(F.size("mitre_attack") > 0, F.struct(F.struct(F.col("mitre_attack").alias("id")).alias("technique"))).alias("threat")


_OBSERVER = lambda: F.struct(F.lit(VENDOR).alias("vendor"), F.lit(PRODUCT).alias("product")).alias("observer")


def alerts_to_ecs(alerts: DataFrame) -> DataFrame:
    """One column ``line``: a compact JSON document; ``threat`` only where techniques are known."""
    f, c = alert_fields(alerts), F.col
    doc = F.struct(
        c("timestamp").alias("@timestamp"), _event(c("score"), "alert").alias("event"), F.struct(c("rule_id").alias("id"), c("rule_name").alias("name"), c("description").alias("description")).alias("rule"),
        F.struct(c("process_name").alias("name"), c("command_line").alias("command_line"), F.struct(c("parent_process_name").alias("name")).alias("parent")).alias("process"),
        F.struct(c("user").alias("name")).alias("user"), F.struct(c("hostname").alias("name")).alias("host"),
        F.struct(F.lit("alert").alias("kind"), c("severity").alias("severity"), c("risk_band").alias("risk_band")).alias(VENDOR), _threat(), _OBSERVER(),
    )
    return f.select(F.to_json(doc).alias("line"))


def incidents_to_ecs(incidents: DataFrame) -> DataFrame:
    f, c = incident_fields(incidents), F.col
    doc = F.struct(
        c("timestamp").alias("@timestamp"), _event(c("score"), "incident", c("last_timestamp").alias("end")).alias("event"), F.struct(c("chain_id").alias("id"), c("chain_name").alias("name"), c("description").alias("description")).alias("rule"),
        F.struct(c("host").alias("name")).alias("host"),
        F.struct(F.lit("incident").alias("kind"), c("confidence").alias("confidence"), c("risk_band").alias("risk_band"), c("chain").alias("process_chain"), c("stage_count").alias("stage_count")).alias(VENDOR), _threat(), _OBSERVER(),
    )
    return f.select(F.to_json(doc).alias("line"))


def format_records(df: DataFrame, fmt: str) -> DataFrame:
    """Lines of alerts or incidents (told apart by the column chain_id) as ``cef`` or ``json``."""
    incident = "chain_id" in df.columns
    forms = {"cef": (alerts_to_cef, incidents_to_cef), "json": (alerts_to_ecs, incidents_to_ecs)}
    if fmt.lower() not in forms:
        raise ValueError(f"unknown export format {fmt!r}: use 'cef' or 'json'")
    return forms[fmt.lower()][incident](df)


class LineSink:
    """Delivers lines from the executors, partition by partition; returns how many arrived."""

    def open(self) -> Callable[[str], bool]:
        """Called once per partition; returns a function that sends one line."""
        raise NotImplementedError

    def export(self, lines: DataFrame) -> int:
        def deliver(batches: Iterator) -> Iterator:
            import pyarrow as pa

            send, n = self.open(), 0
            for b in batches:
                n += sum(bool(send(x)) for x in b.column(0).to_pylist() if x is not None)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return lines.select("line").mapInArrow(deliver, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class TextSink(LineSink):
    """Appends lines as text files to a folder in any file system Spark writes to."""

    def __init__(self, path: str) -> None:
        self.path = path

    def export(self, lines: DataFrame) -> int:
        n = lines.count()
        lines.select(F.col("line").alias("value")).write.mode("append").text(self.path)
        return n


class StdoutSink(LineSink):
    """Prints lines on the driver, streaming one partition at a time."""

    def export(self, lines: DataFrame) -> int:
        n = 0
        for r in lines.select("line").toLocalIterator():
            print(r["line"])
            n += 1
        return n


class SyslogSink(LineSink):
    """UDP syslog; ``transport`` replaces the socket in tests."""

    def __init__(self, host: str = "127.0.0.1", port: int = 514, facility: int = 13, severity: int = 5, transport: Callable[[bytes], None] | None = None) -> None:
        self.to, self.priority, self.transport = (host, port), facility * 8 + severity, transport

    def open(self):
        sock = None if self.transport else socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        send = self.transport or (lambda data: sock.sendto(data, self.to))

        def emit(line: str) -> bool:
            try:
                send(f"<{self.priority}>{line}".encode())
                return True
            except OSError:
                return False

        return emit


class WebhookSink(LineSink):
    """HTTP POST with a fixed pause between attempts; any 2xx status is a success."""

    def __init__(self, url: str, retries: int = 3, pause: float = 0.5, timeout: float = 10, post: Callable[[str, bytes], int] | None = None) -> None:
        self.url, self.retries, self.pause, self.timeout, self.post = url, retries, pause, timeout, post

    def _send(self, url: str, body: bytes) -> int:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return r.status

    def open(self):
        post = self.post or self._send

        def emit(line: str) -> bool:
            for attempt in range(self.retries + 1):
                try:
                    if 200 <= post(self.url, line.encode()) < 300:
                        return True
                except OSError:
                    pass
                if attempt < self.retries:
                    time.sleep(self.pause)
            return False

        return emit


def build_sink(spec: dict) -> LineSink:
    """A sink from {'type': file | stdout | syslog | webhook, ...}."""
    kind, rest = spec.get("type"), {k: v for k, v in spec.items() if k != "type"}
    if kind == "file":
        return TextSink(rest["path"])
    if kind == "stdout":
        return StdoutSink()
    if kind == "syslog":
        return SyslogSink(**rest)
    if kind == "webhook":
        return WebhookSink(**rest)
    raise ValueError(f"unknown sink type {kind!r}")


#: Columns of the query report, in the order of its header.
REPORT_CSV = ("id", "timestamp", "severity", "score", "rule_id", "rule_name", "platform", "process_name", "user", "command_line", "mitre_attack", "description")


def report_rows(alerts: DataFrame) -> DataFrame:
    """Stored alerts with the columns of the query report."""
    have = set(alerts.columns)
    made = {"id": F.col("alert_id"), "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "mitre_attack": F.array_join("mitre_attack", ",")}
    return alerts.select(*[(made[c] if c in made else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in REPORT_CSV])


def write_alerts(alerts: DataFrame, path: str, fmt: str) -> None:
    """JSON lines of everything, or CSV of the report columns."""
    if fmt == "json":
        alerts.write.mode("overwrite").json(path)
    elif fmt == "csv":
        have = set(alerts.columns)
        rows = alerts.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        rows.select(*[F.col(c) if c in have or c == "timestamp" else F.lit(None).cast("string").alias(c) for c in ALERT_CSV]).write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'json' or 'csv'")


