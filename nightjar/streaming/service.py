"""One ingestion run over a growing log file: read, parse, detect, fold, correlate, move the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import lineage
from ..operators.detect import detect
from ..operators.episodes import with_fingerprints
from ..operators.store import Store
from ..rules.model import Chain, Rule
from ..sources import auditd, endpoint_security, sysmon
from .tail import CheckpointFile, hold_back, read_new


def _lines(spark: SparkSession, lines: list[str], source: str) -> DataFrame:
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "at long, value string")
    return rows.withColumn("file", F.lit(source))


def parse(spark: SparkSession, platform: str, text: str, source: str) -> tuple[DataFrame, int]:
    """Events of a text buffer and how many characters were consumed."""
    if platform == "windows":
        found, used = sysmon.split_buffer(text)
        return sysmon.events_from_xml(_lines(spark, found, source)), used
    rows = _lines(spark, text.split("\n"), source)
    return (auditd if platform == "linux" else endpoint_security).events_from_lines(rows), len(text)


class IngestionService:
    def __init__(self, spark: SparkSession, store: Store, checkpoints: CheckpointFile, rules: list[Rule], chains: list[Chain] = (), hours: int = 24) -> None:
        self.spark, self.store, self.checkpoints, self.rules, self.chains, self.hours = spark, store, checkpoints, rules, list(chains), hours

    def ingest_file(self, path: str, platform: str) -> dict:
        """Counts of one run; at-least-once: the checkpoint moves after everything is stored."""
        old = self.checkpoints.load(path)
        text, new = read_new(path, old)
        summary = {"source": path, "platform": platform, "events": 0, "alerts": {"new": 0, "duplicate": 0, "suppressed": 0}, "incidents": 0, "offset": new.offset}
        if text:
            events, used = parse(self.spark, platform, text, path)
            new = hold_back(text, new, used)
            summary["events"], summary["offset"] = events.count(), new.offset
            if summary["events"]:
                summary["alerts"] = self.store.save_episodes("alerts", with_fingerprints(detect(events, self.rules)), self.hours)
                if self.chains:
                    added = self.store.insert_absent("incidents", C.incidents(lineage.build(events), self.chains), "fingerprint")
                    summary["incidents"] = added.where("NOT is_duplicate").count()
        self.checkpoints.save(new)
        return summary
