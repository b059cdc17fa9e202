"""Readers of process-event logs, one per platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import auditd, endpoint_security, sysmon

READERS = {"linux": auditd.read, "windows": sysmon.read_file, "macos": endpoint_security.read}
#: Of a folder only the files that are named like the platform's logs are read.
FOLDER_READERS = {"linux": auditd.read_folder, "windows": sysmon.read_folder, "macos": endpoint_security.read_folder}


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def read_events(spark: SparkSession, platform: str, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The events of a platform's logs between two times (both included)."""
    if platform not in READERS:
        raise ValueError(f"unknown platform {platform!r}")
    readers = FOLDER_READERS if is_folder(spark, path) else READERS
    events = readers[platform](spark, path)
    if start is not None:
        events = events.where(F.col("ts") >= start)
    return events.where(F.col("ts") <= end) if end is not None else events


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of several platforms' logs."""
    parts = [read_events(spark, platform, path) for platform, path in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
