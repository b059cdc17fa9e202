"""Session settings of the command line and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC throughout; plans are built by many small calls, without a stack trace for each (a static setting, so it cannot be made later).
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(name: str = "nightjar") -> SparkSession.Builder:
    return SparkSession.builder.appName(name).config(map=SETTINGS)
