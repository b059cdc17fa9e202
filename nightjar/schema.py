"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLATFORMS = ("windows", "linux", "macos")
SEVERITIES = ("low", "medium", "high", "critical")

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("platform", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("command_line", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("process_id", T.LongType()),
        T.StructField("parent_process_name", T.StringType()),
        T.StructField("parent_process_id", T.LongType()),
        T.StructField("working_directory", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("host", T.StringType()),
    ]
)
EVENT_COLUMNS = [f.name for f in EVENT]


def as_events(df: DataFrame) -> DataFrame:
    """``df`` with the columns of EVENT in order: missing ones null, required text empty instead of null."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in ("platform", "process_name", "command_line", "user", "host"):
            c = F.coalesce(c, F.lit(""))
        return c.alias(f.name)

    return df.select(*[column(f) for f in EVENT])


def time_of_seconds(text: Column) -> Column:
    """The time of epoch seconds (a number with up to six digits behind the point); null for any other text and beyond the year 9999."""
    seconds = text.try_cast("decimal(38,6)")
    return F.when((seconds >= -62_135_596_800) & (seconds < 253_402_300_800), F.timestamp_micros((seconds * 1_000_000).try_cast("long")))


def time_of_text(text: Column) -> Column:
    """A written time; null for any other text and outside the years 1 to 9999."""
    ts = text.try_cast("timestamp")
    return F.when((ts >= F.lit("0001-01-01").cast("timestamp")) & (ts < F.lit("9999-12-31 23:59:59").cast("timestamp")), ts)


def event_struct() -> Column:
    return F.struct(*[F.col(c) for c in EVENT_COLUMNS])
