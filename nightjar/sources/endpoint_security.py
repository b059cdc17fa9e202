"""macOS Endpoint Security exec events from NDJSON, as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_events, time_of_seconds, time_of_text
from ..storage import skipping


def es_time(text: Column) -> Column:
    """ISO time (also with Z) or epoch seconds; what cannot be read is the epoch."""
    return F.coalesce(time_of_seconds(text), time_of_text(text), F.timestamp_seconds(F.lit(0)))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "[^/]*$", 0)


def uid_name(uid: Column) -> Column:
    return F.when(uid == 0, "root").when(uid.isNotNull(), F.concat(F.lit("uid:"), uid.cast("string"))).otherwise("")


def events_from_lines(lines: DataFrame) -> DataFrame:
    """``lines``: one JSON object per row in ``value``; blank and broken lines and other event kinds are left out."""
    get = lambda p: F.get_json_object("value", "$." + p)
    first = lambda *ps: F.coalesce(*[F.nullif(get(p), F.lit("")) for p in ps])
    ok = F.try_parse_json("value").isNotNull() & get("event.exec").isNotNull()
    args = F.array_join(F.from_json(F.coalesce(F.nullif(get("event.exec.args"), F.lit("[]")), get("event.exec.target.args"), F.lit("[]")), "array<string>"), " ")
    num = lambda *ps: F.coalesce(*[get(p).try_cast("long") for p in ps])
    path = F.coalesce(first("event.exec.target.executable.path"), F.lit(""))
    uid = num("process.audit_token.euid", "process.audit_token.ruid", "process.audit_token.uid")
    rows = lines.where(F.trim("value") != "").where(ok).select("value", path.alias("path"), args.alias("args"), uid.alias("uid"), F.coalesce(first("time", "timestamp"), F.lit("")).alias("time"),
        F.coalesce(num("process.audit_token.pid", "process.pid"), F.lit(0)).alias("process_id"), num("process.ppid").alias("parent_process_id"), first("user").alias("named"),
        first("event.exec.cwd", "event.exec.script.cwd").alias("working_directory"), F.nullif(basename(get("process.executable.path")), F.lit("")).alias("parent_process_name"))
    rows = rows.where("path <> '' OR args <> ''")
    name = F.when(F.col("path") != "", basename(F.col("path"))).otherwise(F.get(F.split("args", " "), F.lit(0)))
    return as_events(rows.select(
        F.abs(F.xxhash64("value")).alias("event_id"), es_time(F.col("time")).alias("ts"), F.lit("macos").alias("platform"), name.alias("process_name"), F.when(F.col("args") != "", F.col("args")).otherwise(basename(F.col("path"))).alias("command_line"),
        F.coalesce("named", uid_name(F.col("uid"))).alias("user"), "process_id", "parent_process_name", "parent_process_id", "working_directory", F.col("value").alias("raw"),
    ))


def read(spark: SparkSession, path: str | list[str], skip_bad: bool = False) -> DataFrame:
    return events_from_lines(spark.read.options(**skipping(skip_bad)).text([path] if isinstance(path, str) else path))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's .ndjson, .json and .log files; those that cannot be read are skipped."""
    return read(spark, f"{folder.rstrip('/')}/*.{{ndjson,json,log}}", skip_bad=True)
