"""Linux auditd logs as events.

Records are the lines of one audit id in one file; of each record type the last
line counts, and a record without EXECVE is no event, nor is one without a time or
an argument.  Whatever else a line holds, it ends no job: numbers that are none or
too large count as missing.  Of a folder, files that cannot be read are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_events, time_of_seconds
from ..storage import bounded, skipping

_KINDS = ("EXECVE", "SYSCALL", "CWD")


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def arguments(execve: Column) -> Column:
    """The command line of an EXECVE record: those of its first argc arguments that are there, in order, quoted or bare.

    One pass finds all of them, so that cost and memory follow the line and not the number that it states; of an
    argument given several times the first quoted one counts, else the first bare one.
    """
    argument = F.lit(r'(?U)\ba(0|[1-9][0-9]{0,8})=(?=("[^"]*")|(\S+))')
    places, quoted, bare = (F.regexp_extract_all(execve, argument, F.lit(k)) for k in (1, 2, 3))

    def one(x: Column, k: Column) -> Column:
        # as sorted: place, quoted before bare, order in the line
        in_quotes = x["q"] != ""
        text = F.when(in_quotes, F.regexp_replace(x["q"], '^"|"$', "")).otherwise(F.regexp_replace(x["b"], '"$', ""))
        return F.struct(x["i"].try_cast("long").alias("i"), (~in_quotes).alias("bare"), k.alias("k"), text.alias("text"))

    found = F.array_sort(F.transform(F.arrays_zip(places.alias("i"), quoted.alias("q"), bare.alias("b")), one))
    before = F.concat(F.array(F.lit(None).cast("struct<i:bigint,bare:boolean,k:int,text:string>")), found)
    n = F.coalesce(_number(execve, r"argc=(\d+)"), F.when(F.rlike(execve, F.lit(r"argc=\d")), F.lit(2**31)), F.lit(0))  # a number beyond any: all that are there
    taken = F.zip_with(found, before, lambda x, last: F.when(x["i"].isNotNull() & (x["i"] < n) & (last["i"].isNull() | (last["i"] != x["i"])), x["text"]))
    return F.array_join(F.filter(taken, lambda x: x.isNotNull()), " ")


def _cwd(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r'cwd="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(text, r"cwd=(\S+)", 1), F.lit("")))


def audit_time(text: Column) -> Column:
    """Time of an audit id or of a bare epoch number; null if there is none that a time can be."""
    epoch = F.coalesce(F.nullif(F.regexp_extract(text, r"audit\((\d+(?:\.\d+)?):\d+\)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*$", 1), F.lit("")))
    return time_of_seconds(epoch)


def events_from_lines(lines: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``lines``: value, file and ``at`` (order in the file).  ``users``: uid, name; without it only uid 0 has a name."""
    kind = F.regexp_extract("value", r"type=(EXECVE|SYSCALL|CWD)\b", 1)
    msg = F.regexp_extract("value", r"msg=(audit\([^)]+\))", 1)
    rows = lines.select("file", "at", "value", kind.alias("kind"), msg.alias("msg")).where((F.col("kind") != "") & (F.col("msg") != ""))
    last = {k: F.max_by("value", F.when(F.col("kind") == k, F.col("at"))).alias(k.lower()) for k in _KINDS}
    groups = rows.groupBy("file", "msg").agg(F.min("at").alias("at"), *last.values()).where("execve IS NOT NULL")
    sys_ = F.col("syscall")
    parsed = groups.select(
        "file", "at", "msg", "execve", "syscall", audit_time(F.col("msg")).alias("ts"), arguments(F.col("execve")).alias("command_line"), _number(sys_, r"\buid=(\d+)").alias("uid"),
        F.coalesce(_number(sys_, r"\bpid=(\d+)"), F.lit(0)).alias("process_id"), _number(sys_, r"\bppid=(\d+)").alias("parent_process_id"), F.coalesce(_cwd(F.col("cwd")), _cwd(sys_)).alias("working_directory"),
    ).where("command_line <> '' AND ts IS NOT NULL")
    if users is not None:
        parsed = parsed.join(bounded(users.select("uid", F.col("name").alias("_name"))), "uid", "left")
    else:
        parsed = parsed.withColumn("_name", F.when(F.col("uid") == 0, "root"))
    first = F.regexp_extract("command_line", r"^\s*(\S+)", 1)
    user = F.when(F.col("uid").isNull(), "root").otherwise(F.coalesce("_name", F.col("uid").cast("string")))
    raw = F.to_json(F.struct(F.col("msg").alias("msg_id"), "execve", "syscall", "uid"))
    named = parsed.select("file", "at", "ts", F.lit("linux").alias("platform"), F.regexp_extract(first, r"[^/]*$", 0).alias("process_name"), "command_line", user.alias("user"), "process_id", "parent_process_id", "working_directory", raw.alias("raw"))
    return as_events(named.withColumn("event_id", F.abs(F.xxhash64("file", "raw"))))


def read(spark: SparkSession, path: str | list[str], users: DataFrame | None = None, skip_bad: bool = False) -> DataFrame:
    """auditd files as events; ``skip_bad`` leaves out files that cannot be read (Spark logs them)."""
    paths = [path] if isinstance(path, str) else path
    lines = spark.read.options(**skipping(skip_bad)).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return events_from_lines(lines, users)


def read_folder(spark: SparkSession, folder: str, users: DataFrame | None = None) -> DataFrame:
    return read(spark, f"{folder.rstrip('/')}/audit.log*", users, skip_bad=True)


