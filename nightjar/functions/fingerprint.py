"""Stable SHA-256 identities of alerts and incidents.

The hashed text is canonical JSON: keys in alphabetical order, no blanks,
non-ASCII kept, nulls written as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import composed, host_of, iso_time, json_string, normalize_command, normalize_platform, normalize_user, process_basename, strip

VERSION = 1


def _object(fields: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def alert_fingerprints(unicode_form: bool = True) -> dict[str, Column]:
    """``fingerprint`` (with host), ``activity_fingerprint`` (without) and ``fp_host`` of an alert row.

    Text is composed to NFC first, so that one command written in two ways has one identity.
    """
    form = composed if unicode_form else (lambda c: c)
    platform = F.col("platform")
    host = F.when(F.coalesce(F.col("host"), F.lit("")) != "", F.lower(F.regexp_replace(strip(F.col("host")), r"\.+$", ""))).otherwise(host_of(F.col("raw")))
    fields = {
        "v": F.lit(str(VERSION)), "rule_id": json_string(F.col("rule_id")), "platform": json_string(normalize_platform(platform)),
        "process_name": json_string(process_basename(F.col("process_name"), platform)), "command_line": json_string(normalize_command(form(F.col("command_line")), platform)),
        "user": json_string(normalize_user(form(F.col("user")), platform)), "parent_process_name": json_string(process_basename(F.col("parent_process_name"), platform)),
    }
    return {"fingerprint": F.sha2(_object(fields | {"host": json_string(host)}), 256), "activity_fingerprint": F.sha2(_object(fields), 256), "fp_host": host}


def incident_fingerprint(chain_id: Column, platform: Column, host: Column, stages: Column) -> Column:
    """``stages``: array of structs with stage, process_name, pid and timestamp."""
    def stage(s: Column) -> Column:
        text = lambda c: F.coalesce(json_string(F.when(c.isNotNull(), c)), F.lit("null"))
        return _object({
            "stage": json_string(s["stage"]), "process_name": json_string(process_basename(s["process_name"], platform)),
            "pid": F.coalesce(s["pid"].cast("string"), F.lit("null")),
            "timestamp": F.when(s["timestamp"].isNull(), F.lit("null")).otherwise(text(iso_time(s["timestamp"]))),
        })

    return F.sha2(_object({
        "v": F.lit(str(VERSION)), "chain_id": json_string(chain_id), "platform": json_string(normalize_platform(platform)), "host": json_string(F.lower(strip(host))),
        "stages": F.concat(F.lit("["), F.array_join(F.transform(stages, stage), ","), F.lit("]")),
    }), 256)
