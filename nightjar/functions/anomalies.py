"""Anomaly indicators of a command line."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entropy

# Substrings (compared in lower case) and patterns of each indicator.
ENCODED_PAYLOAD = ("-encodedcommand", "-enc ", "frombase64string", "certutil -decode", "certutil -f -decode", "base64 -d", "base64 --decode")
DOWNLOAD_CRADLE = (
    "invoke-expression", "iex ", "downloadstring", "downloadfile", "net.webclient", "start-bitstransfer", "invoke-webrequest",
    "invoke-restmethod", "curl", "wget", "regsvr32 /u /s /i", "mshta http", "mshta https",
)
OBFUSCATION = ("${env:", "$env:", "[char]", "[convert]")
OBFUSCATION_PATTERNS = (r"(?i)`[a-z]", r"\^[a-zA-Z]{2,}", r"(?iU)'[a-z]'\s*\+\s*'[a-z]'")
UNUSUAL_PATH = ("\\temp\\", "\\appdata\\local\\temp\\", "\\appdata\\roaming\\", "\\users\\public\\", "\\$recycle.bin\\", "\\\\webdav", "\\\\@", "/tmp/", "/var/tmp/", "/dev/shm/")
SUSPICIOUS_FLAGS = (
    "-windowstyle hidden", "-w hidden", "-noninteractive", "-nop", "-executionpolicy bypass", "-ep bypass", "-exec bypass",
    "/u /s /i", "squiblydoo", "-sta", "-encodedcommand",
)
LONG_COMMAND, LONG_TOKEN, TOKEN_ENTROPY = 300, r"[A-Za-z0-9+/=]{80,}", 4.5
#: Weight of each indicator and the most they add up to.
WEIGHTS = {"encoded_payload": 12, "download_cradle": 10, "obfuscation": 8, "unusual_path": 5, "suspicious_flags": 5, "high_entropy_argument": 4}
CAP = 25


def any_of(text: Column, parts) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def flags(command: Column) -> dict[str, Column]:
    """A boolean column for each indicator."""
    text = F.coalesce(command, F.lit(""))
    low = F.lower(text)
    odd = reduce(or_, [text.rlike(p) for p in OBFUSCATION_PATTERNS], any_of(low, OBFUSCATION))
    tokens = F.exists(F.regexp_extract_all(text, F.lit(LONG_TOKEN), F.lit(0)), lambda t: entropy(t) >= TOKEN_ENTROPY)
    return {
        "encoded_payload": any_of(low, ENCODED_PAYLOAD),
        "download_cradle": any_of(low, DOWNLOAD_CRADLE),
        "obfuscation": odd,
        "unusual_path": any_of(low, UNUSUAL_PATH),
        "suspicious_flags": any_of(low, SUSPICIOUS_FLAGS),
        "high_entropy_argument": (F.length(text) >= LONG_COMMAND) | tokens,
    }


def anomalies(command: Column) -> Column:
    """Names of the indicators found, sorted."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(flags(command).items())]))


def weight(names: Column, cap: int | None = CAP) -> Column:
    """Summed weight of an array of indicator names, each counted once."""
    total = reduce(lambda a, b: a + b, [F.when(F.array_contains(names, n), w).otherwise(0) for n, w in WEIGHTS.items()])
    return F.least(F.lit(cap), total) if cap is not None else total
