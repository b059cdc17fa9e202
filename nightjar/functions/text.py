"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters of Unicode's White_Space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Quoted stretches (an open quote runs to the end), white space, and other stretches of a command line.
_PIECES = r"(?sU)\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z)|\s+|[^\s\"']+"


def composed(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark brings along; only texts beyond ASCII are looked at."""
    nfc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(F.length(text) != F.octet_length(text), nfc).otherwise(text)


def strip(text: Column) -> Column:
    """White space of any kind removed from both ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))


def process_basename(name: Column, platform: Column) -> Column:
    """The part after the last slash or backslash, lower case on Windows."""
    base = F.substring_index(F.replace(strip(name), F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(platform == "windows", F.lower(base)).otherwise(base)


def normalize_platform(platform: Column) -> Column:
    return F.lower(strip(platform))


def normalize_command(command: Column, platform: Column) -> Column:
    """White space outside quotes collapsed to one space; lower case on Windows."""
    pieces = F.regexp_extract_all(strip(command), F.lit(_PIECES), F.lit(0))
    joined = strip(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?U)^\s"), F.lit(" ")).otherwise(p)), ""))
    return F.when(platform == "windows", F.lower(joined)).otherwise(joined)


def normalize_user(user: Column, platform: Column) -> Column:
    text = F.regexp_replace(strip(user), r"(?U)\s+", " ")
    return F.when(platform == "windows", F.lower(text)).otherwise(text)


def host_of(raw: Column) -> Column:
    """Host named in a raw JSON record: the first of four keys that is set, lower case, without final dots."""
    named = [F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in ("hostname", "host", "computer_name", "Computer")]
    return F.lower(F.regexp_replace(strip(F.coalesce(*named, F.lit(""))), r"\.+$", ""))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.transform(chars, lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c)))), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, total).otherwise(0.0)


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal: short escapes, lower-case \\u00xx for other control characters, no others."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def iso_time(ts: Column) -> Column:
    """ISO 8601 without zone; microseconds only when they are not zero."""
    whole, part = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def relative_time(ts: Column, now: Column) -> Column:
    """Just now / Nm ago / Nh ago / Nd ago."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    return F.when(minutes < 1, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
