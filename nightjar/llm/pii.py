"""Format-preserving pseudonyms for personal data (operator 8), in DataFrame functions only.

Numbers and dates that validate are replaced by a keyed permutation of their own
format, so a card number becomes another valid card number, a date another date
of the same layout, and equal values become equal pseudonyms in all documents:

* payment cards: 13 to 19 digits (blanks or hyphens between them stay), Luhn check;
  all digits but the check digit are permuted, then the check digit is made anew;
  in a run of digit groups every stretch of whole groups is tried, from the left,
  the longest first, so a card is found beside a year or a security code
* IPv4 addresses: four numbers up to 255
* telephone numbers ``+1 (ddd) ddd-dddd`` and the like: the ten digits; numbers
  whose area code and exchange can be dialled (both from 200) stay such numbers,
  others are replaced too, within their own kind
* social security numbers ``ddd-dd-dddd`` of an area, group and serial in use
* dates ``yyyy-mm-dd``, ``dd.mm.yyyy``, ``mm/dd/yyyy`` that exist, from 1800 to 2199
* e-mail addresses: the letters and digits of the local part, each within its class;
  the domain after the @ stays in clear

The permutation is a Feistel network over two halves Z_a x Z_b (8 rounds, round
values from SHA-256 over key, kind, round and the other half).  Every domain is
an exact product: ten digits are 10**5 x 10**5, the 146097 days of a Gregorian
cycle are 189 x 773, and so on, so it is a bijection without cycle walking, and
``reverse=True`` turns pseudonyms back.  The exception is a card beside other
digit groups: where another stretch that is tried earlier happens to pass the
Luhn check in the pseudonym, the reverse takes that one.

The key is a secret of the caller.  It reaches the expressions as a scalar subquery over a table of one row, never as
a literal, so it stands in no plan, neither in ``explain`` nor in the SQL tab or the event log.  The registered query
reads it from the session's ``spark.nightjar.pii.secret`` (a name that Spark's redaction covers wherever it prints
settings) and, where that is unset, draws one for the session: pseudonyms of different sessions are then not linked.

Values that do not validate (a number with a wrong check digit, 300.1.1.1) stay.
Only texts with a digit or an @ are searched at all.

Defined results: a null text stays null; empty texts and texts without values
are returned unchanged; repeated rows get the same pseudonyms; other columns,
also ones named like the operator's own helpers, pass through.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
_EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
_DATE = r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_PHONE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}\b"
_OTHERS = "|".join((_EMAIL, _IPV4, _DATE, _SSN, _PHONE))
#: A whole run of digit groups of 13 digits or more, up to a group that begins another kind of value.
_CARD = rf"\b(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++\b(?:[ -](?!{_OTHERS})[0-9]++\b)*+"
PATTERN = f"{_OTHERS}|{_CARD}"
#: Session setting that holds the secret key.
KEY_SETTING = "spark.nightjar.pii.secret"
_FIRST_DAY = "1800-01-01"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _long(x) -> Column:
    return F.lit(x).cast("long") if not isinstance(x, Column) else x.cast("long")


def _draw(key: Column, kind: Column, rnd: Column, half: Column, size: Column) -> Column:
    """60 pseudo-random bits of the round."""
    text = F.concat_ws("|", F.lit(key), kind, rnd.cast("string"), size.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: Column | str, kind: Column, a: Column, b: Column, ma: Column, mb: Column, reverse: bool = False) -> Column:
    """Permute (a, b) of Z_ma x Z_mb; a struct with fields a and b."""
    state = F.struct(_long(a).alias("a"), _long(b).alias("b"), _long(ma).alias("ma"), _long(mb).alias("mb"))
    if not reverse:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), state,
            lambda s, r: F.struct(s["b"].alias("a"), F.pmod(s["a"] + _draw(key, kind, r, s["b"], s["ma"]) % s["ma"], s["ma"]).alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb")),
        )
    return F.aggregate(
        F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), state,
        lambda s, r: F.struct(F.pmod(s["b"] - _draw(key, kind, r, s["a"], s["mb"]) % s["mb"], s["mb"]).alias("a"), s["a"].alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb")),
    )


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; the last digit is doubled or not, then every second one to its left."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, i: s + let(F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == (0 if double_last else 1), 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )


def _pour(digits: Column, mask: Column) -> Column:
    """``mask`` with its digits replaced by those of ``digits``, in order."""
    marks = F.split(mask, "")
    return F.aggregate(
        marks, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda t, c: F.when(c.rlike("^[0-9]$"), F.struct((t["n"] + 1).alias("n"), F.concat(t["s"], F.substr(digits, t["n"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(t["n"].alias("n"), F.concat(t["s"], c).alias("s"))),
        lambda t: t["s"],
    )


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, int) else n.cast("int"), "0")


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def _cards(key: str, m: Column, reverse: bool) -> Column:
    """A run of digit groups with its cards replaced, and their number."""
    def permuted(d: Column) -> Column:
        n = F.length(d) - 1
        u = F.floor(n / 2).cast("int")
        left, right = F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1, n - u).cast("long")
        out = feistel(key, F.lit("card"), left, right, _power10(u), _power10(n - u), reverse)
        payload = let(out, lambda s: F.concat(_pad(s["a"], u), _pad(s["b"], n - u)))
        return let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(p, True), F.lit(10)).cast("string")))

    def longest(g: Column, i: Column) -> Column:
        """How many groups from the i-th on are the longest card, or null."""
        ends = F.transform(F.sequence(F.lit(1), F.least(F.size(g) - i, F.lit(19))), lambda j: F.struct(j.alias("j"), F.array_join(F.slice(g, i + 1, j), "").alias("d")))
        valid = F.filter(F.filter(ends, lambda e: F.length(e["d"]).between(13, 19)), lambda e: luhn_sum(e["d"], False) % 10 == 0)
        return F.array_max(F.transform(valid, lambda e: e["j"]))

    def step(t: Column, i: Column, g: Column, blanks: Column) -> Column:
        before = lambda x: F.when(x > 0, F.get(blanks, x - 1)).otherwise("")
        plain = F.struct((i + 1).alias("next"), F.concat(t["s"], before(i), F.get(g, i)).alias("s"), t["n"].alias("n"))

        def found(j: Column) -> Column:
            mask = F.array_join(F.transform(F.sequence(i, i + j - 1), lambda x: F.concat(F.when(x > i, before(x)).otherwise(""), F.get(g, x))), "")
            new = let(mask, lambda c: F.struct(c.alias("old"), _pour(let(F.regexp_replace(c, "[^0-9]", ""), permuted), c).alias("new")))
            return let(new, lambda c: F.struct((i + j).alias("next"), F.concat(t["s"], before(i), c["new"]).alias("s"), (t["n"] + F.when(c["old"] != c["new"], 1).otherwise(0)).alias("n")))

        return F.when(i < t["next"], t).otherwise(let(longest(g, i), lambda j: F.when(j.isNull(), plain).otherwise(found(j))))

    def scanned(g: Column, blanks: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("s"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, lambda t, i: step(t, i, g, blanks))

    run = F.struct(F.split(m, "[ -]").alias("g"), F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)).alias("blanks"))
    return let(let(run, lambda r: scanned(r["g"], r["blanks"])), lambda t: F.struct(t["s"].alias("s"), t["n"].alias("n")))


def _phone(key: str, m: Column, reverse: bool) -> Column:
    """Three kinds, each an exact product: (area, exchange) both from 200, area below 200, and area from 200 with exchange below."""
    def permuted(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange, line = (F.substring(ten, p, n).cast("long") for p, n in ((1, 3), (4, 3), (7, 4)))
        low_area, low_exchange = area < 200, (area >= 200) & (exchange < 200)
        first = F.when(low_area, 0).otherwise(200)  # least area and exchange of the kind, and how many exchanges it has
        second = F.when(low_area | low_exchange, 0).otherwise(200)
        many = F.when(low_area, 1000).when(low_exchange, 200).otherwise(800)
        areas = F.when(low_area, 200).otherwise(800)
        kind = F.when(low_area, "phone-area").when(low_exchange, "phone-exchange").otherwise("phone")
        out = feistel(key, kind, (area - first) * many + exchange - second, line, areas * many, _long(10_000), reverse)
        number = let(out, lambda s: F.concat(_pad((F.floor(s["a"] / many) + first).cast("int"), 3), _pad((s["a"] % many + second).cast("int"), 3), _pad(s["b"], 4)))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), number)

    return _pour(let(F.regexp_replace(m, "[^0-9]", ""), permuted), m)


def _ssn(key: str, m: Column, reverse: bool) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(key, F.lit("ssn"), number * 99 + group - 1, serial - 1, _long(898 * 99), _long(9999), reverse)

    def text(s: Column) -> Column:
        k = F.floor(s["a"] / 99) + 1
        return F.concat(_pad(k + F.when(k >= 666, 1).otherwise(0), 3), F.lit("-"), _pad(s["a"] % 99 + 1, 2), F.lit("-"), _pad(s["b"] + 1, 4))

    return F.when(valid, let(out, text)).otherwise(m)


def _ipv4(key: str, m: Column, reverse: bool) -> Column:
    def address(p: Column) -> Column:
        o = [p[k].cast("int") for k in range(4)]
        out = feistel(key, F.lit("ipv4"), o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), reverse)
        text = let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)]))
        plain = F.concat_ws(".", *[x.cast("string") for x in o]) == m  # no leading zeros
        return F.when((F.greatest(*o) <= 255) & plain, text).otherwise(m)

    return let(F.split(m, r"\."), address)


def _date(key: str, m: Column, reverse: bool) -> Column:
    iso, dotted = m.contains("-"), m.contains(".")
    text = F.when(iso, m).when(dotted, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    day = F.datediff(text.try_cast("date"), F.lit(_FIRST_DAY).cast("date"))

    def shifted(n: Column) -> Column:
        out = feistel(key, F.lit("date"), F.floor(n / 773), n % 773, _long(189), _long(773), reverse)
        moved = let(out, lambda s: F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["a"] * 773 + s["b"]).cast("int")).cast("string"))
        return let(moved, lambda t: F.when(iso, t).when(dotted, F.concat_ws(".", F.substring(t, 9, 2), F.substring(t, 6, 2), F.substring(t, 1, 4))).otherwise(F.concat_ws("/", F.substring(t, 6, 2), F.substring(t, 9, 2), F.substring(t, 1, 4))))

    return let(day, lambda n: F.when((n >= 0) & (n < 146_097), shifted(n)).otherwise(m))


def _email(key: str, m: Column, reverse: bool) -> Column:
    """Each half of the local part shifts the letters and digits of the other half inside their class."""
    local, rest = F.regexp_extract(m, "^([^@]*)(@.*)$", 1), F.regexp_extract(m, "^([^@]*)(@.*)$", 2)
    size = F.length(local)
    half = F.ceil(size / 2).cast("int")
    sign = -1 if reverse else 1

    def shift(c: Column, by: Column) -> Column:
        out = c
        for alphabet in (_LOWER, _UPPER, _DIGITS):
            n = len(alphabet)
            out = F.when(c.rlike(f"^[{alphabet[0]}-{alphabet[-1]}]$"), F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by * sign, F.lit(n)).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    def move(text: Column, other: Column, rnd: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), rnd.cast("string"), size.cast("string"), other).cast("binary"), 512)
        return let(digest, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: shift(c, F.conv(F.substr(h, (i * 4 % 124 + 1).cast("int"), F.lit(4)), 16, 10).cast("int"))), ""))

    rounds = F.sequence(F.lit(1), F.lit(4)) if not reverse else F.sequence(F.lit(4), F.lit(1), F.lit(-1))
    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, size).alias("r"))
    done = F.aggregate(rounds, start, lambda s, r: F.when(r % 2 == 1, F.struct(move(s["l"], s["r"], r).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), move(s["r"], s["l"], r).alias("r"))))
    return let(done, lambda s: F.concat(s["l"], s["r"], rest))


def pseudonym(key: Column, m: Column, reverse: bool = False) -> Column:
    """A struct: the pseudonym of one match (``s``; the match itself where nothing validates), and how many values were replaced (``n``)."""
    is_ = lambda p: m.rlike(f"^(?:{p})$")
    one = lambda f: let(f(key, m, reverse), lambda s: F.struct(s.alias("s"), F.when(s != m, 1).otherwise(0).alias("n")))
    return (
        F.when(m.contains("@"), one(_email)).when(is_(_IPV4), one(_ipv4)).when(is_(_DATE), one(_date)).when(is_(_SSN), one(_ssn)).when(is_(_PHONE), one(_phone)).otherwise(_cards(key, m, reverse))
    )


def session_key(spark: SparkSession) -> str:
    """The session's secret key; drawn once for the session where none is set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """The key as a table of one row."""
    return spark.createDataFrame([(key,)], "key string")


def pseudonymize(docs: DataFrame, key: str | DataFrame, column: str = "text", count: str = "n_values", reverse: bool = False) -> DataFrame:
    """``docs`` with the values in ``column`` replaced, and ``count``, the number of replaced values.

    ``key``: the secret, or a table with it as its one value (read from a file that only the job may read, say).
    """
    secret = (key_table(docs.sparkSession, key) if isinstance(key, str) else key).scalar()
    text = F.col(f"`{column}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (column, count)]
    searched = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    held = docs.select(F.struct(*others).alias("row") if others else F.lit(1).alias("row"), text.alias("text"), searched.alias("found"), secret.alias("key"))
    held = held.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(F.col("key"), m, reverse))))
    parts = F.zip_with(F.split("text", PATTERN, -1), F.concat("new.s", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = F.when(F.col("new").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text"))
    n = F.coalesce(F.aggregate("new.n", F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return held.select(*(["row.*"] if others else []), changed.alias(column), n.alias(count))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
