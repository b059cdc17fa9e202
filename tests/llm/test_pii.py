import hashlib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from nightjar.llm import pii

KEY = "a secret of the tests"


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def feistel(kind, a, b, ma, mb, key=KEY):
    """The network in plain Python."""
    for r in range(1, pii.ROUNDS + 1):
        h = int(hashlib.sha256(f"{key}|{kind}|{r}|{ma}|{b}".encode()).hexdigest()[:15], 16)
        a, b, ma, mb = b, (a + h % ma) % ma, mb, ma
    return a, b


def run(spark, values, reverse=False):
    df = spark.createDataFrame(list(enumerate(values)), "k long, text string")
    return [r["text"] for r in pii.pseudonymize(df, KEY, reverse=reverse).orderBy("k").collect()]


def test_values_of_each_kind(spark):
    rng = random.Random(1)
    cards = [card(rng, n) for n in (13, 15, 16, 16, 19)]
    values = [*cards, "4111-1111-1111-1111", "192.168.0.1", "+1 (555) 123-4567", "123-45-6789", "2024-02-29", "29.02.2024", "02/29/2024", "jo.Doe7@mail.example.com"]
    out = run(spark, values)
    assert len(set(out)) == len(out) and not set(out) & set(values)
    for v, o in zip(values[:6], out):
        assert luhn(re.sub(r"\D", "", o)) and re.sub(r"\d", "9", o) == re.sub(r"\d", "9", v)
    assert all(0 <= int(x) <= 255 for x in out[6].split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[7]) and re.fullmatch(r"\d{3}-\d\d-\d{4}", out[8])
    date.fromisoformat(out[9])
    assert re.fullmatch(r"[a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com", out[12])
    d, m, y = out[10].split(".")
    assert date(int(y), int(m), int(d)) == date.fromisoformat(out[9])  # one date, whatever its layout
    m, d, y = out[11].split("/")
    assert date(int(y), int(m), int(d)) == date.fromisoformat(out[9])
    assert run(spark, out, reverse=True) == values


def test_matches_plain_python(spark):
    rng = random.Random(2)
    numbers, days = [card(rng) for _ in range(20)], [date.fromordinal(rng.randrange(date(1800, 1, 1).toordinal(), date(2200, 1, 1).toordinal())) for _ in range(20)]
    out = run(spark, numbers + [d.isoformat() for d in days])
    for n, o in zip(numbers, out):
        a, b = feistel("card", int(n[:7]), int(n[7:15]), 10**7, 10**8)
        assert o[:15] == f"{a:07d}{b:08d}"
    first = date(1800, 1, 1).toordinal()
    for d, o in zip(days, out[20:]):
        k = d.toordinal() - first
        a, b = feistel("date", k // 773, k % 773, 189, 773)
        assert date.fromisoformat(o).toordinal() - first == a * 773 + b


def test_dates_are_permuted_one_to_one(spark):
    df = spark.range(0, 146_097, 7).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymize(df, KEY)
    assert out.select("text").distinct().count() == df.count()


def test_invalid_values_and_clean_texts_stay(spark, odd_docs):
    bad = next(n for n in (f"123456781234567{c}" for c in range(10)) if not luhn(n))
    values = [bad, "300.1.1.1", "2023-02-29", "666-12-3456", "000-12-3456", "version 1.2.3", "10:30", "no digits", "", "x" * 5000 + "1", "a@b", "12345678901234567890123"]
    assert run(spark, values) == values
    same = pii.pseudonymize(odd_docs, KEY)
    assert same.columns == ["doc_id", "lang", "source", "n_chars", "_row", "ids", "name", "found", "text", "n_values"]
    before, after = ({(r["doc_id"], r["text"]) for r in df.collect()} for df in (odd_docs, same))
    assert before == after and same.agg(F.sum("n_values")).first()[0] == 0


def test_values_stay_linked_inside_texts(spark):
    rng = random.Random(4)
    n = card(rng)
    a, b, c = run(spark, [f"pay {n}, then\n{n}.", f"$$${n}$$$", None])
    (x,) = set(re.findall(r"\d{16}", a))
    assert re.findall(r"\d{16}", b) == [x] and a == f"pay {x}, then\n{x}." and c is None


def scan(text):
    """The cards of a run of digit groups by plain loops: from the left, the longest first."""
    groups, out, i = list(re.finditer("[0-9]+", text)), [], 0
    while i < len(groups):
        ends = [j for j in range(len(groups), i, -1) if 13 <= len(d := "".join(g[0] for g in groups[i:j])) <= 19 and luhn(d)]
        if ends:
            out.append(text[groups[i].start() : groups[ends[0] - 1].end()])
        i = ends[0] if ends else i + 1
    return out


def test_cards_beside_other_digit_groups(spark):
    rng = random.Random(6)
    four = lambda: " ".join(re.findall("....", card(rng)))
    values = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/26", "2024 4111 1111 1111 1111", f"{four()} {four()}", "4111-1111-1111-1111 2024-05-06", "7 4111 1111 1111 1111 10.0.0.1"]
    values += [" ".join([str(rng.randrange(10**4)), four(), str(rng.randrange(10**3)), four()]) for _ in range(40)] + [" ".join(str(rng.randrange(100)) for _ in range(60)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, text string")
    for v, r in zip(values, pii.pseudonymize(df, KEY).orderBy("k").collect()):
        cards = scan(re.sub(r" (12/26|2024-05-06|10\.0\.0\.1)$", "", v))
        assert cards or len(v.split()) == 60
        rest, others = v, r["text"]
        for c in cards:
            before, rest = rest.split(c, 1)
            new = others[len(before) : len(before) + len(c)]
            assert others.startswith(before) and new != c and luhn(re.sub(r"\D", "", new)) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c)
            others = others[len(before) + len(c) :]
        other = bool(re.search(r"2024-05-06|10\.0\.0\.1", rest))
        assert (others != rest) == other and r["n_values"] == len(cards) + other


def test_counts(spark):
    df = spark.createDataFrame([(1, "a@b.example 1.2.3.4 999.1.1.1", "z")], "id long, text string, row string")
    r = pii.pseudonymize(df, KEY).first()
    assert r["n_values"] == 2 and r["row"] == "z"
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0


@pytest.mark.parametrize("text", ["a" * 20_000, "a." * 10_000, "1-" * 10_000, "@" * 5000])
def test_long_runs_are_quick(spark, text):
    assert run(spark, [text]) == [text]


def test_phone_numbers_keep_their_kind(spark):
    rng = random.Random(8)
    numbers = [f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10**4):04d}" for _ in range(300)]
    kind = lambda n: (int(n[:3]) < 200, int(n[:3]) >= 200 and int(n[4:7]) < 200)
    out = run(spark, numbers)
    assert [kind(n) for n in out] == [kind(n) for n in numbers] and all(re.fullmatch(r"\d{3}-\d{3}-\d{4}", n) for n in out)
    assert run(spark, out, reverse=True) == numbers and len(set(out)) == len(set(numbers))


def test_the_key_comes_from_the_session(spark, odd_docs):
    spark.conf.unset(pii.KEY_SETTING)
    drawn = pii.session_key(spark)
    assert len(drawn) == 32 and pii.session_key(spark) == drawn
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_repeated_rows_get_the_same_pseudonyms(spark):
    rows = [(1, "call +1 (555) 223-4567"), (1, "call +1 (555) 223-4567"), (2, None), (2, None)]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "id long, text string"), KEY).collect()]
    assert got[0] == got[1] != rows[0][1] and got[2:] == [None, None]


def test_key_stands_in_no_plan(spark, tmp_path):
    """Neither the plans before and after execution nor a written event has the key; an empty table works too."""
    key = "k-7f3a-very-secret"
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111 on 2024-05-06, a@b.example")], "doc_id long, text string")
    found = pii.pseudonymize(df, key)
    (row,) = found.collect()
    assert row["n_values"] == 3
    executed = found._jdf.queryExecution()
    texts = [executed.toString(), executed.executedPlan().toString(), executed.analyzed().toString(), executed.optimizedPlan().toString(), found._jdf.queryExecution().logical().toJSON(), executed.optimizedPlan().toJSON()]
    assert all(key not in t for t in texts) and "SHA" in executed.toString().upper()
    assert pii.pseudonymize(df.limit(0), key).collect() == []
    (back,) = pii.pseudonymize(found.drop("n_values"), pii.key_table(spark, key), reverse=True).collect()
    assert back["text"] == df.first()["text"]


def test_key_setting_is_redacted(spark):
    assert "secret" in pii.KEY_SETTING  # Spark's default pattern for settings that it does not print
