"""Benchmark decontamination by spaced-seed hashing (operator 1), in DataFrame functions only.

A text is a sequence of tokens (runs of letters and digits, lower case).  A seed
is a mask over neighbouring tokens: the hash of the tokens at its 1 positions
ignores those at its 0 positions, so a replaced token does not hide a hit.  The
hashes of every place of every training text are joined to those of the
benchmark items.  A hit fixes an alignment of an item on a text; each alignment
is verified token by token: the pair is a leak when some stretch of WINDOW item
tokens (the whole item if shorter) agrees in at least PERCENT of its places.

The masks cover every set of substitutions that the rule allows, so seeds never
decide the result: the two of MASKS do so for stretches of WINDOW tokens, and
``masks_for`` adds masks for the lengths of shorter items that occur in the
benchmark, until for each length every allowed set of replaced places leaves
some mask untouched at some place (all sets are tried; at most 455 for a
length).  A text is hashed with the added masks only where such items exist.

An item of fewer than LEAST tokens is no evidence and matches nothing.  The
benchmark's seeds are broadcast only if their counted number is below a bound,
and so are the alignments found; beyond it both joins are shuffled.  Of a text
only the stretch that an item covers is carried along.

Defined results: null and empty texts have no tokens and no leaks; repeated rows
are judged alike; an item occurring several times in a text is reported once
with its best stretch; each distinct (item_id, text) is an item of its own, a
null id included, and of items with one id the best stretch is reported; texts
of any length are hashed at all places; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, materialize, table, with_row_ids

#: 1: the token counts; 0: it is ignored. Each starts and ends with 1.
MASKS = ("1101011", "11100101")
#: Masks for short items, tried in this order (the more tokens count, the fewer chance hits).
SHORT_MASKS = ("11101", "11011", "10111", "1111", "1101", "1011", "111")
WINDOW, PERCENT, LEAST = 16, 80, 5
#: Most seeds (24 bytes each) and most alignments that are broadcast.
SEED_ROWS, ALIGNMENT_ROWS = 500_000, 100_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def covers(masks, n: int, replaced: int) -> bool:
    """Whether every choice of ``replaced`` of ``n`` places leaves a mask untouched at some place."""
    seeds = [{p + k for k, c in enumerate(m) if c == "1"} for m in masks for p in range(n - len(m) + 1)]
    return all(any(s.isdisjoint(lost) for s in seeds) for lost in combinations(range(n), replaced))


def allowed(n: int, percent: int = PERCENT) -> int:
    """How many of ``n`` places may differ."""
    return n - -(-n * percent // 100)


def masks_for(n: int, masks=MASKS, percent: int = PERCENT) -> tuple[str, ...]:
    """The masks that an item of ``n`` tokens needs, those given first."""
    out = tuple(m for m in masks if len(m) <= n)
    for extra in SHORT_MASKS:
        if covers(out, n, allowed(n, percent)):
            break
        out += (extra,) * (len(extra) <= n)
    if not covers(out, n, allowed(n, percent)):
        out += ("1" * max(1, n // (allowed(n, percent) + 1)),)  # of so many parts one has no replaced place
    return out


def _places(n: Column, span: int) -> Column:
    """1-based places at which a mask of ``span`` tokens fits into ``n`` tokens."""
    return F.when(n >= span, F.sequence(F.lit(1), n - (span - 1))).otherwise(F.array().cast("array<int>"))


def seed_hashes(hashes: Column, number: int, mask: str) -> Column:
    """The hash of a mask at each place of an array of token hashes."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    return F.transform(_places(F.size(hashes), len(mask)), lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + (k - 1)) for k in at]))


def _seeds(df: DataFrame, keys: list[str], masks) -> DataFrame:
    """One row per mask and place: the keys, ``mask``, ``seed`` and ``place`` (0-based)."""
    hashed = df.select(*keys, F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))
    cuts, offset = [], F.lit(0)
    for m in masks:  # where each mask's places begin in the joined array
        cuts.append(offset)
        offset = offset + F.greatest(F.size("h") - (len(m) - 1), F.lit(0))
    joined = let(F.col("h"), lambda h: F.concat(*[seed_hashes(h, k, m) for k, m in enumerate(masks)]))
    later = [f"cut{k}" for k in range(1, len(masks))]
    rows = hashed.select(*keys, *[c.alias(f"cut{k}") for k, c in enumerate(cuts) if k], joined.alias("s")).select(*keys, *later, F.posexplode("s").alias("p", "seed"))
    start, number = F.lit(0), F.lit(0)
    for k in range(1, len(masks)):
        start = F.when(F.col("p") >= F.col(f"cut{k}"), F.col(f"cut{k}")).otherwise(start)
        number = F.when(F.col("p") >= F.col(f"cut{k}"), F.lit(k)).otherwise(number)
    return rows.select(*keys, "seed", (F.col("p") - start).alias("place"), number.alias("mask"))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a written table), marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """One row per leak: _row, doc_id, item_id, matched, compared, place (of the item's first token in the text).

    ``docs``: _row, doc_id, text; ``benchmark``: item_id, text.
    """
    items = benchmark.select("item_id", "text").distinct().select("item_id", "text", tokens(F.col("text")).alias("q")).where(F.size("q") >= least)
    items = materialize(items.select("item_id", "text", "q", F.size("q").alias("n"), F.xxhash64("item_id", "text").alias("item")), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window lengths
    needed = {n: masks_for(n, masks, percent) for n in short}
    every = tuple(masks) + tuple(m for m in dict.fromkeys(m for n in short for m in needed[n]) if m not in masks)
    # seeds of an added mask are kept for the lengths that need it
    own = F.col("mask") < len(masks)
    for n in short:
        own = own | ((F.col("n") == n) & F.col("mask").isin(*[every.index(m) for m in needed[n]]))
    seeds = materialize(_seeds(items, ["item", "n"], every).where(own).select("seed", "item", "n", F.col("place").alias("item_place")), "seeds")
    hits = _seeds(docs.select("_row", "text"), ["_row"], every).join(_bounded(seeds, SEED_ROWS), "seed")
    lines = materialize(hits.select("_row", "item", "n", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "alignments")
    grouped = lines.groupBy("_row").agg(F.collect_list(F.struct("item", "n", "shift")).alias("lines"))
    # a text is split once; each alignment takes the stretch that its item covers
    covered = lambda t, x: F.slice(t, F.greatest(x["shift"], F.lit(0)) + 1, F.greatest(x["n"] + F.least(x["shift"], F.lit(0)), F.lit(0)))
    stretch = lambda t, x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), covered(t, x).alias("t"))
    pairs = docs.select("_row", "doc_id", "text").join(_bounded_groups(grouped, lines), "_row")
    pairs = pairs.select("_row", "doc_id", F.explode(let(tokens(F.col("text")), lambda t: F.transform("lines", lambda x: stretch(t, x)))).alias("x"))
    pairs = pairs.select("_row", "doc_id", "x.item", "x.shift", "x.t").join(items.select("item", "item_id", "q", "n"), "item")
    inside = lambda j: F.least(F.col("shift"), F.lit(0)) + j
    same = F.transform("q", lambda x, j: F.when((inside(j) >= 0) & F.equal_null(F.get("t", F.greatest(inside(j), F.lit(0))), x), 1).otherwise(0))
    counted = pairs.select("_row", "doc_id", "item", "item_id", "shift", "n", F.least("n", F.lit(window)).alias("compared"), same.alias("same"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("compared") + 1), lambda k: F.aggregate(F.slice("same", k, F.col("compared")), F.lit(0), lambda a, b: a + b)))
    found = counted.select("_row", "doc_id", "item_id", "compared", F.col("shift").alias("place"), best.alias("matched")).where(F.col("matched") * 100 >= F.col("compared") * percent)
    top = found.groupBy("_row", "item_id").agg(F.min("doc_id").alias("doc_id"), F.max(F.struct("matched", (-F.col("place")).alias("p"), "compared")).alias("b"))
    return top.select("_row", "doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.compared").alias("compared"), (-F.col("b.p")).alias("place"))


def _bounded_groups(grouped: DataFrame, lines: DataFrame) -> DataFrame:
    return F.broadcast(grouped) if lines.count() <= ALIGNMENT_ROWS else grouped


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark, all columns kept."""

    def clean(d: DataFrame) -> DataFrame:
        found = materialize(leaks(d, benchmark).select("_row").distinct(), "leaks")
        return d.join(_bounded(found, ALIGNMENT_ROWS), "_row", "left_anti")

    return filtered(docs, clean)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, item) leaks of the documents table."""
    docs = with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched", "compared")


#: From the definition, without seeds: all alignments with enough equal tokens, then the best stretch of each.
_ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (
  SELECT row_number() OVER () AS item, item_id, t, len(t) AS n FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark
  ) WHERE len(t) >= {LEAST}
), dt AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM d),
bt AS (SELECT item, n, unnest(t) AS x, unnest(range(n)) AS j FROM b),
lines AS (
  SELECT doc_id, item, i - j AS shift FROM dt JOIN bt USING (x) GROUP BY doc_id, item, i - j
  HAVING count(*) * 100 >= any_value(least(n, {WINDOW})) * {PERCENT}
), same AS (
  SELECT doc_id, item_id, n, least(n, {WINDOW}) AS compared,
         list_transform(range(1, n + 1), lambda j: CASE WHEN shift + j >= 1 AND shift + j <= len(d.t) AND d.t[shift + j] = b.t[j] THEN 1 ELSE 0 END) AS s
  FROM lines JOIN d USING (doc_id) JOIN b USING (item)
), best AS (
  SELECT doc_id, item_id, compared, list_max(list_transform(range(1, n - compared + 2), lambda k: list_sum(list_slice(s, k, k + compared - 1)))) AS matched FROM same
)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(arg_max(compared, matched) AS INTEGER) AS compared
FROM best WHERE matched * 100 >= compared * {PERCENT} GROUP BY doc_id, item_id
"""
QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": _ORACLE}
