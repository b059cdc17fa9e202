"""Chat formatting of preference pairs (operator 4).

For a chosen and a rejected conversation the operator finds the longest common
prefix of turns, renders it once as the prompt, and renders what follows on
either side as a pair of completions.  Each completion comes with its mask: the
stretches of characters to learn from (``*_spans``), which are the texts and end
marks of the assistant's turns; everything else, the prompt included, is not
learned.

The output has one row per pair and BLOCK consecutive turn numbers.  A pair of
ordinary length is one row; of a longer one the rows' parts are to be put
together in the order of ``block``, their spans count from the row's own start.
So a row, and the group that makes it, is bounded by 2 * BLOCK turns however
long a conversation is.  The first turn at which the two sides differ is a
minimum with partial aggregation, and everything else is equi-joins.

Turns are compared by number, role and text.  A turn that one side lacks is a
difference.  Defined results: of several rows for one turn of a conversation
the one with the smallest (role, text) counts, nulls first; rows with a null
conversation or turn have no place in any sequence and are left out; a null
role renders as ``unknown``, a null text as empty; a pair whose sides are equal
has only a prompt and status ``identical``; a conversation without partner
keeps all its turns as completion with status ``unpaired``; a marker inside a
text is broken by a space, so text cannot forge a turn.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|", "|>"
LEARNED_ROLES = ("assistant",)
#: Turn numbers of one output row.
BLOCK = 256
_SPANS = "array<struct<begin:int,end:int>>"


def _broken(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def turn_header(role: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}turn{CLOSE}"), _broken(F.coalesce(role, F.lit("unknown"))), F.lit("\n"))


def turn_body(text: Column) -> Column:
    return F.concat(_broken(F.coalesce(text, F.lit(""))), F.lit(f"{OPEN}end{CLOSE}\n"))


def one_row_a_turn(turns: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text, with one row for each turn."""
    one = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    return one.select("conv_id", "turn", "t.role", "t.text")


def format_pairs(turns: DataFrame, learned=LEARNED_ROLES, block: int = BLOCK) -> DataFrame:
    """Render preference pairs.

    ``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text; one row for each turn of a side.

    Columns: pair_id, block, status, prompt_turns (of this row), prompt, chosen, rejected, chosen_spans, rejected_spans.
    """
    key = F.struct(F.col("role").alias("role"), F.col("text").alias("text"))
    chosen, rejected = F.col("side") == "chosen", F.col("side") == "rejected"
    slots = turns.groupBy("pair_id", "turn").agg(
        F.max(F.when(chosen, key)).alias("c"), F.max(F.when(rejected, key)).alias("r"), F.max(chosen).alias("in_c"), F.max(rejected).alias("in_r")
    )
    same = F.col("in_c") & F.col("in_r") & F.col("c").eqNullSafe(F.col("r"))
    cut = slots.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("cut"), F.max("in_c").alias("any_c"), F.max("in_r").alias("any_r"))
    status = F.when(~(F.col("any_c") & F.col("any_r")), "unpaired").when(F.col("cut").isNull(), "identical").otherwise("ok")
    placed = slots.join(cut, "pair_id").withColumn("common", F.col("cut").isNull() | (F.col("turn") < F.col("cut"))).withColumn("status", status)

    def part(has: Column, role: Column, text: Column) -> Column:
        """A turn's rendered text with the length of its header and whether it is learned; null where the part lacks it."""
        learn = F.coalesce(role.isin(*learned), F.lit(False))
        return F.when(has, F.struct("turn", turn_header(role).alias("head"), turn_body(text).alias("body"), learn.alias("learn")))

    parts = {"prompt": part(F.col("common"), F.col("c.role"), F.col("c.text")), "chosen": part(~F.col("common") & F.col("in_c"), F.col("c.role"), F.col("c.text")), "rejected": part(~F.col("common") & F.col("in_r"), F.col("r.role"), F.col("r.text"))}
    number = F.floor(F.col("turn") / block).cast("long")
    rows = placed.groupBy("pair_id", number.alias("block"), "status").agg(*[F.array_sort(F.collect_list(c)).alias(n) for n, c in parts.items()])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["head"], x["body"])), "")

    def spans(c: Column) -> Column:
        def step(t: Column, x: Column) -> Column:
            begin, end = t["at"] + F.length(x["head"]), t["at"] + F.length(x["head"]) + F.length(x["body"])
            return F.struct(end.alias("at"), F.when(x["learn"], F.array_append(t["spans"], F.struct(begin.alias("begin"), end.alias("end")))).otherwise(t["spans"]).alias("spans"))

        return F.aggregate(c, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda t: t["spans"])

    return rows.select(
        "pair_id", "block", "status", F.size("prompt").alias("prompt_turns"), *[text(F.col(n)).alias(n) for n in parts], *[spans(F.col(n)).alias(f"{n}_spans") for n in ("chosen", "rejected")]
    )


def swapped_answers(turns: DataFrame, partner: Column) -> DataFrame:
    """Preference pairs from plain conversations: the chosen side is the conversation itself (pair_id), the rejected side
    has the same turns up to its last answer, whose text is that of the last answer of another conversation.

    ``turns``: conv_id, turn, role, text, one row a turn; ``partner``: an expression over conv_id.  Conversations without
    an answer or without such a partner have no rejected side.
    """
    answers = turns.where(F.col("role").isin(*LEARNED_ROLES)).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = answers.select("conv_id", partner.alias("partner"), F.col("last.turn").alias("last_turn"))
    other = answers.select(F.col("conv_id").alias("partner"), F.col("last.text").alias("other_text"))
    swap = own.join(other, "partner").select("conv_id", "last_turn", "other_text")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    text = F.when(F.col("turn") == F.col("last_turn"), F.col("other_text")).otherwise(F.col("text"))
    rejected = turns.join(swap, "conv_id").where(F.col("turn") <= F.col("last_turn"))
    return chosen.unionByName(rejected.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", text.alias("text")))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the last answer of its neighbour (2k with 2k + 1); spans as text b-e,b-e."""
    turns = one_row_a_turn(table(spark, sf_dir, "conversations"))
    neighbour = F.col("conv_id") + F.when(F.pmod("conv_id", F.lit(2)) == 0, 1).otherwise(-1)
    found = format_pairs(swapped_answers(turns, neighbour))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return found.select("pair_id", "block", "status", "prompt_turns", "prompt", "chosen", "rejected", flat("chosen_spans"), flat("rejected_spans"))


QUERIES = {"op4_preference": op4_preference}
ORACLE = {
    "op4_preference": f"""
WITH one AS (
  SELECT conv_id, turn, t.role AS role, t.text AS text FROM (
    SELECT conv_id, turn, min(struct_pack(role := role, text := text)) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
), answers AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM one WHERE role = 'assistant' GROUP BY conv_id
), swap AS (
  SELECT a.conv_id, a.last_turn, b.last_text FROM answers a JOIN answers b ON b.conv_id = a.conv_id + CASE WHEN a.conv_id % 2 = 0 THEN 1 ELSE -1 END
), slots AS (
  SELECT o.conv_id AS pair_id, o.turn, o.role, o.text AS c_text, s.conv_id IS NOT NULL AND o.turn <= s.last_turn AS in_r, s.conv_id IS NOT NULL AS paired,
         CASE WHEN o.turn = s.last_turn THEN s.last_text ELSE o.text END AS r_text
  FROM one o LEFT JOIN swap s USING (conv_id)
), cuts AS (
  SELECT pair_id, min(turn) FILTER (NOT (in_r AND c_text IS NOT DISTINCT FROM r_text)) AS cut, bool_or(paired) AS paired FROM slots GROUP BY pair_id
), parts AS (
  SELECT pair_id, turn, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block, role, CASE WHEN NOT c.paired THEN 'unpaired' WHEN cut IS NULL THEN 'identical' ELSE 'ok' END AS status,
         cut IS NULL OR turn < cut AS common, in_r, c_text, r_text
  FROM slots JOIN cuts c USING (pair_id)
), e AS (
  SELECT pair_id, block, status, 'prompt' AS part, turn, role, c_text AS text FROM parts WHERE common
  UNION ALL SELECT pair_id, block, status, 'chosen', turn, role, c_text FROM parts WHERE NOT common
  UNION ALL SELECT pair_id, block, status, 'rejected', turn, role, r_text FROM parts WHERE NOT common AND in_r
), s AS (
  SELECT *, '<|turn|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM e
), t AS (
  SELECT *, CAST(sum(length(head || body)) OVER (PARTITION BY pair_id, block, part ORDER BY turn) AS INTEGER) AS upto FROM s
)
SELECT pair_id, block, status, CAST(count(*) FILTER (part = 'prompt') AS INTEGER) AS prompt_turns,
       {", ".join(f"coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (part = '{p}'), '') AS {p}" for p in ("prompt", "chosen", "rejected"))},
       {", ".join(f"coalesce(string_agg((upto - length(body)) || '-' || upto, ',' ORDER BY turn) FILTER (part = '{p}' AND role = 'assistant'), '') AS {p}_spans" for p in ("chosen", "rejected"))}
FROM t GROUP BY pair_id, block, status
"""
}
