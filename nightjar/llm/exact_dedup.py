"""Exact dedup by deterministic block naming (operator 6).

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  The normalised text is cut into blocks of fixed size.
All blocks are sorted (by hash, then by content), and equal blocks get the same
integer name (the number of the sorted range in the high bits, the rank inside
it in the low bits).  Then, level by level, adjacent pairs of names are sorted and named
in the same way until every document has one name.  Two documents are equal
exactly when they reach their single name at the same level and the names are
equal: names stand for content itself, not for a hash of it, so there are no
collisions.

Equal blocks are first brought down to one representative per Arrow batch, so
that a block which a third of all documents hold reaches the sort once per
batch, not once per document; pairs of names are made distinct by a partial
aggregation before they are sorted.  The joins that hand names back are plain
equi-joins, whose skewed partitions Spark splits.

Defined results: a null text counts as empty; all empty texts are one group;
of rows that tie in length and id (repeated rows) the first row of the input
stays; a null doc_id loses every tie.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, materialize, table, with_row_ids
from .textnp import trim

#: Bytes of a block.
BLOCK = 4096
#: Bytes of normalised text among which equal blocks are reduced to one representative.
BATCH_BYTES = 8 << 20
_BLANK = bytes([0x20, *range(0x09, 0x0E)])
_RANK_BITS = 40

_BLOCKS = (
    "_row long, doc_id long, n_points long, text_sha256 string, n_blocks int, i int, rep_row long, rep_i int, block binary"
)


def _cut(block: int):
    """Cut texts into blocks. A document's row has i = -1; the blocks follow, each with its
    representative, and only representatives carry bytes."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        names = ["_row", "doc_id", "n_points", "text_sha256", "n_blocks", "i", "rep_row", "rep_i", "block"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        first: dict[bytes, tuple[int, int]] = {}
        held = 0
        for b in batches:
            for row, doc, text in zip(b.column(0), b.column(1), b.column(2)):
                row, doc, text = row.as_py(), doc.as_py(), text.as_py() or ""
                data = text.encode().translate(None, _BLANK)
                n = max(1, -(-len(data) // block))
                rows.append((row, doc, len(text), hashlib.sha256(data).hexdigest(), n, -1, None, None, None))
                for i in range(n):
                    part = data[i * block : (i + 1) * block]
                    rep = first.setdefault(part, (row, i))
                    new = rep == (row, i)
                    held += len(part) if new else 64
                    rows.append((row, None, None, None, n, i, *rep, part if new else None))
                if held >= BATCH_BYTES:
                    yield flush(rows)
                    rows, first, held = [], {}, 0
            trim()
        if rows:
            yield flush(rows)

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the keys of a sorted range: the first column is the key, the others stay."""
    base, rank, last = TaskContext.get().partitionId() << _RANK_BITS, -1, None
    for b in batches:
        keys = b.column(0).to_pylist()
        names = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            if key != last or rank < 0:
                rank, last = rank + 1, key
            names[k] = base | rank
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names)], [*b.schema.names[1:], "name"])


def _name(df: DataFrame, key: str) -> DataFrame:
    """Sort by ``key`` and replace it by an integer name, equal for equal keys."""
    others = [c for c in df.columns if c != key]
    kinds = dict(df.dtypes)
    hashed = df.select(key, *others, F.xxhash64(key).alias("_hash"))  # ranges are sampled from eight bytes, not from whole blocks
    ordered = hashed.repartitionByRange("_hash").sortWithinPartitions("_hash", key).drop("_hash")
    return ordered.mapInArrow(_ranked, ", ".join(f"{c} {kinds[c]}" for c in others) + ", name long")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, _row): _row, doc_id, n_points, text_sha256
    and the identity (level, name) of its normalised text."""
    cut = materialize(docs.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(_cut(block), _BLOCKS), "blocks")
    names = _name(cut.where("block is not null").select("block", F.col("_row").alias("rep_row"), F.col("i").alias("rep_i")), "block")
    level = 0
    current = materialize(cut.where("i >= 0").select("_row", "n_blocks", "i", "rep_row", "rep_i").join(names, ["rep_row", "rep_i"]).select("_row", F.col("n_blocks").alias("n"), "i", "name"), "names")
    done = [current.where("n = 1").select("_row", F.lit(0).alias("level"), "name")]
    while (current := current.where("n > 1")).select("n").head(1):
        level += 1
        even = F.col("i") % 2 == 0
        pairs = current.groupBy("_row", F.shiftright("i", 1).alias("i"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")
        )
        named = _name(pairs.select("left", "right").distinct().select(F.struct("left", "right").alias("pair"), "left", "right"), "pair")
        current = materialize(pairs.join(named, ["left", "right"]).select("_row", "n", "i", "name"), "names")
        done.append(current.where("n = 1").select("_row", F.lit(level).alias("level"), "name"))
    found = done[0]
    for d in done[1:]:
        found = found.unionAll(d)
    rows = cut.where("i = -1").select("_row", "doc_id", "n_points", "text_sha256")
    return rows.join(found, "_row")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs``: the row that stays for its text, and the group's size.

    Columns: _row, doc_id, keep_row, keep_id, group_size, kept, text_sha256, n_points.
    """
    rows = identities(docs, block)
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d"))
    best = rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    return rows.join(best, ["level", "name"]).select(
        "_row", "doc_id", F.col("best.d").alias("keep_row"), F.col("best.c").alias("keep_id"), "group_size", (F.col("_row") == F.col("best.d")).alias("kept"), "text_sha256", "n_points"
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    return filtered(docs, lambda d: d.join(groups(d, block).where("kept").select("_row"), "_row", "left_semi"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
}
