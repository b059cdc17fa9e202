"""Hard negatives for contrastive training, by a norm-bucketed search for inner products (operator 13).

The vectors are sorted by norm, longest first, and cut into buckets of about BUCKET_BYTES whose
largest norms are known.  By Cauchy-Schwarz no row of a bucket scores above |anchor| times that norm, so

* positives (the best rows of the anchor's label): a bucket is left out once this bound is below the
  anchor's running score at the last rank;
* negatives (the best rows of another label within a window of scores): a bucket is left out once the bound
  is below the lower limit of each window, or below the running score at each window's last rank.

Anchors are a stated query set.  They meet the buckets in blocks: a block of anchors (BLOCK_BYTES) and BUCKETS consecutive
buckets are a cell, matrix products in one task.  The cells of the longest vectors are searched first; what each
anchor finds there are the running scores that its other cells start with, and cells that the bounds
rule out for a whole block are never shuffled (by the norms of at most TIERS runs of buckets, which is all the driver
sees).  Inside a cell the running scores go on from bucket to bucket.  A cell returns as many rows per list as the list
is long, and these are merged by rank.  The result is exact: a bound only leaves out what cannot be in it.

Range partitions by norm, id and place make the buckets, so copies of one vector, and hot norms and labels, spread over many of them.
A task holds one cell.

Components become floor(scale * x).  Products are made in doubles where no sum can pass 2**53, else in Python
integers, so they are exact; scores have to fit a long.  Defined results: rows with a null id, a null label, a null vector or
a null or non-finite component take no part; missing components of shorter vectors count as 0; each row of a repeated id counts on
its own (as an anchor, too, and as the positive of its copy), ranked by id and then by place; fewer rows than ranks are all
returned; an anchor without positives has no rows, nor has a window without rows (that of a negative score is empty); an empty table gives
no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, with_row_ids

#: Bytes of a bucket's and of a block's components as doubles, buckets of a cell, anchors of one matrix product.
BUCKET_BYTES, BLOCK_BYTES, BUCKETS, TOGETHER = 1 << 21, 1 << 24, 2, 256
#: Runs of buckets whose norms the driver knows, at most.
TIERS = 1024
#: Doubles hold every sum below this exactly.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Mining:
    """Ranks of positives and negatives, the window low * positive <= 100 * negative <= high * positive, and the scale of components."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def prepared(rows: DataFrame, label: Column, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, label, q, norm2) of the rows that take part."""
    named = with_row_ids(rows, "_row_of_vector").select(F.col("_row_of_vector").alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    taken = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(fine)
    taken = taken.select("row", "vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))
    return taken.withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


@dataclass
class Buckets:
    """The vectors by descending norm, and the largest squared norm and last bucket of each tier."""

    rows: DataFrame  # row, vec_id, label, q, norm2, bucket, grp
    width: int  # components of the longest vector
    tiers: list[tuple[float, int]]
    anchors: DataFrame  # row, vec_id, label, q, norm2, block


def bucketed(vectors: DataFrame, anchors: Column) -> Buckets:
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(anchors, 1)).alias("a"), F.max(F.size("q")).alias("d")).first()
    width = max(1, sizes["d"] or 1)
    many = max(1, -(-sizes["n"] * width * 8 // BUCKET_BYTES))
    by = [F.col("norm2").desc(), F.col("vec_id"), F.col("row")]
    rows = materialize(vectors.repartitionByRange(many, *by).withColumn("bucket", F.spark_partition_id()).withColumn("grp", F.expr(f"bucket div {BUCKETS}")), "buckets")
    tier = F.expr(f"bucket div {-(-max(many, 1) // TIERS)}")
    tiers = [(r["m"], r["b"]) for r in rows.groupBy(tier.alias("t")).agg(F.max("norm2").alias("m"), F.max("bucket").alias("b")).orderBy("t").collect()]
    blocks = max(1, -(-sizes["a"] * width * 8 // BLOCK_BYTES))
    asked = materialize(rows.where(anchors).drop("bucket", "grp").repartitionByRange(blocks, *by).withColumn("block", F.spark_partition_id()), "anchors")
    return Buckets(rows, width, tiers, asked)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, earlier places first among equals."""
    if len(scores) > most:
        last = np.partition(scores, len(scores) - most)[len(scores) - most]
        above = np.flatnonzero(scores > last)
        return np.concatenate([above, np.flatnonzero(scores == last)[: most - len(above)]])
    return np.arange(len(scores))


def search(anchors: pa.Table, rows: pa.Table, width: int, most: int, same: bool) -> list[tuple[int, int, int, int, int]]:
    """(anchor row, list, score, vec_id, row): for each list of each anchor the best rows of a cell.

    An anchor has parallel arrays ``lows``, ``highs`` (limits of a list's scores, null for none) and ``kths`` (the running score at the
    last rank, null if the list is not full); ``same`` asks for rows of the anchor's label, else for those of any other.
    """
    qa, na = _matrix(anchors.column("q"), width), anchors.column("norm2").to_numpy()
    own, labels = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    lists = [[(lo, hi, kth) for lo, hi, kth in zip(*x, strict=True)] for x in zip(*[anchors.column(c).to_pylist() for c in ("lows", "highs", "kths")], strict=True)]
    held: list[list[list]] = [[[] for _ in x] for x in lists]
    inf = float("inf")
    floor = [[max(-inf if lo is None else lo, -inf if kth is None else kth) for lo, _, kth in x] for x in lists]
    rows = rows.sort_by([("bucket", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
    buckets = rows.column("bucket").to_numpy()
    edges = np.concatenate([np.flatnonzero(np.diff(buckets, prepend=-1)), [len(buckets)]])
    for begin, end in zip(edges, edges[1:], strict=False):
        part = rows.slice(begin, end - begin)
        qc, nc = _matrix(part.column("q"), width), float(part.column("norm2").to_numpy().max())
        ids, places, of = (part.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        reach = np.sqrt(na) * np.sqrt(nc) * (1 + 1e-9) + 1
        active = np.array([k for k, f in enumerate(floor) if f and reach[k] >= min(f)], np.int64)
        exact = reach.max() < EXACT
        right = qc.T.astype(np.float64) if exact else qc.T.astype(object)
        for at in range(0, len(active), TOGETHER if exact else 1):
            block = active[at : at + (TOGETHER if exact else 1)]
            table_ = qa[block].astype(right.dtype) @ right
            for k, scores in zip(block.tolist(), table_, strict=True):
                taken = np.flatnonzero((of == labels[k]) & (places != own[k]) & (scores >= min(floor[k])) if same else (of != labels[k]) & (scores >= min(floor[k])))
                found = scores[taken]
                for j, (_, high, _) in enumerate(lists[k]):
                    inside = np.flatnonzero((found >= floor[k][j]) if high is None else (found >= floor[k][j]) & (found <= high))
                    if not len(inside):
                        continue
                    inside = inside[best(found[inside], most)]
                    chosen = taken[inside]
                    merged = sorted(held[k][j] + [(-int(s), int(i), int(p)) for s, i, p in zip(found[inside], ids[chosen], places[chosen], strict=True)])[:most]
                    held[k][j] = merged
                    if len(merged) == most:
                        floor[k][j] = max(floor[k][j], -merged[-1][0])
    return [(int(own[k]), j, -s, i, p) for k, x in enumerate(held) for j, y in enumerate(x) for s, i, p in y]


_FOUND = "anchor_row long, list int, score long, vec_id long, row long"


def _cells(b: Buckets, asked: DataFrame, cells: DataFrame, most: int, same: bool) -> DataFrame:
    """What ``search`` finds in the cells (block, grp) for the anchors ``asked`` (with lows, highs, kths)."""
    width = b.width

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out = search(left, right, width, most, same) if left.num_rows and right.num_rows else []
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["anchor_row", "list", "score", "vec_id", "row"])

    # keys of one type on both sides: an int and a long of one value are dealt to different tasks, and a cell would lose its rows
    cells = cells.select(F.col("block").cast("long").alias("block"), F.col("grp").cast("long").alias("grp"))
    left = asked.join(cells, "block").select(F.col("block").cast("long").alias("of_block"), F.col("grp").cast("long").alias("of_grp"), "row", "label", "q", "norm2", "lows", "highs", "kths")
    right = b.rows.join(cells, "grp").select("block", F.col("grp").cast("long").alias("grp"), "bucket", "row", "vec_id", "label", "q", "norm2")
    return left.groupBy("of_block", "of_grp").cogroup(right.groupBy("block", "grp")).applyInArrow(make, _FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "list").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _lists(b: Buckets, asked: DataFrame, most: int, same: bool) -> DataFrame:
    """(anchor_row, list, score, vec_id, row, rank) over all buckets; ``asked`` has the anchors with lows and highs."""
    none = F.transform("lows", lambda _: F.lit(None).cast("long"))
    first = materialize(asked.select("block").distinct().withColumn("grp", F.lit(0)), "cells")
    found = _ranked(_cells(b, asked.withColumn("kths", none), first, most, same), most)
    last_bucket = b.tiers[-1][1] if b.tiers else 0
    if last_bucket < BUCKETS:
        return materialize(found, "ranks")
    found = materialize(found.select("anchor_row", "list", "score", "vec_id", "row"), "ranks")
    full = found.groupBy("anchor_row", "list").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == most)
    full = full.groupBy(F.col("anchor_row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("list", "kth"))).alias("_full"))
    kths = F.transform(F.sequence(F.lit(0), F.size("lows") - 1), lambda i: F.when(F.col("_full").isNotNull(), F.try_element_at("_full", i)))
    asked = asked.join(full, "row", "left").withColumn("kths", F.when(F.size("lows") > 0, kths).otherwise(none)).drop("_full")
    # the least score that still counts for an anchor, the squared norm that a row needs for it, and the last tier of the block with such rows
    need = F.array_min(F.zip_with("lows", "kths", lambda lo, kth: F.greatest(F.coalesce(lo.cast("double"), F.lit(float("-inf"))), F.coalesce(kth.cast("double"), F.lit(float("-inf")))))) - 1
    norm = F.when(need <= 0, 0.0).when(F.col("norm2") == 0, float("inf")).otherwise(need * need / F.col("norm2") * (1 - 1e-6))
    tops, ends = (F.array(*[F.lit(x) for x in column]) for column in zip(*b.tiers, strict=True))
    reach = F.size(F.filter(tops, lambda m: m >= F.col("_norm")))
    blocks = asked.where(F.size("lows") > 0).groupBy("block").agg(F.min(norm).alias("_norm")).withColumn("_tier", reach).where("_tier > 0")
    last = F.floor(F.element_at(ends, F.col("_tier")) / BUCKETS).cast("int")
    cells = blocks.withColumn("_last", last).where("_last >= 1").select("block", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("grp"))
    rest = _cells(b, asked, materialize(cells, "cells"), most, same)
    return materialize(_ranked(found.unionByName(rest), most), "ranks")


def mine(rows: DataFrame, anchors: Column, label: Column | None = None, mining: Mining = Mining(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` (over ``vec_id`` and
    ``label``) holds; ``label`` is an expression over ``rows``, their column ``label`` if not given."""
    b = bucketed(materialize(prepared(rows, F.col("label") if label is None else label, mining.scale, vec_id, vector), "vectors"), anchors)
    no_limit = F.array(F.lit(None).cast("long"))
    positives = _lists(b, b.anchors.withColumn("lows", no_limit).withColumn("highs", no_limit), mining.positives, same=True)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "score")))  # mining.positives entries at most
    windows = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(in_order, lambda x: x["score"]).alias("_scores"))
    # integer limits: the window's lower one rounded up, its upper one down
    down = "{0} * ((s - pmod(s, 100)) div 100) + ({0} * pmod(s, 100) - pmod({0} * pmod(s, 100), 100)) div 100"  # no product above the result
    asked = b.anchors.join(windows, "row").withColumn("lows", F.expr(f"transform(_scores, s -> -({down.format(-mining.low)}))"))
    asked = asked.withColumn("highs", F.expr(f"transform(_scores, s -> {down.format(mining.high)})")).drop("_scores")
    negatives = _lists(b, asked, mining.negatives, same=False)
    of = positives.select("anchor_row", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = b.anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    found = negatives.select("anchor_row", "list", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(of, ["anchor_row", "list"]).join(ids, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_13 = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": ORACLE_13}
