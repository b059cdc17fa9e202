"""Connected components of a graph given by its edges.

First every task contracts a bounded number of edges to a star forest by
union-find.  If the edges fit into one such task that is the result; otherwise
alternating large-star and small-star steps on DataFrames join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges that one task contracts.
TASK_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (u, v): each node with the smallest node it reaches among this task's edges."""
    edges = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not edges:
        return
    nodes, index = np.unique(np.concatenate(edges), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in index.reshape(-1, 2).tolist():
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # parents come before their children
        up[x] = up[up[x]]
    root = nodes[np.array(up)]
    own = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: each node hands its neighbours to the smallest of them."""
    if small:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    else:
        near = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(pairs.join(low, "u").where("v > u").select("u", "v"))
        moved = moved.unionAll(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges`` (a, b: long) -> (node, label): the smallest node that each node with an edge can reach;
    nodes that are their own label are left out.

    Each round is written to the shared folder; the driver only sees counts and a checksum.
    """
    pairs = materialize(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    tasks = -(-pairs.count() // task_edges)
    dealt = pairs.coalesce(1) if tasks <= 1 else pairs.repartition(tasks)
    stars = materialize(dealt.mapInArrow(_contract, "u long, v long"), "stars")
    discard(pairs)
    if tasks > 1:
        seen = None
        while True:
            state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            if state == seen:
                break
            seen, older = state, stars
            stars = materialize(_star(_star(stars, small=False), small=True), "stars")
            discard(older)
        stars = stars.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
