"""Merkle manifest of a dataset (operator 12).

Every row is a leaf; the leaves of a group stand in the order of a key, every ``fanout``
consecutive nodes become one of the next level (the last run may be shorter, even one), until one
is left, the group's root.  The roots of the groups, in the order of the groups, are the leaves of one more tree.

1. The leaves (digests, not texts) are sorted by group and key into range partitions of about PART_ROWS
   rows.  A partition's place in its group follows from the counts of the partitions before it, so each is
   indexed: it knows the index of its first leaf, and the number of leaves of the group.
2. Each partition runs a stack of mountains: a leaf that completes a run of ``fanout`` siblings is carried
   as their parent, as in counting to base ``fanout``.  What is complete but lacks siblings is a peak: those at an unaligned
   beginning or end, a few per level.  A run that ends with the group's last leaf is short and is
   hashed as it is, without padding, as the number of leaves says where the last node of each level is.
3. The peaks of all partitions, sorted by their first leaf, go through the same stack, PEAKS of them to a
   task, until each group has its root; nodes made there are recorded.
4. Proofs: a partition makes its own nodes again and gets from the records the siblings that it
   lacks (at most two runs per level), by a cogroup on the partition.

Leaves of one group spread over any number of partitions, repeated rows too (ties are
broken by the place of the row), and no task holds more than about PART_ROWS leaves or PEAKS peaks.

Defined results: null fields are written as ``-``; null groups form a group of their own that
comes first; null keys come first in their group; rows of one key stand in the order of
their leaves, exact repeats give a row each; a group of one leaf has that leaf as
root, one group alone has its root as the root of all; an empty table gives no rows; columns that
are not named as fields play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, materialize, table, with_row_ids

#: Leaves of a range partition, on average, and peaks that one task merges.
PART_ROWS, PEAKS = 65_536, 65_536
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "g string, n long, level int, idx long, digest string, kind string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` or its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """Text that sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


class Mountains:
    """The stack: nodes come in the order of their first leaves, complete runs are carried upwards.

    ``open`` has, per level, the children so far of a parent whose first child was seen.
    """

    def __init__(self, fanout: int, record: bool) -> None:
        self.fanout, self.record, self.group, self.n, self.out = fanout, record, None, 0, []
        self.open: dict[int, tuple[int, list[str]]] = {}

    def emit(self, level: int, idx: int, digest: str, kind: str) -> None:
        self.out.append((self.group, self.n, level, idx, digest, kind))

    def close(self) -> None:
        """No more nodes of this group: what waits for siblings is a peak."""
        for level, (first, run) in self.open.items():
            for k, digest in enumerate(run):
                self.emit(level, first + k, digest, "peak")
        self.open = {}

    def add(self, group: str, n: int, level: int, idx: int, digest: str) -> None:
        if group != self.group:
            self.close()
            self.group, self.n = group, n
        while True:
            many = -(-n // self.fanout**level)  # nodes of this level
            if many == 1:
                return self.emit(level, 0, digest, "root")
            first, run = self.open.get(level, (None, []))
            if run and first + len(run) == idx and idx % self.fanout:
                run.append(digest)
            else:
                for k, waiting in enumerate(run):
                    self.emit(level, first + k, waiting, "peak")
                self.open.pop(level, None)
                if idx % self.fanout:
                    return self.emit(level, idx, digest, "peak")
                run = [digest]
                self.open[level] = (idx, run)
            if len(run) < self.fanout and idx < many - 1:
                return None
            del self.open[level]
            level, idx, digest = level + 1, idx // self.fanout, sha("".join(run))
            if self.record:
                self.emit(level, idx, digest, "node")

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["g", "n", "level", "idx", "digest", "kind"])


def _climb(fanout: int, record: bool):
    """Sorted nodes (part, g, n, level, idx, digest) -> the peaks, the roots and, if asked for, the records of all nodes made;
    nothing is merged across parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = Mountains(fanout, record), None
        for b in batches:
            for part, *node in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part != at:
                    stack.close()
                    at = part
                stack.add(*node)
            if len(stack.out) > 10_000:
                yield stack.taken()
        stack.close()
        yield stack.taken()

    return run


@dataclass
class Tree:
    """Indexed leaves, the runs of the partitions, and the nodes that proofs look up; all are tables in the shared folder."""

    fanout: int
    leaves: DataFrame  # part, g, n, idx, leaf and what else came with the leaf
    runs: DataFrame  # part, g, n, s (first index), e (behind the last)
    nodes: DataFrame  # g, level, idx, digest: peaks and all that was made of them
    roots: DataFrame  # g, digest

    def records(self) -> DataFrame:
        """Every inner node: (g, level, idx, digest)."""
        inner = _sorted_leaves(self).mapInArrow(_climb(self.fanout, True), _NODES).where("kind = 'node'").select("g", "level", "idx", "digest")
        return inner.unionByName(self.nodes.where("level > 0")).distinct()


def _sorted_leaves(tree: Tree) -> DataFrame:
    return tree.leaves.select("part", "g", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")).sortWithinPartitions("part", "g", "idx")


def tree(leaves: DataFrame, order: list[str], fanout: int = 2, part_rows: int = PART_ROWS, peaks: int = PEAKS) -> Tree:
    """The trees of ``leaves`` (g: string, leaf: string, and the columns of ``order``), one per value of ``g``."""
    parts = max(1, -(-leaves.count() // part_rows))
    by = ["g", *order]
    placed = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "leaves")
    counts = placed.groupBy("part", "g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = materialize(_before(counts), "runs")
    offsets = runs.select("part", "g", "n", "s", "_first")
    near = F.broadcast(offsets) if runs.count() <= BROADCAST_ROWS else offsets
    indexed = placed.join(near, ["part", "g"]).withColumn("idx", F.col("s") + F.col("_at") - F.col("_first")).drop("_at", "_first", "s")
    built = Tree(fanout, indexed, runs.select("part", "g", "n", "s", "e"), None, None)
    first = materialize(_sorted_leaves(built).mapInArrow(_climb(fanout, False), _NODES), "peaks")
    kept, waiting = [first], first.where("kind = 'peak'")
    left, before = waiting.count(), None
    while left:
        tasks = -(-left // peaks)
        if before is not None and left >= before[0]:  # cannot go on: fewer and larger tasks
            tasks = min(tasks, max(1, before[1] // 2))
        before = (left, tasks)
        start = (F.col("idx") * F.pow(F.lit(float(fanout)), F.col("level")).cast("long")).alias("_start")
        rows = waiting.select(F.lit(0).alias("part"), "g", "n", "level", "idx", "digest", start)
        rows = (rows.coalesce(1) if tasks == 1 else rows.repartitionByRange(tasks, "g", "_start")).sortWithinPartitions("g", "_start", "level").drop("_start")
        made = materialize(rows.mapInArrow(_climb(fanout, True), _NODES), "peaks")
        kept.append(made)
        waiting = made.where("kind = 'peak'")
        left = waiting.count()
    nodes, roots = first.where("kind <> 'node'"), first
    for made in kept[1:]:
        nodes, roots = nodes.unionByName(made.where("kind = 'node'")), roots.unionByName(made)
    built.nodes = nodes.select("g", "level", "idx", "digest")
    built.roots = roots.where("kind = 'root'").select("g", "digest")
    return built


def _before(counts: DataFrame) -> DataFrame:
    """``counts`` with the leaves of the group before each part (s), up to its end (e), and in all (n).

    A group's parts are summed in two steps, by blocks of 1024 parts and within them, so that a window has 1024 rows, or
    one for 1024 parts.
    """
    blocks = counts.groupBy("g", F.expr("part div 1024").alias("_block")).agg(F.sum("_n").alias("_m"))
    in_order = Window.partitionBy("g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("g", "_block", F.coalesce(F.sum("_m").over(in_order), F.lit(0)).alias("_base"), F.sum("_m").over(Window.partitionBy("g")).alias("n"))
    in_block = Window.partitionBy("g", "_block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_block", F.expr("part div 1024")).withColumn("_own", F.coalesce(F.sum("_n").over(in_block), F.lit(0)))
    return rows.join(blocks, ["g", "_block"]).select("part", "g", "n", "_first", (F.col("_base") + F.col("_own")).alias("s"), (F.col("_base") + F.col("_own") + F.col("_n")).alias("e"))


def _wanted(t: Tree) -> DataFrame:
    """(part, g, level, idx, digest): the siblings of the first and of the last node of each part on each level, as far as recorded."""
    levels = t.runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")).withColumn("w", F.pow(F.lit(float(t.fanout)), F.col("level")))
    levels = levels.where("w < n").withColumn("w", F.col("w").cast("long"))
    run = "sequence(({0} div w) div {1} * {1}, least(({0} div w) div {1} * {1} + {1} - 1, (n - 1) div w))"
    both = F.expr(f"array_distinct(concat({run.format('s', t.fanout)}, {run.format('(e - 1)', t.fanout)}))")
    return levels.select("part", "g", "level", F.explode(both).alias("idx")).join(t.nodes, ["g", "level", "idx"]).select("part", "g", "level", "idx", "digest")


class Local:
    """The nodes that a partition's run of leaves completes, and the recorded ones around it."""

    def __init__(self, fanout: int, n: int, first: int, leaves: list[str], others: dict[tuple[int, int], str]) -> None:
        self.fanout, self.others, self.counts, self.levels = fanout, others, [n], [(first, leaves)]
        while self.counts[-1] > 1:
            (lo, nodes), many = self.levels[-1], self.counts[-1]
            hi = lo + len(nodes)
            begin, end = -(-lo // fanout), -(-hi // fanout) if hi == many else hi // fanout
            self.levels.append((begin, [sha("".join(nodes[p * fanout - lo : (p + 1) * fanout - lo])) for p in range(begin, end)]))
            self.counts.append(-(-many // fanout))

    def get(self, level: int, idx: int) -> str:
        lo, nodes = self.levels[level]
        return nodes[idx - lo] if lo <= idx < lo + len(nodes) else self.others[level, idx]

    def paths(self, top: tuple) -> Iterator[tuple]:
        """For each leaf its path to the root, ((left siblings, right siblings), rest), nested from the leaf upwards; ``top`` is the path above."""
        depth = len(self.counts) - 1
        at, path = [-1] * depth, [top] * (depth + 1)
        first, leaves = self.levels[0]
        for leaf_idx in range(first, first + len(leaves)):
            places, i = [], leaf_idx
            for level in range(depth):
                if at[level] == i:
                    break
                places.append(i)
                i //= self.fanout
            for level in range(len(places) - 1, -1, -1):
                i = at[level] = places[level]
                begin = i // self.fanout * self.fanout
                end = min(begin + self.fanout, self.counts[level])
                sides = ("".join(self.get(level, j) for j in range(begin, i)), "".join(self.get(level, j) for j in range(i + 1, end)))
                path[level] = (sides, path[level + 1])
            yield path[0]


def steps(path: tuple) -> Iterator[tuple[str, str]]:
    while path:
        side, path = path
        yield side


def fold(digest: str, path: tuple) -> str:
    """The root that follows from a leaf and the siblings on its path."""
    for left, right in steps(path):
        digest = sha(left + digest + right)
    return digest


_ABOVE = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("left", "right")] + [T.StructField(n, T.StringType()) for n in ("subroot", "root")])


def _each_run(fanout: int, left: pa.Table, right: pa.Table) -> Iterator[tuple[dict[str, list], Iterator[tuple], dict | None]]:
    """Per group of a part: its leaves' columns in order, their paths, and what stands above the group's root."""
    others: dict[str, dict] = {}
    above: dict[str, dict] = {}
    for r in right.to_pylist():
        if r["digest"] is None:
            above[r["g"]] = r["above"]
        else:
            others.setdefault(r["g"], {})[r["level"], r["idx"]] = r["digest"]
    left = left.sort_by([("g", "ascending"), ("idx", "ascending")])
    columns = {c: left.column(c).to_pylist() for c in left.column_names}
    groups, at = columns["g"], 0
    while at < len(groups):
        end = at
        while end < len(groups) and groups[end] == groups[at]:
            end += 1
        run = {c: v[at:end] for c, v in columns.items()}
        over, top = above.get(groups[at]), ()
        for side in reversed(list(zip(over["left"], over["right"], strict=True)) if over else []):
            top = (side, top)
        yield run, Local(fanout, run["n"][0], run["idx"][0], run["leaf"], others.get(groups[at], {})).paths(top), over
        at = end


def _cogroup(t: Tree, right: DataFrame, make, schema: str) -> DataFrame:
    """``make`` on each part's leaves and the rows of ``right`` for it."""
    return t.leaves.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(make, schema)


def _siblings(t: Tree) -> DataFrame:
    return _wanted(t).select("part", "g", "level", "idx", "digest", F.lit(None).cast(_ABOVE).alias("above"))


def _above(top: Tree) -> DataFrame:
    """(g, above): for each group the path from its root to the root of all."""
    fanout = top.fanout

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for run, paths, _ in _each_run(fanout, left, right):
            for group, digest, path in zip(run["group"], run["leaf"], paths, strict=True):
                sides = list(steps(path))
                rows.append((group, [a for a, _ in sides], [b for _, b in sides], digest, fold(digest, path)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["g", "left", "right", "subroot", "root"])

    found = _cogroup(top, _siblings(top), make, "g string, left array<string>, right array<string>, subroot string, root string")
    return materialize(found.select("g", F.struct("left", "right", "subroot", "root").alias("above")), "above")


_PROOFS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None, when: Column | None = None,
             fanout: int = 2, part_rows: int = PART_ROWS, peaks: int = PEAKS) -> DataFrame:
    """Per row of ``docs``: the key, its leaf, its group's root, the root of all, the digest of its proof, and the root that its proof gives.

    ``tampered`` replaces fields by other values in rows for which ``when`` holds; their leaves are then folded with the proofs of the
    original rows, which ``verified`` has to betray.
    """
    named = [F.col(f"`{f}`") for f in fields]
    other = [(tampered or {}).get(f, c) for f, c in zip(fields, named, strict=True)]
    rows = with_row_ids(docs, "_row_of_leaf").select(
        F.col(f"`{key}`").alias("key"), group_key(F.col(f"`{group}`")).alias("g"), leaf(named).alias("leaf"), "_row_of_leaf",
        (F.when(when, leaf(other)) if tampered and when is not None else F.lit(None).cast("string")).alias("changed"),
    )
    t = tree(materialize(rows, "digests"), ["key", "leaf", "_row_of_leaf"], fanout, part_rows, peaks)
    top = tree(t.roots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("digest").alias("leaf")), ["group"], fanout, part_rows, peaks)
    above = _above(top)
    reach = t.runs.select("part", "g").join(above, "g").select("part", "g", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("digest"), "above")
    kind = t.leaves.schema["key"].dataType

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for run, paths, over in _each_run(fanout, left, right):
            for k, (digest, changed, path) in enumerate(zip(run["leaf"], run["changed"], paths, strict=True)):
                folded = fold(changed or digest, path)
                proof = sha("".join(a + b for a, b in steps(path)))
                for column, value in zip(out, (run["key"][k], digest, over["subroot"], over["root"], proof, folded, folded == over["root"]), strict=True):
                    column.append(value)
        types = [left.schema.field("key").type, *[pa.string()] * 5, pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    found = _cogroup(t, _siblings(t).unionByName(reach), make, f"key {kind.simpleString()}, {_PROOFS}")
    return found.withColumnRenamed("key", key)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": F.col("n_chars") + 1}, when=tamper)


def _tree_sql(name: str, source: str) -> str:
    """Levels of the trees of ``source`` (g, idx, n, d), halved until one node is left."""
    return f"""{name} AS (
  SELECT g, 0 AS level, idx, d, n FROM {source}
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, idx // 2)"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: xor(b >> 1, 3988292384 * (b & 1)))))"""
_STEP_SQL = "{{'l': coalesce(string_agg(s.d, '') FILTER (s.idx < x.idx >> x.level), ''), 'r': coalesce(string_agg(s.d, '') FILTER (s.idx > x.idx >> x.level), '')}}"


def _path_sql(source: str, nodes: str) -> str:
    """For each leaf of ``source`` the list of its siblings, level by level."""
    return f"""SELECT g, idx, list(step ORDER BY level) AS path FROM (
    SELECT x.g, x.idx, x.level, {_STEP_SQL.format()} AS step
    FROM (SELECT l.g, l.idx, v.level FROM {source} l JOIN (SELECT DISTINCT g, level FROM {nodes} WHERE n > 1) v USING (g)) x
    LEFT JOIN {nodes} s ON s.g = x.g AND s.level = x.level AND s.idx = xor(x.idx >> x.level, 1) GROUP BY ALL) GROUP BY ALL"""


ORACLE_12 = f"""WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS d, CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM rows_),
{_tree_sql("nodes", "leaves")},
subs AS (SELECT '' AS g, g AS lang_g, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql("tops", "subs")},
paths AS ({_path_sql("leaves", "nodes")}),
top_paths AS ({_path_sql("subs", "tops")}),
whole AS (
  SELECT l.doc_id, l.d AS leaf, coalesce(l.changed, l.d) AS given, s.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subs s ON s.lang_g = l.g LEFT JOIN paths p ON p.g = l.g AND p.idx = l.idx LEFT JOIN top_paths t ON t.idx = s.idx),
folded AS (SELECT *, list_reduce(list_prepend({{'l': given, 'r': ''}}, path), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded"""

QUERIES = {"op12_manifest": op12_manifest}
ORACLE = {"op12_manifest": ORACLE_12}
