"""Process lineage: nodes, parents, phantom parents, descendants.

A parent is the latest process with the declared pid on the same host that
started no later than its child and, when the child names its parent, carries
that name.  The as-of lookup is a window over the union of candidates and
children, sorted by time, so its cost does not depend on how often a pid is
reused, and in spans of time, so that a hot pid is no single task.  A declared parent that was never seen becomes a phantom node.  Exact
repeats of an event (a log line written twice) make one node.

Every node has one parent at most, so all ancestors up to a depth are found by
doubling: from the ancestors less than 2**k steps up and the nodes 2**k steps up
come those less than 2**(k+1) steps up: about twice seven equi-joins for a depth
of 64, and fewer where no lineage is that deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host_of, process_basename, strip
from ..storage import materialize

MAX_DEPTH = 64
#: Parts of the whole time in which parents are looked up on their own, at most, and events of one on average.
SPANS, SPAN_ROWS = 256, 1_000_000
NODE = ["host", "key", "event_id", "pid", "process_name", "name_norm", "platform", "ts", "command_line", "user", "is_phantom", "parent_key"]


def host_column() -> Column:
    """The host of an event, from its column or its raw record."""
    return F.when(F.coalesce(F.col("host"), F.lit("")) != "", F.lower(F.regexp_replace(strip(F.col("host")), r"\.+$", ""))).otherwise(host_of(F.col("raw")))


def _nodes(events: DataFrame, dense_keys: bool) -> DataFrame:
    rows = events.select(
        host_column().alias("host"), "event_id", F.col("process_id").alias("pid"), "process_name", process_basename(F.col("process_name"), F.col("platform")).alias("name_norm"),
        "platform", "ts", "command_line", "user", F.col("parent_process_id").alias("ppid"), strip(F.col("parent_process_name")).alias("parent_name"),
    )
    place = F.col("event_id")
    if dense_keys:
        place = F.row_number().over(Window.partitionBy("host").orderBy("ts", F.coalesce("pid", F.lit(-1)), "event_id")) - 1
    rows = rows.withColumn("_place", place)
    rows = rows.withColumn("key", F.concat_ws("|", "host", F.coalesce(F.col("pid").cast("string"), F.lit("None")), F.col("_place").cast("string"))).drop("_place")
    return rows.repartition("key").distinct()  # the joins by key need the same partitioning


def _latest(children: DataFrame, nodes: DataFrame, named: bool, span: Column, spans: int) -> DataFrame:
    """(child key, parent key) by an as-of lookup over (host, pid[, name]), in two levels.

    Time is cut into spans; inside a span of a key a window finds the last candidate, and what each span hands
    on is its very last one.  So a pid with many events (0, where none is known) spreads over as many tasks as it has
    spans, and the window that carries candidates over has a row for each span.
    """
    by = ["host", "p", *(["n"] * named)]
    nodes = nodes.where("pid IS NOT NULL").select("host", F.col("pid").alias("p"), F.col("name_norm").alias("n"), "ts", "event_id", "key", span.alias("span"))
    before = F.lag("key").over(Window.partitionBy(*by, "span").orderBy("ts", "event_id"))
    cands = nodes.select("host", "p", "n", "span", "ts", "event_id", F.lit(0).alias("kind"), F.struct("key", before.alias("before")).alias("cand"), F.lit(None).cast("string").alias("child"))
    expected = process_basename(F.col("parent_name"), F.col("platform"))
    kids = children.select("host", F.col("ppid").alias("p"), expected.alias("n"), span.alias("span"), "ts", "event_id", F.lit(1).alias("kind"), F.lit(None).cast(cands.schema["cand"].dataType).alias("cand"), F.col("key").alias("child"))
    seen = F.last("cand", ignorenulls=True).over(Window.partitionBy(*by, "span").orderBy("ts", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    found = cands.unionByName(kids).withColumn("seen", seen).where("kind = 1")
    if spans == 1:  # nothing to carry over
        parent = F.when(F.col("seen.key") == F.col("child"), F.col("seen.before")).otherwise(F.col("seen.key"))
        return found.select(F.col("child").alias("key"), parent.alias("parent_key")).where("parent_key IS NOT NULL")
    parts = nodes.select(*by, "span", "key", F.struct("ts", "event_id").alias("at")).unionByName(kids.select(*by, "span"), allowMissingColumns=True)
    ends = parts.groupBy(*by, "span").agg(F.max_by("key", "at").alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    found = found.join(ends.select(*by, "span", carried.alias("carried")).where("carried IS NOT NULL"), [*by, "span"], "left")
    own = F.col("seen.key") == F.col("child")  # a process is not its own parent
    parent = F.when(own, F.coalesce("seen.before", "carried")).otherwise(F.coalesce("seen.key", "carried"))
    return found.select(F.col("child").alias("key"), parent.alias("parent_key")).where("parent_key IS NOT NULL")


def _spans(nodes: DataFrame) -> tuple[Column, int]:
    """The span of a row's time, one of equal parts of all times, and how many there are: one for SPAN_ROWS events, SPANS at most."""
    n, lo, hi = nodes.agg(F.count(F.lit(1)), F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    spans = max(1, min(SPANS, -(-n // SPAN_ROWS)))
    return F.floor((F.unix_micros("ts") - (lo or 0)) / (((hi or 0) - (lo or 0)) // spans + 1)).cast("int"), spans


def _placed(events: DataFrame, dense_keys: bool = False) -> DataFrame:
    """The nodes of events with their parents; ``orphan`` marks those whose parent was never seen."""
    nodes = materialize(_nodes(events, dense_keys), "nodes")  # read by each branch below
    unnamed = nodes.where("ppid IS NOT NULL AND parent_name = ''")
    named = nodes.where("ppid IS NOT NULL AND parent_name <> ''")
    span, spans = _spans(nodes)
    links = _latest(unnamed, nodes, False, span, spans).unionByName(_latest(named, nodes, True, span, spans))
    expected = process_basename(F.col("parent_name"), F.col("platform"))
    own = F.when(F.col("ppid").isNull(), F.col("key"))
    phantom_key = F.concat_ws("|", "host", F.lit("phantom"), F.coalesce(F.col("ppid").cast("string"), F.lit("None")), expected, F.coalesce(own, F.lit("")))
    orphan = F.col("found").isNull() & (F.col("ppid").isNotNull() | (F.col("parent_name") != ""))
    placed = nodes.join(links.select("key", F.col("parent_key").alias("found")), "key", "left").withColumn("orphan", F.coalesce(orphan, F.lit(False)))
    return placed.withColumn("parent_key", F.when(F.col("orphan"), phantom_key).otherwise(F.col("found"))).withColumn("is_phantom", F.lit(False))


def _phantoms(orphans: DataFrame) -> DataFrame:
    """The declared parents of ``orphans``, each with the number of its children."""
    order = F.struct("ts", F.coalesce("pid", F.lit(-1)), "event_id")
    name = F.when(F.col("parent_name") != "", F.col("parent_name")).otherwise(F.concat(F.lit("pid-"), F.col("ppid").cast("string")))
    return orphans.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("children"), F.first("host").alias("host"), F.first("ppid").alias("pid"), F.min_by(name, order).alias("process_name"), F.min_by("platform", order).alias("platform"))


def phantoms(events: DataFrame) -> DataFrame:
    """(key, children, process_name) of the parents that were never seen, from the orphans alone."""
    return _phantoms(_placed(events).where("orphan")).select("key", "children", "process_name")


def build(events: DataFrame, dense_keys: bool = False) -> DataFrame:
    """All nodes with their parents: one per event, and the phantom parents, written to the shared folder.

    Node keys are host|pid|event_id.  ``dense_keys`` numbers the events of a host instead, which
    sorts each host in one task.
    """
    # written once, for those who read them and for the phantoms: the lookup is not made again for each
    real = materialize(_placed(events, dense_keys).select(*NODE, "ppid", "parent_name", "orphan"), "nodes")
    unseen = _phantoms(real.where("orphan")).select(
        "host", "key", F.lit(None).cast("long").alias("event_id"), "pid", "process_name", process_basename(F.col("process_name"), F.col("platform")).alias("name_norm"), "platform",
        F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("command_line"), F.lit("").alias("user"), F.lit(True).alias("is_phantom"), F.lit(None).cast("string").alias("parent_key"),
    )
    return real.select(*NODE).unionByName(materialize(unseen.select(*NODE), "phantoms"))


def ancestors(nodes: DataFrame, of: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, anc, depth): every node above each node of ``of`` (a column key; all nodes, if not given), each once, at its
    least depth of 1 to ``max_depth``.  A column ``steps`` of ``nodes`` tells how far up a parent is (1 without it)."""
    steps = F.col("steps") if "steps" in nodes.columns else F.lit(1)
    jump = nodes.where("parent_key IS NOT NULL").select("key", F.col("parent_key").alias("up"), steps.alias("w"))
    found = (nodes if of is None else of).select("key", F.col("key").alias("anc"), F.lit(0).alias("depth"))
    step = 1
    while True:
        both = F.array_compact(F.array(F.struct("anc", "depth"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("anc"), (F.col("depth") + F.col("w")).alias("depth")))))
        found = found.join(jump.select(F.col("key").alias("anc"), "up", "w"), "anc", "left").select("key", F.inline(both))
        if 2 * step > max_depth:
            break
        jump = materialize(jump.join(jump.select(F.col("key").alias("up"), F.col("up").alias("top"), F.col("w").alias("w2")), "up").select("key", F.col("top").alias("up"), (F.col("w") + F.col("w2")).alias("w")), "jump")
        if not jump.head(1):  # no node has so many above it
            break
        step *= 2
    # nodes of one time may form a circle: then an ancestor is met again, and a node is no ancestor of itself
    return found.where((F.col("depth") > 0) & (F.col("depth") <= max_depth) & (F.col("anc") != F.col("key"))).groupBy("key", "anc").agg(F.min("depth").alias("depth"))


def nearest(nodes: DataFrame, marked: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, up, depth): the closest node above each node that is among ``marked`` (a column key).

    Pointers double until they meet a marked node and then stand still; nodes without one above fall out, so a
    round handles only what is still open, and the rounds end as soon as nothing is.
    """
    hit = marked.select(F.col("key").alias("up"), F.lit(True).alias("hit")).distinct()
    first = nodes.where("parent_key IS NOT NULL").select("key", F.col("parent_key").alias("up"), F.lit(1).alias("depth"))
    jump = materialize(first.join(hit, "up", "left").select("key", "up", "depth", F.col("hit").isNotNull().alias("done")), "nearest")
    step = 1
    while step < max_depth and jump.where("NOT done").head(1):
        onward = jump.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        moved = jump.where("NOT done").join(onward, "up").select("key", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("done2").alias("done"))
        jump = materialize(jump.where("done").unionByName(moved), "nearest")
        step *= 2
    return jump.where(F.col("done") & (F.col("depth") <= max_depth)).select("key", "up", "depth")


def marked_ancestors(nodes: DataFrame, marked: DataFrame, of: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, anc, depth): the nodes of ``marked`` above each node of ``of`` (all nodes, if not given).

    The forest shrinks to its marked nodes: each node points to the nearest one, and only among these are ancestors spelled out.  So
    rows are made for pairs of the result and not for all that lies between.
    """
    near = nearest(nodes, marked, max_depth)
    shrunk = near.join(marked.select("key").distinct(), "key", "left_semi").select("key", F.col("up").alias("parent_key"), F.col("depth").alias("steps"))
    above = ancestors(shrunk, max_depth=max_depth)
    base = near if of is None else near.join(of.select("key").distinct(), "key", "left_semi")
    far = base.join(above.select(F.col("key").alias("up"), "anc", F.col("depth").alias("d2")), "up").select("key", "anc", (F.col("depth") + F.col("d2")).alias("depth"))
    found = base.select("key", F.col("up").alias("anc"), "depth").unionByName(far)
    return found.where((F.col("depth") <= max_depth) & (F.col("anc") != F.col("key"))).groupBy("key", "anc").agg(F.min("depth").alias("depth"))


def all_descendants(nodes: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(anc, key, depth): the closure below the nodes of ``starts`` (a column key)."""
    return marked_ancestors(nodes, starts, max_depth=max_depth).select("anc", "key", "depth")
