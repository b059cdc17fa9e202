"""Correlation: multi-stage behaviour chains along process lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.fingerprint import incident_fingerprint
from ..plans.compile import stage_predicate
from ..rules.model import Chain
from ..storage import materialize
from .lineage import ancestors

def _order() -> Column:
    """Sort key of a node: phantoms first, then time, pid and key."""
    return F.struct((~F.col("is_phantom")).alias("a"), F.coalesce("ts", F.timestamp_seconds(F.lit(0))).alias("b"), F.coalesce("pid", F.lit(-1)).alias("c"), F.col("key").alias("d"))


def _hits(nodes: DataFrame, chains: list[Chain], number: int, anchors: bool) -> DataFrame:
    """``nodes`` once per chain whose stage ``number`` fits (column ``chain``, the chain's place in the list)."""
    tests = []
    for k, c in enumerate(chains):
        if len(c.stages) > number:
            fits = stage_predicate(c.stages[number], c.platform)
            tests.append(F.when(fits & (F.col("platform") == c.platform) if anchors else fits, F.lit(k)))
    name = F.lit(None).cast("string")
    for k, c in enumerate(chains):
        if len(c.stages) > number:
            name = F.when(F.col("chain") == k, F.lit(c.stages[number].name)).otherwise(name)
    found = nodes.select("*", F.array(*tests).alias("_h"))
    return found.select("*", F.explode_outer("_h").alias("chain")).where("chain IS NOT NULL").drop("_h").withColumn("stage", name)


def _entry() -> Column:
    return F.struct("stage", F.col("key").alias("node_key"), F.col("is_phantom").alias("phantom"), "process_name", "pid", F.col("ts").alias("timestamp"), "event_id")


def match_chains(nodes: DataFrame, chains: list[Chain]) -> DataFrame:
    """The first path of each anchor that completes a chain; all chains advance together.

    Depth-first search in sorted order finds the lexicographically smallest valid path.  Stage by
    stage it is enough to keep, per anchor, last node and first time, the smallest path so far: what
    may follow depends on nothing else.
    """
    window = F.lit(0).cast("long")
    for k, c in enumerate(chains):
        window = F.when(F.col("chain") == k, F.lit(c.window_seconds * 1_000_000)).otherwise(window)
    first = _hits(nodes, chains, 0, anchors=True)
    paths = first.select("chain", "host", F.col("key").alias("anchor"), "key", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), (~F.col("is_phantom")).alias("concrete"), F.array(_order()).alias("order"), F.array(_entry()).alias("stages"))
    paths, complete = materialize(paths, "paths"), []
    last = max(len(c.stages) for c in chains)
    later = {number: _hits(nodes, chains, number, anchors=False).select("chain", F.col("key").alias("to"), "parent_key", "ts", _order().alias("o"), _entry().alias("e"), "is_phantom") for number in range(1, last)}
    # from the hits up to the paths, once for all stages: a hit has few ancestors, a path's node any number of descendants
    above = None
    for number, found in later.items():
        below = [k for k, c in enumerate(chains) if len(c.stages) > number and c.stages[number].relation == "descendant"]
        if below:
            hits = found.where(F.col("chain").isin(*below)).select(F.col("to").alias("key"))
            above = hits if above is None else above.unionByName(hits)
    if above is not None:
        above = materialize(ancestors(nodes, above.distinct()).select(F.col("key").alias("to"), F.col("anc").alias("key")), "above")
    for number, found in later.items():
        below = [k for k, c in enumerate(chains) if len(c.stages) > number and c.stages[number].relation == "descendant"]
        direct = [k for k, c in enumerate(chains) if len(c.stages) > number and c.stages[number].relation == "child"]
        steps = []
        if below:
            hits = found.where(F.col("chain").isin(*below))
            steps.append(hits.drop("parent_key").join(above, "to").join(paths.where(F.col("chain").isin(*below)), ["chain", "key"]))
        if direct:
            steps.append(paths.where(F.col("chain").isin(*direct)).join(found.withColumnRenamed("parent_key", "key"), ["chain", "key"]))
        step = steps[0].unionByName(steps[1]) if len(steps) > 1 else steps[0]
        in_order = F.col("ts").isNull() | F.col("last_ts").isNull() | (F.col("ts") >= F.col("last_ts"))
        in_window = F.col("ts").isNull() | F.col("first_ts").isNull() | (F.unix_micros("ts") - F.unix_micros("first_ts") <= window)
        step = step.where(in_order & in_window).select(
            "chain", "host", "anchor", F.col("to").alias("key"), F.coalesce("first_ts", "ts").alias("first_ts"), F.coalesce("ts", "last_ts").alias("last_ts"), (F.col("concrete") & ~F.col("is_phantom")).alias("concrete"),
            F.concat("order", F.array("o")).alias("order"), F.concat("stages", F.array("e")).alias("stages"),
        )
        best = F.min(F.struct("order", "host", "last_ts", "concrete", "stages")).alias("best")
        paths = materialize(step.groupBy("chain", "anchor", "key", "first_ts").agg(best).select("chain", "anchor", "key", "first_ts", "best.*"), "paths")
        ended = [k for k, c in enumerate(chains) if len(c.stages) == number + 1]
        if ended:
            complete.append(paths.where(F.col("chain").isin(*ended)))
            paths = paths.where(~F.col("chain").isin(*ended))
    found = complete[0]
    for c in complete[1:]:
        found = found.unionByName(c)
    done = F.min(F.struct("order", "host", "first_ts", "last_ts", "concrete", "stages")).alias("best")
    return found.groupBy("chain", "anchor").agg(done).select("chain", "anchor", "best.host", F.col("best.first_ts").alias("first_timestamp"), F.col("best.last_ts").alias("last_timestamp"), "best.concrete", "best.stages")


def incidents(nodes: DataFrame, chains: list[Chain]) -> DataFrame:
    """Scored incidents of all chains over the nodes of ``lineage.build``."""
    if not chains:
        raise ValueError("no chains are given")
    found = match_chains(nodes, chains)
    rows = [(k, c.id, c.name, c.severity, c.platform, list(c.mitre_attack), c.description, list(c.response), c.window_seconds, len(c.stages)) for k, c in enumerate(chains)]
    table = nodes.sparkSession.createDataFrame(rows, "chain int, chain_id string, chain_name string, severity string, platform string, mitre_attack array<string>, description string, response array<string>, window_seconds int, n_stages int")
    found = found.join(F.broadcast(table), "chain")  # as many rows as chains
    extra = F.greatest(F.lit(0), F.col("n_stages") - 2) * S.CHAIN_STAGE
    conf = F.least(F.lit(100), F.lit(S.CHAIN_BASE) + extra + F.when(F.col("concrete"), S.CHAIN_CONCRETE).otherwise(0)).cast("int")
    points = S.score(S.severity_subscore(F.col("severity")), conf)
    return found.select(
        "chain_id", "chain_name", "severity", "platform", "host", "mitre_attack", "description", "response", "window_seconds", "first_timestamp", "last_timestamp", "stages",
        conf.alias("confidence"), points.alias("score"), S.risk_band(points).alias("risk_band"), incident_fingerprint(F.col("chain_id"), F.col("platform"), F.col("host"), F.col("stages")).alias("fingerprint"),
    )


def in_report_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("first_timestamp").asc_nulls_first(), "chain_id", "host", F.col("stages")[0]["node_key"])
