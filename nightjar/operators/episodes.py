"""Deduplication of alerts into episodes, suppression, lifecycle, and the stored tables."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fingerprint import alert_fingerprints
from ..schema import EVENT_COLUMNS

STATES = ("new", "acknowledged", "investigating", "resolved", "false_positive")
OPEN_STATES = STATES[:3]
SUPPRESSION = T.StructType(
    [T.StructField("suppression_id", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("scope_value", T.StringType()),
     T.StructField("author", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("starts_at", T.TimestampType()), T.StructField("expires_at", T.TimestampType()), T.StructField("active", T.BooleanType())]
)
AUDIT = "alert_id string, action string, previous_state string, new_state string, author string, reason string, at timestamp"


def with_fingerprints(alerts: DataFrame, unicode_form: bool = True) -> DataFrame:
    return alerts.select("*", *[c.alias(n) for n, c in alert_fingerprints(unicode_form).items()])


def _active(suppressions: DataFrame, now: Column) -> DataFrame:
    return suppressions.where(F.col("active") & (F.col("starts_at") <= now) & (F.col("expires_at") > now))


def suppress(alerts: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """``alerts`` (with fingerprints) plus ``suppressed``: a global rule for the activity or a host rule for the alert is active.

    Two equi-joins on distinct keys instead of one join with OR.
    """
    live = _active(suppressions, now)
    everywhere = live.where("scope = 'global'").select(F.col("fingerprint").alias("activity_fingerprint"), F.lit(True).alias("_g")).distinct()
    on_host = live.where("scope = 'host'").select("fingerprint", F.col("scope_value").alias("fp_host"), F.lit(True).alias("_h")).distinct()
    joined = alerts.join(everywhere, "activity_fingerprint", "left").join(on_host, ["fingerprint", "fp_host"], "left")
    return joined.withColumn("suppressed", F.coalesce("_g", F.lit(False)) | F.coalesce("_h", F.lit(False))).drop("_g", "_h")


#: What an episode keeps of its first alert.
_FIRST = ("rule_id", "rule_name", "severity", "platform", "process_name", "command_line", "user", "parent_process_name", "mitre_attack", "fp_host", "activity_fingerprint", "risk_band")


def episodes(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """Episodes of alerts in time order: a gap of more than ``hours`` after the last alert of a fingerprint starts a new one.

    The result does not depend on the order of arrival.  Alerts of a fingerprint in one span of ``hours`` belong together
    whatever lies between them, so every span is summed up on the map side first; the window that joins spans across
    their borders has a row for each span, however many alerts a fingerprint has.
    """
    width, arrival = hours * 3_600_000_000, F.struct("ts", "event_id")
    event = F.struct(*[F.col(c) for c in EVENT_COLUMNS])
    first = F.struct(*_FIRST, event.alias("event"))
    spans = alerts.groupBy("fingerprint", F.floor(F.unix_micros("ts") / width).alias("_span")).agg(
        F.min(arrival).alias("_a"), F.max(arrival).alias("_z"), F.min_by(first, arrival).alias("_first"), F.max_by(event, arrival).alias("_last"),
        F.count(F.lit(1)).alias("_n"), F.max("score").alias("_score"),
    )
    order = Window.partitionBy("fingerprint").orderBy("_a")
    gap = F.unix_micros("_a.ts") - F.unix_micros(F.lag("_z.ts").over(order)) > width
    numbered = spans.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("fingerprint", "episode").agg(
        F.min_by("_first", "_a").alias("_first"), F.sum("_n").alias("occurrence_count"), F.min("_a.ts").alias("first_seen"), F.max("_z.ts").alias("last_seen"), F.max("_score").alias("score"), F.max_by("_last", "_z").alias("last_event_data"),
    )
    return joined.select(
        "fingerprint", "episode", *[F.col(f"_first.{c}").alias(c) for c in _FIRST], "occurrence_count", "first_seen", "last_seen", "score", F.col("_first.event").alias("event_data"), "last_event_data", F.lit("new").alias("state"),
    )


@dataclass
class Episode:
    """An episode while it is folded; times in microseconds."""

    episode: int
    occurrence_count: int
    first_seen: int
    last_seen: int
    score: int
    first_event_id: int
    last_event_id: int
    state: str = "new"
    is_new: bool = True
    changed: bool = True


class Fold:
    """The episodes of one fingerprint while alerts arrive in any order of time.

    An alert joins, of the open episodes within ``window`` of it, the one that was seen last.  Episodes lie sorted by that time, so the search
    ends at the first that fits or is too old.
    """

    def __init__(self, window: int, stored: Iterable[Episode] = (), number: int = 0) -> None:
        self.window, self.closed, self.order = window, [], []
        self.number = number
        for e in stored:
            self.number = max(self.number, e.episode)
            if e.state in OPEN_STATES:
                self.order.append((e.last_seen, -e.episode, e))
            else:
                self.closed.append(e)
        self.order.sort(key=lambda x: x[:2])

    def add(self, at: int, score: int, event_id: int) -> Episode:
        e, k = None, len(self.order) - 1
        while k >= 0 and e is None and self.order[k][0] >= at - self.window:
            if self.order[k][2].first_seen <= at + self.window:
                e = self.order.pop(k)[2]
            k -= 1
        if e is None:
            self.number += 1
            e = Episode(self.number, 1, at, at, score, event_id, event_id)
        else:
            e.occurrence_count, e.score, e.last_event_id, e.changed = e.occurrence_count + 1, max(e.score, score), event_id, True
            e.first_seen, e.last_seen = min(e.first_seen, at), max(e.last_seen, at)
        insort(self.order, (e.last_seen, -e.episode, e), key=lambda x: x[:2])
        return e

    def episodes(self) -> list[Episode]:
        return self.closed + [x[2] for x in self.order]


_FOLD = "fingerprint string, episode long, occurrence_count long, first_seen long, last_seen long, score int, first_event_id long, last_event_id long, state string, is_new boolean, changed boolean"
EPISODE = [f.name for f in fields(Episode)]


def _fold(window: int):
    """Fold a stream sorted by fingerprint: stored episodes first, then alerts in arrival order."""
    def rows(key: str, fold: Fold) -> list[tuple]:
        return [(key, *[getattr(e, c) for c in EPISODE]) for e in fold.episodes()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stored, fold = None, [], None
        for pdf in batches:
            done: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if r.fingerprint != key:
                    if key is not None:
                        done += rows(key, fold or Fold(window, stored))
                    key, stored, fold = r.fingerprint, [], None
                if r.stored:
                    stored.append(Episode(r.episode, r.occurrence_count, r.first_seen, r.last_seen, r.score, r.first_event_id, r.last_event_id, r.state, False, False))
                    continue
                fold = fold or Fold(window, stored)
                fold.add(r.first_seen, r.score, r.first_event_id)
            if done:
                yield pd.DataFrame(done, columns=["fingerprint", *EPISODE])
        if key is not None:
            yield pd.DataFrame(rows(key, fold or Fold(window, stored)), columns=["fingerprint", *EPISODE])

    return run


def with_times(folded: DataFrame) -> DataFrame:
    return folded.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def fold_arrivals(alerts: DataFrame, stored: DataFrame | None = None, hours: int = 24, arrival: str = "event_id") -> DataFrame:
    """Episodes by order of arrival: each alert joins the open episode of its fingerprint with the newest last_seen within the window.

    Rows reach the fold sorted by fingerprint and arrival, so a task holds the episodes of one fingerprint only.  ``changed`` tells which are
    new or have grown.
    """
    us = F.unix_micros("ts")
    new = alerts.select("fingerprint", F.lit(False).alias("stored"), F.col(arrival).cast("long").alias("at"), F.lit(0).cast("long").alias("episode"), F.lit(1).cast("long").alias("occurrence_count"),
                        us.alias("first_seen"), us.alias("last_seen"), F.col("score").cast("int").alias("score"), F.col("event_id").alias("first_event_id"), F.col("event_id").alias("last_event_id"), F.lit("new").alias("state"))
    if stored is not None:
        old = stored.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})
        new = new.unionByName(old.select("fingerprint", F.lit(True).alias("stored"), F.col("episode").alias("at"), "episode", "occurrence_count", "first_seen", "last_seen", "score", "first_event_id", "last_event_id", "state"))
    ordered = new.repartition("fingerprint").sortWithinPartitions("fingerprint", F.col("stored").desc(), "at", "first_event_id")
    return with_times(ordered.mapInPandas(_fold(hours * 3_600_000_000), _FOLD))


def __getattr__(name: str):
    """``Store`` is imported when it is asked for: its changes use the functions above."""
    if name == "Store":
        from .store import Store

        return Store
    raise AttributeError(name)
