"""Deduplication of an alert stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.episodes import EPISODE, Episode, Fold, with_times

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "fingerprint string, episode long, occurrence_count long, first_seen long, last_seen long, score int, first_event_id long, last_event_id long, state string, is_new boolean, changed boolean"
#: The fingerprints of a page, column by column; of each so many episodes are open, which follow in the same order.
_PAGE = """fingerprint array<string>, hash array<long>, number array<long>, open array<int>,
  episode array<long>, occurrence_count array<long>, first_seen array<long>, last_seen array<long>, score array<int>, first_event_id array<long>, last_event_id array<long>"""
#: Fingerprints to a page of state, on average at most.
PAGE = 64
#: Rows to a table that is put out.
ROWS = 10_000


class EpisodeState(StatefulProcessor):
    """Of a group of fingerprints: their open episodes and the highest number given to each.

    A call to the state, a table and a timer for each fingerprint cost far more than its fold, so a key is a group of fingerprints and its state lies in
    pages by their hashes.  A batch reads and writes the pages that it touches, one at a time; pages are split when a group has grown beyond ``PAGE``
    fingerprints to each, so both many and few alerts to a batch cost in proportion to the alerts.

    An episode leaves the state by a timer once the watermark is a window past its last alert, rounded up to whole windows: no alert that
    may still come can join it.  Its number stays, so numbers are never given twice.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", _PAGE)
        self.size = handle.getValueState("size", "bits int, fingerprints long")
        self.cleared: set = set()

    def _read(self, page: int) -> dict[str, tuple[int, int, list[Episode]]]:
        """Hash, highest number and open episodes by fingerprint."""
        v = self.pages.getValue((page,))
        if v is None:
            return {}
        stored = (Episode(*x, "new", False, False) for x in zip(*v[4:], strict=True))
        return {f: (h, n, list(islice(stored, k))) for f, h, n, k in zip(*v[:4], strict=True)}

    def _write(self, page: int, entries: dict[str, tuple[int, int, list[Episode]]]) -> None:
        stored = [e for _, _, found in entries.values() for e in found]
        columns = [[h for h, _, _ in entries.values()], [n for _, n, _ in entries.values()], [len(found) for _, _, found in entries.values()]]
        self.pages.updateValue((page,), (list(entries), *columns, *[[getattr(e, c) for e in stored] for c in EPISODE[:7]]))

    def _sized(self) -> tuple[int, int]:
        return self.size.get() or (0, 0)

    def _split(self, bits: int, fingerprints: int) -> int:
        """So many bits of the hash that pages hold ``PAGE`` fingerprints; a page deals its own to those that it is split into."""
        more = bits
        while fingerprints > PAGE << more:
            more += 1
        for page in range(1 << bits) if more > bits else ():
            parts: dict[int, dict] = {}
            for f, entry in self._read(page).items():
                parts.setdefault(entry[0] & ((1 << more) - 1), {})[f] = entry
            if parts and page not in parts:
                self.pages.removeKey((page,))
            for part, entries in parts.items():
                self._write(part, entries)
        return more

    def _by_page(self, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, dict[str, tuple[int, int, list[Episode]]]]]:
        """The rows of each page, in their order, with its entries, which are kept as the caller leaves them."""
        bits, known = self._sized()
        bits = self._split(bits, known + rows["fingerprint"].nunique(dropna=False))
        for page, part in rows.groupby(rows["hash"] & ((1 << bits) - 1)):
            entries = self._read(int(page))
            before = len(entries)
            yield part, entries
            known += len(entries) - before
            self._write(int(page), entries)
        self.size.update((bits, known))

    def _expiry(self, e: Episode) -> int:
        """In milliseconds, at a whole window: a group is looked through once for all episodes of a window."""
        begun = -(-(e.last_seen + 1) // self.window)
        return (begun + 1) * self.window // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        due, out = set(), []
        for part, entries in self._by_page(arrived):
            folds, touched = {}, {}
            for f, h, us, score, event_id in zip(*[part[c].tolist() for c in ("fingerprint", "hash", "us", "score", "event_id")], strict=True):
                if f not in folds:
                    _, number, stored = entries.get(f, (h, 0, []))
                    folds[f] = h, Fold(self.window, stored, number)
                e = folds[f][1].add(us, score, event_id)
                touched[f, e.episode] = e
            entries.update({f: (h, fold.number, fold.episodes()) for f, (h, fold) in folds.items()})
            due |= {self._expiry(e) for e in touched.values()}
            out += [(f, *[getattr(e, c) for c in EPISODE]) for (f, _), e in touched.items()]
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["fingerprint", *EPISODE])
                out = []
        for at in due:
            self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", *EPISODE])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        """Stored episodes: open ones take alerts, closed ones only count for the numbers."""
        due = set()
        for part, entries in self._by_page(initialState):
            for r in part.itertuples(index=False):
                h, number, stored = entries.get(r.fingerprint, (int(r.hash), 0, []))
                if r.open:
                    e = Episode(*[int(getattr(r, c)) for c in EPISODE[:7]])
                    stored.append(e)
                    due.add(self._expiry(e))
                entries[r.fingerprint] = h, max(number, int(r.episode)), stored
        for at in due:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key not in self.cleared:  # once for all timers of a group that a batch sets off
            self.cleared.add(key)
            now = timerValues.getCurrentWatermarkInMs() * 1000
            for page in range(1 << self._sized()[0]):
                entries = self._read(page)
                kept = {f: (h, n, [e for e in stored if e.last_seen + self.window >= now]) for f, (h, n, stored) in entries.items()}
                if kept != entries:
                    self._write(page, kept)
        return iter([])

    def close(self) -> None:
        pass


def _hashes(groups: int) -> list[Column]:
    """The group of a fingerprint and other bits of its hash, for the pages in the group."""
    h = F.xxhash64("fingerprint")
    return [F.pmod(h, F.lit(groups)).cast("int").alias("group"), F.shiftright(h, 20).alias("hash")]


def dedup_stream(alerts: DataFrame, hours: int = 24, delay: str = "24 hours", stored: DataFrame | None = None, arrival: str = "event_id", groups: int = 1024) -> DataFrame:
    """Episodes of a stream of alerts (with fingerprints), in update mode: a row for each episode that a micro-batch begins or extends, as it is after the batch.

    Alerts count in the order of batches and, within one, of ``arrival``; the result is that of ``episodes.fold_arrivals`` over the same
    order, for alerts no later than ``delay`` behind the newest.  ``stored`` has the episodes to go on from.  The session's
    state store has to be RocksDB, which this sets.  State is kept by ``groups`` of fingerprints; a checkpoint goes on with the number it began with.
    """
    from ..operators.episodes import OPEN_STATES

    spark: SparkSession = alerts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = alerts.withWatermark("ts", delay).select(*_hashes(groups), "fingerprint", "ts", F.col(arrival).cast("long").alias("at"), F.unix_micros("ts").alias("us"), F.col("score").cast("int").alias("score"), F.col("event_id").cast("long").alias("event_id"))
    first = None
    if stored is not None:
        times = {c: F.unix_micros(c) for c in ("first_seen", "last_seen")}
        first = stored.withColumns(times).select(*_hashes(groups), "fingerprint", *EPISODE[:7], F.col("state").isin(*OPEN_STATES).alias("open")).groupBy("group")
    folded = rows.groupBy("group").transformWithStateInPandas(EpisodeState(hours * 3_600_000_000), _OUT, "Update", "EventTime", initialState=first)
    return with_times(folded)
