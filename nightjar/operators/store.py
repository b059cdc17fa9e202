"""Stored tables: layers of Parquet files under one commit log.

A change writes its rows as new layers (folders that nothing else names), then publishes one manifest that lists the
layers of every table.  Publishing is a compare-and-set on the number of the version it was made from: who comes
second makes the change again on top of the other's.  So a change of several tables, with the id of the
stream's batch in it, is there whole or not at all, two writers lose nothing, and a reader keeps the version
that it began with.  Layers that no version names any more go with ``vacuum``, never before.

Keyed tables are cut into BUCKETS by a hash of a column, and a layer holds only new and changed rows: of rows with one
key the newest layer's counts.  Looking keys up reads only the buckets that may hold them, and Parquet's Bloom
filters on the key skip row groups of those.  Beyond LAYERS layers a table is written anew as one.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT_COLUMNS
from ..storage import materialize
from . import episodes as E

BUCKETS, LAYERS, ATTEMPTS = 32, 16, 20
#: Keys of a lookup that are handed to the scan as literals, at most.
KEYS = 200
DETAILS = ("rule_id", "rule_name", "severity", "platform", "process_name", "command_line", "user", "parent_process_name", "mitre_attack", "description", "risk_band")
_LOCAL = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has published a version meanwhile."""


@dataclass
class Layer:
    path: str
    schema: str
    replaces: bool = False
    buckets: list[int] = field(default_factory=list)


@dataclass
class Table:
    key: str | None = None
    by: str | None = None  # what the buckets are made of
    layers: list[Layer] = field(default_factory=list)


@dataclass
class Version:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)  # newest batch of each stream

    def text(self) -> str:
        return json.dumps(self, default=lambda x: x.__dict__)

    @classmethod
    def parse(cls, text: str) -> Version:
        d = json.loads(text)
        tables = {n: Table(t["key"], t["by"], [Layer(**x) for x in t["layers"]]) for n, t in d["tables"].items()}
        return cls(d["number"], tables, d["batches"])


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class Transaction:
    """A change on top of one version.  Nothing is visible before it is published."""

    def __init__(self, store: Store, base: Version) -> None:
        self.store, self.base, self.new, self.made = store, base, Version.parse(base.text()), []

    # ---- reading the version

    def read(self, table: str, buckets: list[int] | None = None, only: Column | None = None) -> DataFrame | None:
        """The rows of a table (of some buckets, and of those the ones for which ``only`` holds); None if it was never written.  ``only`` may
        depend on key and bucket column alone."""
        t = self.base.tables.get(table)
        if t is None or not t.layers:
            return None
        parts, newest = [], None
        for k, layer in enumerate(t.layers):
            df = self.store.layer(layer, buckets)
            parts.append((df if only is None else df.where(only)).withColumn("_layer", F.lit(k)))
            if layer.replaces:
                own = parts[-1].select(t.key, F.col("_layer").alias("_newest"))
                newest = own if newest is None else newest.unionAll(own)
        rows = parts[0]
        for df in parts[1:]:
            rows = rows.unionByName(df, allowMissingColumns=True)
        if newest is not None:
            newest = newest.groupBy(t.key).agg(F.max("_newest").alias("_newest"))
            rows = rows.join(newest, t.key, "left").where("_newest IS NULL OR _layer >= _newest").drop("_newest")
        return rows.drop("_layer", "_bucket")

    def matching(self, table: str, keys: DataFrame, by: str) -> DataFrame | None:
        """The stored rows whose column ``by`` (what the buckets are made of) is among ``keys`` (that column, distinct)."""
        t = self.base.tables.get(table)
        if t is None or not t.layers:
            return None
        buckets = sorted(r[0] for r in keys.select(bucket_of(by)).distinct().collect())  # BUCKETS at most
        few = [r[0] for r in keys.select(by).limit(KEYS + 1).collect()]
        only = None
        if len(few) <= KEYS:
            only = F.lit(False)
            for at in range(0, len(few), 10):  # so many values are looked up in a Bloom filter
                only = only | F.col(by).isin(*few[at : at + 10])
        rows = self.read(table, buckets, only)
        return rows.join(keys.select(by), by, "left_semi")

    # ---- changing it

    def _add(self, table: str, df: DataFrame, key: str | None, by: str | None, replaces: bool) -> None:
        t = self.new.tables.setdefault(table, Table(key, by or key))
        if (t.key, t.by) != (key, by or key):
            raise ValueError(f"table {table!r} is keyed by {t.key!r}")
        layer = self.store.write_layer(table, df, t, replaces)
        self.made.append(layer)
        t.layers.append(layer)

    def append(self, table: str, df: DataFrame) -> None:
        self._add(table, df, None, None, False)

    def add(self, table: str, df: DataFrame, key: str, by: str | None = None) -> None:
        """Rows with keys that the table lacks."""
        self._add(table, df, key, by, False)

    def upsert(self, table: str, df: DataFrame, key: str, by: str | None = None) -> None:
        """Rows that take the place of those with their keys."""
        self._add(table, df, key, by, True)

    def replace_all(self, table: str, df: DataFrame) -> None:
        """One layer with these rows instead of all that there are."""
        t = self.new.tables[table]
        layer = self.store.write_layer(table, df, t, False)
        self.made.append(layer)
        t.layers = [layer]

    def insert_absent(self, table: str, df: DataFrame, key: str) -> DataFrame:
        """Add the rows of ``df`` whose key is new (one row per key); returns all its keys with is_duplicate."""
        one = materialize(df.dropDuplicates([key]), "one-per-key")
        known = self.matching(table, one.select(key), key)
        if known is None:
            self.add(table, one, key)
            return one.select(key, F.lit(False).alias("is_duplicate"))
        result = materialize(one.select(key).join(known.select(key, F.lit(True).alias("is_duplicate")).distinct(), key, "left").select(key, F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate")), "duplicates")
        self.add(table, one.join(result.where("NOT is_duplicate").select(key), key, "left_semi"), key)
        return result

    def save_episodes(self, table: str, alerts: DataFrame, hours: int = 24, now: Column | None = None) -> dict[str, int]:
        """Fold alerts (with fingerprints, and read once: hand in a written table) into the stored episodes.

        Only episodes of the alerts' fingerprints are read, and only new and changed ones are written.  Returns the
        numbers of new, duplicate and suppressed alerts.
        """
        suppressions = self.read("suppressions")
        if suppressions is not None:
            alerts = materialize(E.suppress(alerts, suppressions, F.current_timestamp() if now is None else now), "alerts")
        else:
            alerts = alerts.withColumn("suppressed", F.lit(False))
        kept = alerts.where(~F.col("suppressed"))
        old = self.matching(table, kept.select("fingerprint").distinct(), "fingerprint")
        if old is not None:
            old = materialize(old, "stored")
        folded = materialize(E.fold_arrivals(kept, old, hours).where("changed"), "episodes")
        event = F.to_json(F.struct(*[c for c in EVENT_COLUMNS if c in alerts.columns]))
        seen = kept.select("event_id", "fingerprint", "activity_fingerprint", "fp_host", *[c for c in DETAILS if c in alerts.columns], event.alias("event")).dropDuplicates(["event_id", "fingerprint"])
        first = seen.withColumnsRenamed({"event_id": "first_event_id", "event": "event_data"})
        if old is not None:
            first = old.select([c for c in first.columns]).unionByName(first).dropDuplicates(["first_event_id", "fingerprint"])
        last = seen.select("fingerprint", F.col("event_id").alias("last_event_id"), F.col("event").alias("last_event_data"))
        rows = folded.join(first, ["first_event_id", "fingerprint"], "left").join(last, ["last_event_id", "fingerprint"], "left")
        rows = rows.withColumn("alert_id", F.concat_ws("-", "fingerprint", "episode")).withColumn("ts", F.col("last_seen")).drop("changed")
        self.upsert(table, rows, "alert_id", "fingerprint")
        n = {r["suppressed"]: r["count"] for r in alerts.groupBy("suppressed").count().collect()}
        fresh = folded.where("is_new").count()
        return {"new": fresh, "duplicate": n.get(False, 0) - fresh, "suppressed": n.get(True, 0)}

    def set_state(self, table: str, alert_id: str, state: str, author: str, reason: str = "", now: Column | None = None) -> bool:
        """Change an alert's state (any to any) and add one audit row; False if there is no such alert."""
        if state not in E.STATES:
            raise ValueError(f"unknown state {state!r}; one of {', '.join(E.STATES)}")
        key = self.store.spark.createDataFrame([(alert_id.rpartition("-")[0],)], "fingerprint string")
        old = self.matching(table, key, "fingerprint")
        found = old.where(F.col("alert_id") == alert_id) if old is not None else None
        row = found.select("state").head(1) if found is not None else []
        if not row:
            return False
        self.upsert(table, found.withColumn("state", F.lit(state)), "alert_id", "fingerprint")
        entry = self.store.spark.createDataFrame([(alert_id, "state_change", row[0]["state"], state, author, reason, None)], E.AUDIT)
        self.append("audit", entry.withColumn("at", F.current_timestamp() if now is None else now))
        return True

    def add_suppression(self, fingerprint: str, scope: str, scope_value: str | None, author: str, reason: str, hours: int, now: Column | None = None) -> int:
        if scope not in ("global", "host"):
            raise ValueError("scope is global or host")
        if scope == "host" and not scope_value:
            raise ValueError("a host suppression names its host")
        if hours < 1:
            raise ValueError("a suppression lasts an hour at least")
        old = self.read("suppressions")
        n = 1 + (0 if old is None else old.agg(F.max("suppression_id")).first()[0] or 0)
        now = F.current_timestamp() if now is None else now
        row = self.store.spark.createDataFrame([(n, fingerprint, scope, scope_value, author, reason, None, None, True)], E.SUPPRESSION)
        self.append("suppressions", row.withColumn("starts_at", now).withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(hours))))
        return n

    def begins(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch is not in the version yet; if so, this change puts it there."""
        if batch <= self.base.batches.get(stream, -1):
            return False
        self.new.batches[stream] = batch
        return True


class Store:
    """Tables in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ---- versions

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.root}/_log/{number:020d}.json"))
        try:
            return Version.parse(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> Version:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else Version()

    def publish(self, version: Version) -> None:
        """Make ``version`` the one after its number; Conflict if there is one already."""
        version.number += 1
        draft, name = f"{self.root}/_log/.{uuid.uuid4().hex}", f"{self.root}/_log/{version.number:020d}.json"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(version.text().encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a hard link fails if the name is taken, on any POSIX file system
                with _LOCAL:
                    os.link(urlsplit(draft).path, urlsplit(name).path)
            else:
                jvm = self.spark._jvm
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
                options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
                context.rename(self._path(draft), self._path(name), options)
        except FileExistsError as e:
            raise Conflict(f"version {version.number} is there already") from e
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version.number} is there already") from e
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    def transact(self, change: Callable[[Transaction], object]) -> object:
        """Apply ``change`` to the newest version and publish it; again from the start if another writer was first."""
        for _ in range(ATTEMPTS):
            tx = Transaction(self, self.version())
            try:
                result = change(tx)
                if tx.new != tx.base:
                    self.publish(tx.new)
            except Conflict:
                for layer in tx.made:
                    self._fs.delete(self._path(layer.path), True)
                continue
            for table, t in tx.new.tables.items():
                if len(t.layers) > LAYERS:
                    self.compact(table)
            return result
        raise Conflict(f"gave up after {ATTEMPTS} attempts")

    def compact(self, table: str) -> None:
        """Write a table anew as one layer, unless another writer changes the store meanwhile."""
        tx = Transaction(self, self.version())
        tx.replace_all(table, tx.read(table))
        try:
            self.publish(tx.new)
        except Conflict:
            for layer in tx.made:
                self._fs.delete(self._path(layer.path), True)

    def vacuum(self, keep: int = 10) -> int:
        """Forget all but the newest ``keep`` versions and remove layers that none of these names; how many.  Only while nothing is written
        (a change under way has layers that no version names yet)."""
        numbers = self._numbers()
        alive = {layer.path for n in numbers[-keep:] for t in self._load(n).tables.values() for layer in t.layers}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{n:020d}.json"), False)
        gone, data = 0, self._path(f"{self.root}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for s in self._fs.listStatus(table.getPath()):
                if f"{self.root}/data/{table.getPath().getName()}/{s.getPath().getName()}" not in alive:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # ---- layers

    def write_layer(self, table: str, df: DataFrame, t: Table, replaces: bool) -> Layer:
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        layer = Layer(path, df.schema.json(), replaces)
        if t.key is None:
            df.write.parquet(path)
            return layer
        rows = df.withColumn("_bucket", bucket_of(t.by)).repartition("_bucket").sortWithinPartitions("_bucket", t.by)
        rows.write.partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{t.by}", "true").parquet(path)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        layer.buckets = sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))
        return layer

    def layer(self, layer: Layer, buckets: list[int] | None = None) -> DataFrame:
        """A layer's rows; of a keyed one only the folders of ``buckets`` are opened."""
        schema = T.StructType.fromJson(json.loads(layer.schema))
        chosen = layer.buckets if buckets is None else [b for b in layer.buckets if b in buckets]
        if buckets is not None and not chosen:
            return self.spark.createDataFrame([], schema)
        paths = [f"{layer.path}/_bucket={b}" for b in chosen] if buckets is not None else [layer.path]
        return self.spark.read.schema(schema).option("basePath", layer.path).parquet(*paths)

    # ---- single changes

    def read(self, table: str) -> DataFrame | None:
        return Transaction(self, self.version()).read(table)

    def append(self, table: str, df: DataFrame) -> None:
        self.transact(lambda tx: tx.append(table, df))

    def insert_absent(self, table: str, df: DataFrame, key: str) -> DataFrame:
        return self.transact(lambda tx: tx.insert_absent(table, df, key))

    def set_state(self, *args, **kw) -> bool:
        return self.transact(lambda tx: tx.set_state(*args, **kw))

    def add_suppression(self, *args, **kw) -> int:
        return self.transact(lambda tx: tx.add_suppression(*args, **kw))

    def save_episodes(self, table: str, alerts: DataFrame, hours: int = 24, now: Column | None = None) -> dict[str, int]:
        alerts = materialize(alerts, "alerts")
        return self.transact(lambda tx: tx.save_episodes(table, alerts, hours, now))

    def audit_trail(self, table: str = "alerts") -> DataFrame | None:
        """The state changes of stored alerts, each with the alert as it is now."""
        version = Transaction(self, self.version())
        alerts, audit = version.read(table), version.read("audit")
        return None if alerts is None or audit is None else audit.join(alerts, "alert_id")
