"""Streaming ingestion: the batch operators applied to micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import lineage
from ..operators.detect import detect
from ..operators.episodes import with_fingerprints
from ..operators.store import LAYERS, Store, Transaction
from ..rules.model import Chain, Rule
from ..schema import EVENT
from ..sources import auditd, endpoint_security, sysmon
from ..storage import materialize, new_folder
from .stateful import dedup_stream

BATCH = 500


def chunked(items: Iterable, size: int = BATCH) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    if size < 1:
        raise ValueError("a batch holds one item at least")
    it = iter(items)
    while part := list(islice(it, size)):
        yield part


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of events in a folder as a stream."""
    reader = spark.readStream.schema(EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def alert_sink(out: str, rules: list[Rule]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's alerts to its own folder: replaying a batch replaces it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        detect(batch, rules).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: list[Rule], files_per_batch: int | None = None) -> int:
    """Detect over all files present and stop; returns the number of batches of this run."""
    q = event_stream(spark, folder, files_per_batch).writeStream.foreachBatch(alert_sink(out, rules)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"]])


def fold_available(alerts: DataFrame, arrival: str, part: Column, parts: int, hours: int = 24, delay: str | None = None) -> DataFrame:
    """Replay alerts (with fingerprints) as a stream: the rows of ``part`` 0, 1, ... are its micro-batches, folded with keyed state.

    Each part is a run of its own that goes on from the checkpoint of the one before.  Without ``delay`` no alert is too late, whatever time
    lies between the first and the last.  Returns what each batch has put out, with its
    ``batch_id``.
    """
    spark, root = alerts.sparkSession, new_folder(alerts.sparkSession, "replay")
    rows = materialize(alerts.withColumn("_part", part), "alerts")
    schema = rows.drop("_part").schema
    if delay is None:
        span = rows.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s")).first()["s"]
        delay = f"{(span or 0) + 2} seconds"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    for k in range(parts):
        rows.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{root}/in")
        folded = dedup_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), hours, delay, arrival=arrival)
        folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(folded.schema.add("batch_id", "long")).parquet(f"{root}/out")


def correlate(tx: Transaction, events: DataFrame, chains: list[Chain], table: str = "recent", late: int = 3600) -> DataFrame:
    """Incidents of a batch's hosts over the batch and the recent events that the store keeps of them.

    Kept are, per host, the events within the longest chain's window and ``late`` seconds before the newest, and of older
    ones the last of each pid and name, as they may still be the parent of a new process.  So a chain is found whatever
    batches its stages come in, as long as batches are no more than ``late`` seconds out of order.  The batch's events join those kept in the
    same change.
    """
    known = events.withColumn("_host", lineage.host_column())
    hosts = known.select("_host").distinct()
    old = tx.matching(table, hosts, "_host")
    both = known if old is None else old.unionByName(known)
    keep = max(c.window_seconds for c in chains) + late
    if old is not None and len(tx.base.tables[table].layers) >= LAYERS - 1:
        everything = tx.read(table).unionByName(known)
        newest = everything.groupBy("_host").agg(F.max("ts").alias("_newest"))
        named = ["_host", "process_id", "process_name"]
        last = everything.where("process_id IS NOT NULL").groupBy(*named).agg(F.max(F.struct("ts", "event_id")).alias("_last"))
        held = everything.join(newest, "_host").join(last, named, "left")
        held = held.where((F.struct("ts", "event_id") == F.col("_last")) | (F.unix_micros("ts") >= F.unix_micros("_newest") - keep * 1_000_000))
        tx.replace_all(table, held.select(everything.columns))
    else:
        tx.add(table, known, "event_id", "_host")
    return C.incidents(lineage.build(both.drop("_host")), list(chains))


def store_sink(store: Store, rules: list[Rule], chains: list[Chain] = (), hours: int = 24, once: bool = True, stream: str = "events") -> Callable[[DataFrame, int], None]:
    """Folds each batch's alerts into stored episodes and adds its incidents, in one commit with the batch's id.

    Chains go on from batch to batch (``correlate``); an incident that is stored is not added again.  ``once`` skips batches that the store has, so
    that a replay changes nothing wherever the first run broke off; without it a replay counts its alerts again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if once and batch_id <= store.version().batches.get(stream, -1):
            return
        events = materialize(batch, "batch")
        alerts = materialize(with_fingerprints(detect(events, rules)), "alerts")

        def change(tx: Transaction) -> None:
            if once and not tx.begins(stream, batch_id):
                return
            tx.save_episodes("alerts", alerts, hours)
            if chains:
                tx.insert_absent("incidents", correlate(tx, events, list(chains)), "fingerprint")

        store.transact(change)

    return write


def watermarked_counts(events: DataFrame, delay: str = "24 hours", width: str = "1 hour") -> DataFrame:
    """Events per platform and tumbling window; late rows count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "platform").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "platform", "n")


def alert_sessions(alerts: DataFrame, delay: str = "24 hours", gap: str = "24 hours") -> DataFrame:
    """Session windows of alerts with one fingerprint, for a stream in append mode."""
    return (
        alerts.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "fingerprint")
        .agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("score").alias("score"))
        .select("fingerprint", "occurrence_count", "first_seen", "last_seen", "score")
    )


def ingest_logs(spark: SparkSession, store: Store, platform: str, folder: str, checkpoint: str, rules: list[Rule], chains: list[Chain] = (), hours: int = 24, files_per_batch: int | None = None) -> int:
    """Read the log files of a folder that are new since the last run into the store; the number of micro-batches.

    A file is read once, when it is complete (rotated logs, shipped files); its records are put together inside its batch.
    """
    reader = spark.readStream.option("wholetext", str(platform == "windows").lower())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    sink = store_sink(store, rules, chains, hours, stream=f"{platform} {folder}")

    def write(batch: DataFrame, batch_id: int) -> None:
        if platform == "linux":
            events = auditd.events_from_lines(batch.withColumn("at", F.monotonically_increasing_id()))
        else:
            events = (sysmon.events_from_files if platform == "windows" else endpoint_security.events_from_lines)(batch)
        sink(events, batch_id)

    q = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"]])
