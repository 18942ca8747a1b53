"""Streaming form of the hourly run and of the daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnspark.operators import lifecycle
from vulnspark.params import Params
from vulnspark.plans.hourly import hourly, ingest, newest_batch
from vulnspark.schemas import STATE
from vulnspark.sources.inventory import stream_inventory
from vulnspark.sources.state import StateStore


def already_done(store: StateStore, stream: str, batch_id: int) -> bool:
    """Whether a batch was committed before a restart replayed it."""
    progress = newest_batch(store.read_state("stream_progress", STATE["stream_progress"]), stream).first()
    return progress is not None and progress["batch_id"] >= batch_id


def mark_done(store: StateStore, stream: str, batch_id: int) -> None:
    row = store.spark.createDataFrame([(stream, batch_id)], STATE["stream_progress"])
    store.upsert_state(row, "stream_progress", ["stream"])


def run_time(store: StateStore, stream: str, batch_id: int, clock) -> int:
    """The time of a batch's run: fixed before it starts, so a repeated batch runs under the same one."""
    known = store.read_state("stream_runs", STATE["stream_runs"]).filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).first()
    if known is not None:
        return known["now"]
    now = int(clock())
    store.upsert_state(store.spark.createDataFrame([(stream, batch_id, now)], STATE["stream_runs"]), "stream_runs", ["stream"])
    return now


def run_stream(spark: SparkSession, folder: str, store: StateStore, checkpoint: str, clock, p: Params = Params(),
               trigger: dict | None = None) -> StreamingQuery:
    """Scan files into the event tables and one maintenance run per micro-batch.

    The checkpoint takes each file once. A batch that was committed is
    recognised by its recorded id; one that stopped half-way is done again
    under the same batch name and time, so nothing is added or counted twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if already_done(store, "inventory", batch_id):
            return
        ingest(store, batch, f"inventory-{batch_id}")
        hourly(store, run_time(store, "inventory", batch_id, clock), p)
        mark_done(store, "inventory", batch_id)

    return (stream_inventory(spark, folder).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def fold_stream(events: DataFrame, store: StateStore, checkpoint: str, now: int, trigger: dict | None = None) -> StreamingQuery:
    """Finding events folded into the finding table batch by batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if already_done(store, "fold", batch_id):
            return
        state = store.read_state("findings_state", STATE["findings_state"])
        rows, receipts = lifecycle.fold(state, batch, now)
        keep = [c for c in rows.columns if c in state.columns]
        store.replace_state(receipts, "fold_receipts")
        store.upsert_state(rows.select(keep), "findings_state", ["finding_key"])
        store.upsert_state(store.read_state("fold_receipts"), "foldstate", ["hostname"])
        mark_done(store, "fold", batch_id)

    return (events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """Events per day and kind; on a stream, late rows are accepted for two days."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind)
            .agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n"))
