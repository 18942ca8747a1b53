"""Stateful streams against the batch operators, restarted from their checkpoints."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vulnspark.operators import inventory, lifecycle
from vulnspark.params import DAY, Params
from vulnspark.streaming.cadence import contact_stream, fold_acknowledgements

T0 = 1767225600


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_contacts_silence_and_retirement_as_in_the_batch(spark, tmp_path):
    schema, folder, out, ckpt = "hostname string, scanned_at bigint", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    rng, heard = random.Random(2), []
    for host in range(12):
        at = T0 + host
        for _ in range(rng.randrange(2, 16)):
            heard.append((f"h{host}", at))
            at += rng.randrange(3600, 3 * DAY)
    heard.sort(key=lambda r: r[1] + rng.randrange(7200))
    cut = len(heard) // 2
    for part in (heard[:cut], heard[cut:] + [("clock", T0 + 60 * DAY)]):
        add(spark, folder, part, schema)
        # Each run is a new query that goes on from the checkpoint.
        run(contact_stream(spark.readStream.schema(schema).parquet(folder), "2 hours"), out, ckpt)
    now = T0 + 60 * DAY - 7200
    events = spark.read.parquet(out)
    batch = {r.hostname: r for r in inventory.cadence_from_contacts(spark.createDataFrame(heard, schema), now).collect()}
    newest = events.filter("event = 'contact'").groupBy("hostname").agg(F.max_by(F.struct("n_gaps", "median_gap", "p95_gap", "learned", "last_contact_at"), F.struct("last_contact_at", "n_gaps")).alias("r"))
    got = {r.hostname: r.r for r in newest.filter("hostname <> 'clock'").collect()}
    assert {h: tuple(r) for h, r in got.items()} == {h: (r.n_gaps, r.median_gap, r.p95_gap, r.learned, r.last_contact_at) for h, r in batch.items()}
    silent = {r.hostname for r in events.filter("event = 'silent'").collect() if r.last_contact_at == batch[r.hostname].last_contact_at}
    assert silent == {h for h, r in batch.items() if r.late} and silent
    # Half a year on, silent hosts retire, once, and leave no state.
    for later in (200, 201):
        add(spark, folder, [("clock", T0 + later * DAY)], schema)
        run(contact_stream(spark.readStream.schema(schema).parquet(folder), "2 hours"), out, ckpt)
    retired = [r.hostname for r in spark.read.parquet(out).filter("event = 'retired'").collect()]
    due = {h for h, r in batch.items() if r.learned and T0 + 201 * DAY - 7200 - r.last_contact_at > max(180 * DAY, 4 * r.p95_gap)}
    assert sorted(retired) == sorted(due) and due


def test_receipts_are_acknowledged_once_or_leave_after_the_window(spark, tmp_path):
    sent_schema, fold_schema = "hostname string, match_run bigint, findings_produced bigint, ingested_at bigint", "hostname string, state_run bigint, rows_at_run bigint, folded_pass_at bigint"
    sent, folds, out, ckpt = (str(tmp_path / n) for n in ("sent", "folds", "out", "ckpt"))
    p = Params()

    def go():
        run(fold_acknowledgements(spark.readStream.schema(sent_schema).parquet(sent), spark.readStream.schema(fold_schema).parquet(folds)), out, ckpt)

    add(spark, sent, [("a", T0, 3, T0), ("b", T0, 2, T0), ("c", T0, 0, T0), ("d", T0, 5, T0)], sent_schema)
    add(spark, folds, [("a", T0, 3, T0 + 60), ("a", T0, 3, T0 + 120), ("d", T0, 4, T0 + 60)], fold_schema)
    go()
    # Five days late, but inside the window; a fold that is too late for d.
    add(spark, folds, [("b", T0, 2, T0 + 5 * DAY)], fold_schema)
    add(spark, sent, [("e", T0 + 5 * DAY, 1, T0 + 5 * DAY)], sent_schema)
    go()
    add(spark, folds, [("d", T0, 5, T0 + 8 * DAY), ("z", 0, 0, T0 + 30 * DAY)], fold_schema)
    add(spark, sent, [("y", T0 + 30 * DAY, 0, T0 + 30 * DAY)], sent_schema)
    go()
    # The watermark of one run is the limit of the next.
    add(spark, folds, [("z", 1, 0, T0 + 31 * DAY)], fold_schema)
    add(spark, sent, [("z", T0 + 31 * DAY, 0, T0 + 31 * DAY)], sent_schema)
    go()
    got = sorted((r.hostname, r.match_run, r.folded) for r in spark.read.parquet(out).collect() if r.hostname < "y")
    assert got == [("a", T0, True), ("b", T0, True), ("c", T0, True), ("d", T0, False), ("e", T0 + 5 * DAY, False)]
    receipts = spark.read.parquet(sent).filter("hostname < 'y'")
    matchstate = spark.createDataFrame([(h, run if ok else None) for h, run, ok in got], "hostname string, folded_run bigint")
    assert sorted(r.hostname for r in lifecycle.unfolded_receipts(receipts, matchstate, p).collect()) == ["d", "e"]
