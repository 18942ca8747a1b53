"""Roll-ups kept by signed changes equal the roll-ups of the whole table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vulnspark.operators import rollup_changes as rc
from vulnspark.operators import rollups
from vulnspark.plans import rollup_state
from vulnspark.schemas import STATE
from vulnspark.sources.buckets import KeyedTable
from vulnspark.sources.state import StateStore

T0 = 1767225600


def finding(rng, key, now):
    return (f"f{key}", f"host-{rng.randrange(5)}", f"pkg{rng.randrange(6)}", rng.choice(["deb", "npm"]), f"CVE-{rng.randrange(8)}",
            rng.choice(["", "snap:a", "snap:b"]), rng.choice(["high", "low", None]), rng.choice(["high", "informational"]),
            rng.choice([None, 0.25, 0.5, rng.random()]), rng.choice(["", "2026-01-01", None]), rng.choice([None, "Flaw", "A longer flaw"]),
            now - rng.randrange(20) * 86400, rng.choice(["open", "open", "open", "mitigated"]), rng.choice(["0", "0", "1", None]), rng.randrange(90) / 4)


COLUMNS = ("finding_key string, hostname string, package string, ecosystem string, cve_id string, scope_id string, severity string, confidence string, "
           "epss double, kev_added string, title string, first_found bigint, status string, accepted string, age_days double")


def frame(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    for f in STATE["findings_state"].split(", "):
        name, kind = f.split(" ", 1)
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select(*[f.split(" ", 1)[0] for f in STATE["findings_state"].split(", ")])


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def check(store, now):
    state = store.read_state("findings_state")
    same(rc.host_view(store.read_state("openstate_host"), now), rollups.rollup_host(state, now))
    same(store.read_state("openstate_dim"), rollups.rollup_dim(state))
    same(store.read_state("openstate_host_dim"), rollups.rollup_host_dim(state))
    same(store.read_state("openstate_cve"), rollups.rollup_cve(state))


def test_equal_to_the_whole_roll_up_after_every_change(spark, tmp_path):
    rng, store, now = random.Random(4), StateStore(spark, str(tmp_path)), T0
    rollup_state.roll_up(store, now)
    store.upsert_state(frame(spark, [finding(rng, i, now) for i in range(80)]), "findings_state", ["finding_key"])
    rollup_state.roll_up(store, now)
    check(store, now)
    # Findings change, close, go and come; the week moves on for hosts that did not change.
    for step in range(2):
        now += 2 * 86400
        changes = store.changes("findings_state", ["finding_key"], f"r{step}")
        changes.upsert(frame(spark, [finding(rng, rng.randrange(100), now) for _ in range(6)]))
        changes.delete(frame(spark, [finding(rng, i, now) for i in range(step * 8, step * 8 + 5)]))
        changes.commit()
        rollup_state.roll_up(store, now)
        check(store, now)
    store.delete_state(store.read_state("findings_state").filter("hostname <> 'host-1'").select("finding_key"), "findings_state", "finding_key")
    rollup_state.roll_up(store, now)
    check(store, now)


def test_a_run_that_stopped_half_way_is_made_up_for(spark, tmp_path, monkeypatch):
    rng, store = random.Random(9), StateStore(spark, str(tmp_path))
    store.upsert_state(frame(spark, [finding(rng, i, T0) for i in range(40)]), "findings_state", ["finding_key"])
    rollup_state.roll_up(store, T0)
    store.upsert_state(frame(spark, [finding(rng, i, T0) for i in range(5)]), "findings_state", ["finding_key"])
    commit = KeyedTable.commit

    def stop(self, *a, **k):
        if self.path.endswith("openstate_dim"):
            raise RuntimeError
        return commit(self, *a, **k)

    monkeypatch.setattr(KeyedTable, "commit", stop)
    with pytest.raises(RuntimeError):
        rollup_state.roll_up(store, T0)
    monkeypatch.undo()
    store.upsert_state(frame(spark, [finding(rng, i, T0) for i in range(3, 9)]), "findings_state", ["finding_key"])
    rollup_state.roll_up(store, T0)
    check(store, T0)
    # The version the roll-ups were made from is gone: they are made anew.
    store.upsert_state(frame(spark, [finding(rng, 50, T0)]), "findings_state", ["finding_key"])
    KeyedTable(store, "findings_state").sweep(grace=-1)
    rollup_state.roll_up(store, T0)
    check(store, T0)
