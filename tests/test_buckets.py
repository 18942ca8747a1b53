"""Keyed tables in buckets: what a commit rewrites, what readers see, and runs of several changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vulnspark.sources.buckets import KeyedTable
from vulnspark.sources.state import StateStore

SCHEMA = "k string, v int, w string"


def rows_of(df):
    return {r.k: (r.v, r.w) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    t = KeyedTable(store, "t", rows_per_bucket=25)
    t.replace(frame(spark, [(f"k{i}", i, "a") for i in range(400)]), ["k"])
    return t


def changed(spark, rows, gone=()):
    return frame(spark, rows).withColumn("_gone", F.lit(False)).unionByName(
        frame(spark, [(k, None, None) for k in gone]).withColumn("_gone", F.lit(True)))


def test_a_commit_rewrites_only_the_buckets_it_touches(spark, table):
    before = table.manifest()
    assert before.buckets == 16 and sum(before.rows.values()) == 400
    table.commit(changed(spark, [("k7", 70, None), ("new", 1, "n")], ["k9", "absent"]), ["k"])
    after = table.manifest()
    touched = {r.b for r in frame(spark, [(k, 0, "") for k in ("k7", "new", "k9", "absent")]).select(table.bucket(["k"], 16).alias("b")).collect()}
    rewritten = {b for b in after.files if after.files[b] != before.files.get(b)}
    assert rewritten <= touched and len(rewritten) <= 4 < len(after.files)
    assert all(after.files[b] == before.files[b] for b in set(before.files) - touched)
    want = {f"k{i}": (i, "a") for i in range(400) if i != 9} | {"k7": (70, None), "new": (1, "n")}
    assert rows_of(table.read()) == want and sum(after.rows.values()) == 400


def test_a_bucket_may_become_empty_and_a_table_too(spark, table):
    table.commit(changed(spark, [], [f"k{i}" for i in range(400)]), ["k"])
    assert rows_of(table.read()) == {} and sum(table.manifest().rows.values()) == 0
    table.commit(changed(spark, [("x", 1, "y")]), ["k"])
    assert rows_of(table.read()) == {"x": (1, "y")}


def test_readers_keep_their_files_until_the_grace_is_over(spark, table):
    reader = table.read()
    table.commit(changed(spark, [("k1", 5, "b")]), ["k"])
    assert rows_of(reader)["k1"] == (1, "a") and rows_of(table.read())["k1"] == (5, "b")
    named = {f for names in table.manifest().files.values() for f in names}
    table.commit(changed(spark, [("k1", 6, "b")]), ["k"], grace=-1)
    assert len(table.versions()) == 1 and rows_of(table.read())["k1"] == (6, "b")
    still = {f for names in table.manifest().files.values() for f in names}
    assert len(named - still) == 1 and all(table.store._exists(f"{table.path}/{f}") for f in still)
    assert not any(table.store._exists(f"{table.path}/{f}") for f in named - still)


def test_a_commit_that_did_not_finish_is_not_read(spark, table, monkeypatch):
    monkeypatch.setattr(table, "_publish", lambda m: (_ for _ in ()).throw(RuntimeError))
    with pytest.raises(RuntimeError):
        table.commit(changed(spark, [("k1", 5, "b")]), ["k"])
    monkeypatch.undo()
    assert rows_of(table.read())["k1"] == (1, "a")
    table.commit(changed(spark, [("k1", 9, "b")]), ["k"])
    assert rows_of(table.read())["k1"] == (9, "b") and table.manifest().version == 2


def test_buckets_double_as_the_table_grows(spark, table):
    table.commit(changed(spark, [(f"m{i}", i, "b") for i in range(700)]), ["k"])
    m = table.manifest()
    assert m.buckets == 32 and sum(m.rows.values()) == 1100 and len(rows_of(table.read())) == 1100
    table.commit(changed(spark, [("m3", -3, "c")]), ["k"])
    assert rows_of(table.read())["m3"] == (-3, "c") and sum(table.manifest().rows.values()) == 1100


def test_new_columns_and_other_keys(spark, table):
    table.commit(spark.createDataFrame([("k1", 5, "x")], "k string, v int, z string").withColumn("_gone", F.lit(False)), ["k"])
    row = table.read().filter("k = 'k1'").first()
    assert (row.v, row.w, row.z) == (5, None, "x") and table.read().filter("z IS NULL").count() == 399
    with pytest.raises(ValueError):
        table.commit(changed(spark, [("k1", 5, "b")]), ["v"])


def test_changes_of_a_run_are_seen_by_later_steps_and_one_commit(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    store.upsert_state(frame(spark, [("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x")]), "t", ["k"])
    run = store.changes("t", ["k"], "run-1", SCHEMA)
    assert run.commit() is None
    run.upsert(frame(spark, [("a", 10, "y"), ("d", 4, "y")]))
    assert rows_of(run.rows()) == {"a": (10, "y"), "b": (2, "x"), "c": (3, "x"), "d": (4, "y")}
    run.upsert(run.rows().filter("v >= 4").withColumn("v", F.col("v") + 1))
    run.delete(frame(spark, [("b", None, None), ("d", None, None)]))
    run.upsert(frame(spark, [("d", 0, "back")]))
    want = {"a": (11, "y"), "c": (3, "x"), "d": (0, "back")}
    assert rows_of(run.rows()) == want and rows_of(store.read_state("t")) == {"a": (1, "x"), "b": (2, "x"), "c": (3, "x")}
    before = KeyedTable(store, "t").manifest().version
    assert run.commit() == before + 1 and rows_of(store.read_state("t")) == want
    run = store.changes("t", ["k"], "run-2")
    run.replace(frame(spark, [("c", 5, "z"), ("e", 6, "z")]))
    run.commit()
    assert rows_of(store.read_state("t")) == {"c": (5, "z"), "e": (6, "z")}


def test_a_replaced_table_can_be_changed_by_key_later(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    store.replace_state(frame(spark, [("a", 1, "x"), ("b", 2, "x")]), "t")
    store.upsert_state(frame(spark, [("b", 3, "y")]), "t", ["k"])
    assert rows_of(store.read_state("t")) == {"a": (1, "x"), "b": (3, "y")}
    counts = store.delete_state(frame(spark, [("a", 0, ""), ("a", 0, ""), ("", 0, ""), ("z", 0, ""), (None, 0, "")]), "t", "k").first()
    assert (counts.requested, counts.deleted, counts.skipped) == (5, 1, 2)
    store.replace_state(frame(spark, [("q", 1, "x")]), "t")
    assert rows_of(store.read_state("t")) == {"q": (1, "x")}
