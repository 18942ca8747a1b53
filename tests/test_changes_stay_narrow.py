"""Changes to kept tables move keys where those are enough, and whole rows once."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.operators import rollup_changes, rollups
from vulnspark.sources.buckets import KeyedTable
from vulnspark.sources.state import StateStore

SCHEMA = "k string, j string, v int"


def rows(df):
    return sorted((tuple(r) for r in df.select("k", "j", "v").collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_given_once_are_staged_as_they_are(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path))
    dedup = DataFrame.dropDuplicates
    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", lambda *a, **k: pytest.fail("whole rows compared"))
    first = [("a", "x", 1), ("a", "y", 2), ("b", None, 3)]
    store.upsert_state(spark.createDataFrame(first, SCHEMA), "t", ["k", "j"])
    assert rows(store.read_state("t")) == sorted(first, key=repr)
    monkeypatch.undo()
    assert DataFrame.dropDuplicates is dedup
    # A null key is a key, and one given twice keeps one row.
    changes = store.changes("t", ["k", "j"], "r")
    changes.upsert(spark.createDataFrame([("c", None, 7), ("c", None, 7), ("a", "x", 5), ("d", "z", 6), ("d", "z", 6)], SCHEMA))
    assert len(changes.staged) == 1
    assert rows(changes.staged[0]) == [("a", "x", 5), ("c", None, 7), ("d", "z", 6)]
    changes.commit()
    assert rows(store.read_state("t")) == [("a", "x", 5), ("a", "y", 2), ("b", None, 3), ("c", None, 7), ("d", "z", 6)]


def test_steps_on_other_keys_are_put_together_without_a_comparison(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    changes = store.changes("t", ["k", "j"], "r", SCHEMA)
    changes.upsert(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], SCHEMA))
    changes.delete(spark.createDataFrame([("c", "x")], "k string, j string"))
    assert "max_by" not in plan(changes.newest())
    assert {(r.k, r.v, r._gone) for r in changes.newest().collect()} == {("a", 1, False), ("b", 2, False), ("c", None, True)}
    changes.upsert(spark.createDataFrame([("b", "x", 9)], SCHEMA))
    assert {(r.k, r.v, r._gone) for r in changes.newest().collect()} == {("a", 1, False), ("b", 9, False), ("c", None, True)}


def test_rows_that_stay_are_read_only_if_there_are_any(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path))
    table = KeyedTable(store, "t")
    table.replace(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], SCHEMA), ["k", "j"])
    seen, write = [], KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, df, *a: (seen.append(plan(df)), write(self, df, *a))[1])
    store.upsert_state(spark.createDataFrame([("a", "x", 3), ("b", "x", 4)], SCHEMA), "t", ["k", "j"])
    assert "LeftAnti" not in seen[0] and rows(table.read()) == [("a", "x", 3), ("b", "x", 4)]
    # As many changes as rows, but not of the same keys.
    store.upsert_state(spark.createDataFrame([("a", "x", 5), ("c", "x", 6)], SCHEMA), "t", ["k", "j"])
    assert rows(table.read()) == [("a", "x", 5), ("b", "x", 4), ("c", "x", 6)]


def finding(spark, **other):
    fields = {"hostname": "h", "package": "p", "ecosystem": "deb", "cve_id": "c", "scope_id": "", "severity": "low", "confidence": "high", "epss": 0.5,
              "kev_added": None, "kev_due": None, "title": None, "first_found": 1, "first_seen": 1, "age_days": 2.0, "accepted": "0", "status": "open", **other}
    kinds = {"epss": "double", "first_found": "bigint", "first_seen": "bigint", "age_days": "double"}
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in fields))


def test_facts_that_name_no_group_travel_as_hashes_and_still_differ(spark):
    def differ(a, b):
        return rollup_changes.signed_facts(finding(spark, **a), finding(spark, **b))

    assert "title" not in differ({}, {}).columns
    assert differ({}, {}).isEmpty()
    for a, b in (({"title": "t"}, {"title": None}), ({"kev_added": "x"}, {"kev_due": "x"}), ({"epss": None}, {}), ({"age_days": 2.5}, {}), ({"first_found": 9}, {"first_seen": 9})):
        assert sorted(r.d for r in differ(a, b).collect()) == [-1, 1]


def test_findings_of_a_host_are_moved_once_for_all_dimensions(spark):
    found = rollups.rollup_host_dim(finding(spark).unionByName(finding(spark, package="q", severity=None)))
    moved = [line for line in plan(found).splitlines() if "Exchange hashpartitioning(" in line]
    assert len(moved) == 1 and "dim" not in moved[0]
    assert {(r.dim, r.value, r.findings, r.packages) for r in found.filter(F.col("dim") == "severity").collect()} == {("severity", "low", 1, 1), ("severity", "unrated", 1, 1)}
