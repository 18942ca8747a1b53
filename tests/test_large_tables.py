"""Work that has to hold on tables larger than the tests' own: whole input, and plans that spread it."""

from __future__ import annotations

import datetime

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vulnspark.functions.purl import is_purl, purl_struct
from vulnspark.operators import attack, evidence, matching, rollup_changes, rollups
from vulnspark.plans import rollup_state, snapshot_state
from vulnspark.sources import buckets
from vulnspark.sources.state import StateStore

DAY0 = datetime.datetime(2001, 1, 1)
COLUMNS = {
    "supplier": "s_suppkey bigint, s_nationkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Hosts 9, 27 and 63 with items of their own; tables a query does not read are left out."""
    lines = [(o, 100 + o % 7, supplier, o % 5 + 1, float(o % 9), "ANR"[o % 3], "OF"[o % 2], DAY0 + datetime.timedelta(days=o))
             for o, supplier in enumerate([9, 27, 63] * 12)]
    for name, rows in (("supplier", [(k, k % 5) for k in (9, 27, 63)]), ("lineitem", lines)):
        spark.createDataFrame(rows, COLUMNS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def oracle(folder, name):
    import duckdb

    con = duckdb.connect()
    for t in COLUMNS:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con, entry.oracle_sql()[name]


def test_a_catch_up_folds_the_events_of_every_host(spark, folder):
    got = entry.queries()["fold_catch_up"](spark, folder)
    assert compare(*oracle(folder, "fold_catch_up"), got) == ""
    # Hosts whose number ends in 3 are hosts like any other.
    assert {r["finding_key"].split("-")[0] for r in got.collect()} == {"9", "27", "63"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    before = {}

    def put(**settings):
        for name, value in settings.items():
            name = "spark.sql." + name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_components_are_not_moved_to_the_few_keys_of_a_small_catalogue(spark, conf):
    conf(adaptive__enabled="false")
    # Two lines, of a table whose size is not known beforehand.
    life = spark.range(10_000_000).filter("id < 2").selectExpr(
        "'pkg' AS product", "string(id + 1) AS cycle", "'2000-01-01' AS eol_from", "'' AS eoes_from", "'Pkg' AS label", "'lib' AS category").distinct()
    comps = spark.createDataFrame([("h", "pkg", "deb", v, "/p", "/", "", "") for v in ("1.2", "2", "3", None)],
                                  "hostname string, name string, type string, version string, path string, root string, os_id string, os_version_id string")
    ports = spark.createDataFrame([], "hostname string, package string, bind_scope string")
    state = spark.createDataFrame([], "hostname string, package string, accepted string")
    config = spark.createDataFrame([], "hostname string, purl string, kind string")
    out = evidence.support_lifecycle(comps, life, ports, config, state, 1005000000)
    assert not any(f"hashpartitioning({k}" in plan(out) for k in ("_k1", "_k2", "_k3", "_os"))
    assert {(r["version"], r["cycle"]) for r in out.collect()} == {("1.2", "1"), ("2", "2")}


def test_coverage_keeps_each_exposure_once(spark):
    rows = [("h", "a", 1, "tcp", "wildcard", "p", 0, "c", 5), ("h", "a", 1, "tcp", "specific", None, 1, None, 7), ("h", "a", 2, "tcp", None, None, 0, "c", 6),
            ("g", None, 2, "tcp", "wildcard", "", None, None, None)]
    found = evidence.exposure_coverage(spark.createDataFrame(rows, (
        "hostname string, address string, port int, protocol string, bind_scope string, package string, held_by_os int, container_name string, scanned_at bigint")))
    assert "Expand" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [("g", 0, 0, 0, 0, 1, 0, None), ("h", 2, 1, 1, 1, 1, 1, 7)]


FINDING = ("hostname string, package string, ecosystem string, cve_id string, scope_id string, severity string, confidence string, epss double, "
           "age_days double, status string, accepted string")


def findings(spark):
    rows = [(h, p, "deb", c, "", s, "high", e, a, "open", "0") for h, p, c, s, e, a in (
        ("h", "p", "c1", None, 0.5, 1.0), ("h", "q", "c1", "low", None, 2.0), ("h", "q", None, "low", 0.25, None), ("g", "p", "c2", "low", 0.75, 4.0))]
    return spark.createDataFrame(rows, FINDING)


def test_dimensions_of_a_host_keep_each_finding_once(spark):
    found = rollups.rollup_host_dim(findings(spark))
    assert "Expand" not in plan(found)
    assert {tuple(r) for r in found.filter("dim = 'severity'").collect()} == {
        ("h", "severity", "unrated", 1, 1, 1, 0.5), ("h", "severity", "low", 2, 1, 1, 0.25), ("g", "severity", "low", 1, 1, 1, 0.75)}


def test_dimensions_of_a_fleet_are_counted_from_items(spark):
    found = rollups.rollup_dim(findings(spark))
    assert "Expand" not in plan(found)
    assert {tuple(r) for r in found.filter("dim = 'severity'").collect()} == {
        ("severity", "unrated", 1, 1, 1, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0), ("severity", "low", 3, 2, 2, 0.75, 2.0, 4.0, 2.5, 3.0, 3.5)}


def test_findings_of_one_advisory_are_split_over_tasks(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB", adaptive__skewJoin__skewedPartitionFactor="1",
         adaptive__advisoryPartitionSizeInBytes="1KB", adaptive__coalescePartitions__enabled="false")
    found = spark.range(40_000, numPartitions=8).select("id", F.when(F.col("id") % 1000 == 0, "A2").otherwise("A1").alias("advisory_id"))
    best = matching.enrich(found, spark.createDataFrame([("A1", "b", "t2"), ("A1", "a", "t1"), ("A2", "a", "t3")], "advisory_id string, feed_source string, title string"))
    titles = [r["title"] for r in best.collect()]
    assert "skew=true" in plan(best) and (titles.count("t1"), titles.count("t3")) == (39_960, 40)


def test_what_is_a_purl(spark):
    texts = ["pkg:deb/x", "pkg:", "pkg:/", "pkg:@a", "pkg:/@a", "pkg:@a@b", "pkg:@/@x", "pkg:?a=b", "pkg:#s", "pkg://a", "pkg:\n", "pkg:a@b", "x", "", None, "pkg:/@?@"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(is_purl(F.col("t")) != F.coalesce(purl_struct(F.col("t")).isNotNull(), F.lit(False))).collect() == []
    assert rows.filter(is_purl(F.col("t"))).count() == rows.filter(purl_struct(F.col("t")).isNotNull()).count() == 6


def test_techniques_are_counted_by_kind(spark):
    cwes = spark.createDataFrame([("h", "f1", "w1"), ("h", "f1", "w2"), ("h", "f2", "w2"), ("h", "f2", "w2"), ("g", "f3", "w3"), (None, None, "w1"), ("g", "f4", "w9")],
                                 "hostname string, finding_key string, cwe string")
    maps = [(w, f"T{t}", f"name {t}") for w in ("w1", "w2") for t in range(9)] + [("w2", "T0", None), ("w2", "T0", None), ("w3", "T3", "name 3"), ("w1", "", "n"), (None, "T1", "n")]
    table = spark.createDataFrame(maps, "cwe string, technique string, technique_name string")
    want = attack.technique_surface(cwes, table).groupBy("hostname", "technique", "technique_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("finding_key").alias("findings"))
    got = attack.technique_counts(cwes, table)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # Eight of the techniques are of one kind, so a weakness leads to three rows at most.
    assert attack.technique_kinds(table)[0].groupBy("cwe").count().agg(F.max("count")).first()[0] == 3


def test_a_batch_is_merged_without_staged_changes(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path))
    columns = "hostname string, name string, type string, path string, root string, version string, scanned_at bigint"
    monkeypatch.setattr(buckets.Changes, "_stage", lambda *a: pytest.fail("staged"))
    for run, rows in (("a", [("h", "p", "deb", "/p", "", "1", 5), ("g", "p", "deb", "/p", "", "1", 5)]), ("b", [("h", "p", "deb", "/p", "", "2", 6), ("h", "q", "deb", "/q", "", "1", 6)]),
                      ("c", [("g", "p", "deb", "/p", "", "0", 4)]), ("b", [("h", "p", "deb", "/p", "", "2", 6), ("h", "q", "deb", "/q", "", "1", 6)])):
        snapshot_state.update_components(store, spark.createDataFrame(rows, columns), run)
    now = snapshot_state.current_components(store).select("hostname", "name", "version", "scanned_at")
    assert sorted(map(tuple, now.collect())) == [("g", "p", "1", 5), ("h", "p", "2", 6), ("h", "q", "1", 6)]


def test_identities_are_looked_for_only_under_keys_the_feed_has(spark):
    ids = spark.range(1).select(
        F.lit("deb").alias("ecosystem"), F.array(F.lit("p"), F.lit("s")).alias("names"), F.array().cast("array<string>").alias("cpe_keys"),
        matching.component_os(F.lit("deb"), F.lit("1"), F.lit("ubuntu"), F.lit("22.04")).alias("os"))
    assert matching.wanted_places(ids).count() == 6
    found = matching.wanted_places(ids, ["|", "ubuntu|22", "rhel|9"])
    assert sorted((r["cand_package"], r["cand_os"]) for r in found.collect()) == [(n, k) for n in "ps" for k in ("ubuntu|22", "|")]
    assert found.schema["os"].dataType.names == ["name", "release", "is_rpm", "version"]


def test_roll_ups_follow_what_changed_without_a_row_per_group_and_measure(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    columns = {"finding_key": "hostname", "title": "cve_id", "kev_added": "cve_id", "kev_due": "cve_id"}
    state = findings(spark).withColumns({c: F.concat(F.lit(c), F.col(of)) for c, of in columns.items()}).withColumns(
        {"finding_key": F.concat("hostname", "package", F.coalesce("severity", F.lit(""))), "first_found": F.lit(5).cast("bigint"), "first_seen": F.lit(5).cast("bigint")})
    store.upsert_state(state, "findings_state", ["finding_key"])
    rollup_state.roll_up(store, 10)
    after = store.read_state("findings_state").filter("hostname = 'g'").withColumn("severity", F.lit("high"))
    before = store.read_state("findings_state")
    delta = rollup_changes.signed_facts(before, before.filter("hostname <> 'g'").unionByName(after))
    assert delta.count() == 2 and [r[0] for r in rollup_changes.changed_hosts(delta).collect()] == ["g"]
    store.upsert_state(after, "findings_state", ["finding_key"])
    rollup_state.roll_up(store, 20)
    assert not (tmp_path / "openstate_items").exists()
    want = rollups.rollup_dim(store.read_state("findings_state"))
    got = store.read_state("openstate_dim").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
