"""Lookups of a finding's facts that need no shuffle of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.operators import evidence, priority

FINDING = ("hostname string, package string, ecosystem string, path string, cve_id string, scope_id string, fixed_version string, finding_key string")
ROWS = [("h", "p", "deb", "/a", "C1", "", "", "1"), ("h", "p", "deb", "/b", "C1", "", "2", "2"), ("h", "p", "deb", None, "C1", "", "2", "3"),
        ("g", "p", "deb", "/a", "C1", "", "", "4"), (None, "p", "deb", "/a", "C1", "", "", "5"), ("h", "p", "deb", "/a", "C1", "", "", "6")]


def facts(spark):
    reach = spark.createDataFrame([("h", "p", "answers any address")], "hostname string, rk_key string, reach_class string")
    cover = spark.range(1_000_000).filter("id < 1").selectExpr("'h' AS hostname", "id AS assessed_at").distinct()
    loaded = spark.createDataFrame([("h", "p", "p", "a listener loads it", 3, "x", 1, 1)], (
        "hostname string, scope_key string, package string, load_class string, load_rank int, loaders string, loader_count bigint, loaded_listening int"))
    links = spark.range(1_000_000).filter("id < 1").selectExpr("'h' AS hostname", "7 + id AS link_rows", "id AS assessed_at").distinct()
    eol = spark.createDataFrame([("h", "p", "/a", "supported"), ("h", "p", "/b", "no supported release"), ("h", "p", None, "odd"), (None, "p", "/a", "odd"), ("h", "q", "/a", "odd")],
                                "hostname string, package string, path string, support string")
    advisories = spark.createDataFrame([("C1", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], "cve_id string, cvss_vector string")
    return priority.escalation_facts(spark.createDataFrame(ROWS, FINDING), reach, cover, loaded, links, eol, advisories)


def test_support_is_looked_up_by_path_without_moving_it_by_path(spark):
    found = facts(spark)
    got = {r.finding_key: (r.esc_eol_support, r.esc_has_fix, r.esc_reach_rank, r.esc_load_rank) for r in found.collect()}
    assert len(got) == found.count() == len(ROWS)
    assert got == {"1": ("supported", 0, 3, 3), "2": ("no supported release", 1, 3, 3), "3": ("", 1, 3, 3), "4": ("", 0, -1, 0), "5": ("", 0, -1, 0), "6": ("supported", 0, 3, 3)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = facts(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("Exchange hashpartitioning" in line and "path#" in line for line in plan.splitlines())


def test_findings_are_not_moved_to_a_small_table_of_hosts(spark):
    findings = spark.createDataFrame(ROWS, FINDING)
    reach = spark.createDataFrame([("h", "p", "answers any address")], "hostname string, rk_key string, reach_class string")
    # One host, of a table whose size is not known beforehand.
    hosts = spark.range(10_000_000).filter("id < 1").select(F.substring(F.concat(F.lit("h"), F.col("id").cast("string")), 1, 1).alias("hostname"), F.col("id").alias("assessed_at"), F.lit(1).alias("link_rows")).distinct()
    loaded = spark.createDataFrame([], "hostname string, scope_key string, package string, load_class string, load_rank int, loaders string, loader_count bigint, loaded_listening int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (evidence.with_reach(findings, reach, hosts), evidence.with_load_evidence(findings, loaded, hosts)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not any("Exchange hashpartitioning(hostname#" in line and "," not in line.split("hashpartitioning(")[1].split(", 8)")[0] for line in plan.splitlines())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
