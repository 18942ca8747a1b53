"""Priority, escalation, exceptions and feed edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vulnspark.operators import priority
from vulnspark.operators.generic import newest_verdicts
from vulnspark.operators.priority import asserts_internet
from vulnspark.sources import advisory_feeds

FACTS = ("esc_attack_vector string, esc_impact_c string, esc_impact_i string, esc_impact_a string, esc_reach_rank int, esc_load_rank int, "
         "esc_eol_support string, esc_has_fix int, priority_tier string, priority_score int, from_t0 int")


def facts(spark, **over):
    row = {"esc_attack_vector": "N", "esc_impact_c": "H", "esc_impact_i": "H", "esc_impact_a": "H", "esc_reach_rank": 0, "esc_load_rank": 3,
           "esc_eol_support": "", "esc_has_fix": 1, "priority_tier": "P2", "priority_score": 50, "from_t0": 0, **over}
    return spark.createDataFrame([tuple(row.values())], FACTS)


def test_rule_moves_one_tier_and_never_past_the_floor(spark):
    row = priority.apply_rules(facts(spark), priority.SHIPPED_RULES).first()
    assert (row.priority_tier, row.priority_score, row.escalated, row.deterministic_tier) == ("P1", 65, 1, "P2")
    assert priority.apply_rules(facts(spark, priority_tier="P1"), priority.SHIPPED_RULES).first().escalated == 0
    assert priority.apply_rules(facts(spark, from_t0=1), priority.SHIPPED_RULES).first().escalated == 0


def test_destroying_the_fact_stops_the_rule(spark):
    for fact in ("esc_load_rank", "esc_reach_rank"):
        assert priority.apply_rules(priority.mutate(facts(spark), fact), priority.SHIPPED_RULES).first().escalated == 0
    with pytest.raises(ValueError):
        priority.mutate(facts(spark), "esc_no_such_fact")


def test_rules_may_only_name_measured_facts():
    with pytest.raises(ValueError):
        priority.check_rules({"r": "esc_route_evidence = 'unknown'"})
    with pytest.raises(ValueError):
        priority.check_rules({"r": "1 = 1"})


def test_t0_and_score(spark):
    schema = "kev boolean, cvss double, epss double, zone string, m string, want string"
    rows = [(True, 9.4, 0.5, "internet-facing", "yes", "P0"), (False, 3.1, 0.01, "isolated", "no", "P4"), (False, None, 0.3, "internal", "unknown", None)]
    out = spark.createDataFrame(rows, schema).withColumn("t0", priority.t0_tier(F.col("kev"), F.col("cvss"), F.col("epss"), F.col("zone"), F.col("m")))
    assert out.filter("not (t0 <=> want)").count() == 0
    score = priority.priority_score(F.lit(True), F.lit(0.9), F.lit(9.8), F.lit("internet-facing"), F.lit("yes"))
    assert spark.range(1).select(score.alias("s")).first().s == 100


def test_osv_range_has_an_interval_for_each_introduction(spark):
    doc = ('{"id":"A","affected":[{"package":{"name":"P","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"introduced":"1"},{"fixed":"2"},'
           '{"introduced":"3"},{"last_affected":"4"}]},{"type":"GIT","events":[{"introduced":"abc"}]}],"versions":["9"]}]}')
    rows = advisory_feeds.osv_ranges(spark.range(1).select(F.from_json(F.lit(doc), advisory_feeds.OSV_SCHEMA).alias("d")).select("d.*")).collect()
    assert [(r.introduced, r.fixed, r.last_affected, r.range_type) for r in rows] == [("1", "2", "", "SEMVER"), ("3", "", "4", "SEMVER")]


def test_introduced_zero_leaves_no_bound(spark):
    doc = '{"id":"A","affected":[{"package":{"name":"P","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]}]}]}'
    rows = advisory_feeds.osv_ranges(spark.range(1).select(F.from_json(F.lit(doc), advisory_feeds.OSV_SCHEMA).alias("d")).select("d.*")).collect()
    assert [(r.introduced, r.fixed, r.last_affected) for r in rows] == [("", "", "")]


def test_ecosystem_parts(spark):
    cases = [("Ubuntu:Pro:FIPS:22.04:LTS", "deb", "ubuntu", "22.04", "pro:fips"), ("Alpine:v3.19", "apk", "alpine", "3.19", ""), ("PyPI", "python", "", "", ""),
             ("Odd:x", "odd", "", "", "x")]
    df = spark.createDataFrame(cases, "e string, t string, d string, r string, v string").withColumn("s", advisory_feeds.split_ecosystem(F.col("e")))
    assert df.filter("s.type <> t or s.distro <> d or s.release <> r or s.variant <> v").collect() == []


def test_repeated_verdicts_give_one_of_each(spark):
    rows = [("CVE-1", "P3", 10, 5), ("CVE-1", "P1", 90, 9), ("CVE-1", "P2", 95, 9), ("CVE-2", None, None, None), ("CVE-2", "P4", 1, None)]
    verdicts = spark.createDataFrame(rows, "cve_id string, priority_tier string, priority_score int, analysed_at long")
    assert {(r.cve_id, r.priority_tier) for r in newest_verdicts(verdicts).collect()} == {("CVE-1", "P2"), ("CVE-2", "P4")}


def test_mentions_are_judged_by_what_stands_just_before(spark):
    texts = ["internet-facing", "not internet-facing", "not internet-facing, " + "x " * 60 + "internet-facing", "not internet-facing or internet-facing", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(asserts_internet(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [True, False, True, False, False, False]
