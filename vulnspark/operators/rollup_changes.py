"""Roll-ups of open findings kept up to date by signed changes.

What the roll-ups read of a finding is a row of facts. Facts of the old
version count -1, those of the new one +1: what does not cancel has changed,
and only the groups it belongs to are rolled up again, from the findings as
they are now and by the roll-ups' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import present
from vulnspark.operators import rollups
from vulnspark.operators.generic import dimension_rows, lookup
from vulnspark.operators.lifecycle import open_findings
from vulnspark.params import DAY

FACTS = ("hostname", "package", "ecosystem", "cve_id", "scope_id", "severity", "confidence", "epss", "kev_added", "kev_due", "title",
         "first_found", "first_seen", "age_days", "accepted")
#: The facts that say which groups a finding belongs to.
GROUPS = ("hostname", "package", "ecosystem", "cve_id", "scope_id", "severity", "confidence", "accepted")


def finding_facts(state: DataFrame) -> DataFrame:
    return state.filter("status = 'open' AND accepted IS NOT NULL").select(*FACTS)


def signed_facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How the facts differ between two versions of the same findings: what names their groups, and 128 bits of the other facts."""
    both = finding_facts(before).withColumn("d", F.lit(-1)).unionByName(finding_facts(after).withColumn("d", F.lit(1)))
    # A hash passes over nulls, so whether a fact is null goes in beside it.
    rest = [x for c in FACTS if c not in GROUPS for x in (F.col(c), F.col(c).isNull())]
    both = both.select(*GROUPS, F.xxhash64(*rest).alias("rest_a"), F.xxhash64(F.lit("second"), *rest).alias("rest_b"), "d")
    return both.groupBy(*GROUPS, "rest_a", "rest_b").agg(F.sum("d").alias("d")).filter("d <> 0")


def changed_hosts(delta: DataFrame) -> DataFrame:
    return delta.select("hostname").filter("hostname IS NOT NULL").distinct()


def changed_cves(delta: DataFrame) -> DataFrame:
    return delta.filter("accepted <> '1' AND cve_id IS NOT NULL").select("cve_id").distinct()


def changed_dims(delta: DataFrame) -> DataFrame:
    return dimension_rows(delta.filter("accepted <> '1'"), rollups.dimensions(rollups.DIMS)).select("dim", "value").distinct()


def changed_host_dims(delta: DataFrame) -> DataFrame:
    rows = dimension_rows(delta.filter("accepted <> '1'"), rollups.dimensions(rollups.HOST_DIMS))
    return rows.select("hostname", "dim", "value").distinct()


def host_rows(state: DataFrame, now: int, only: DataFrame | None = None) -> DataFrame:
    """Hosts with open findings; ``recent`` has the findings of the last week by the time they were found."""
    rows = finding_facts(state).filter("hostname IS NOT NULL")
    rows = rows if only is None else rows.join(only, "hostname", "left_semi")
    counts = F.col("accepted") != "1"
    found = F.coalesce("first_found", "first_seen").cast("bigint")
    recent = rows.filter(counts & (found >= now - 7 * DAY)).groupBy("hostname", found.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    recent = recent.groupBy("hostname").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("recent"))
    out = rows.groupBy("hostname").agg(
        F.count_if(counts).alias("findings"), F.count_distinct(F.when(counts, F.col("cve_id"))).alias("cves"),
        F.count_if(counts & present("kev_added")).alias("kev"), F.max(F.when(counts, F.col("epss"))).alias("top_epss"),
        F.count_if(~counts).alias("accepted")).filter("findings > 0")
    out = lookup(out, recent, ["hostname"], ["recent"])
    return out.withColumn("recent", F.coalesce("recent", F.array().cast(recent.schema["recent"].dataType)))


def host_view(rows: DataFrame, now: int) -> DataFrame:
    """Host rows as they read at a later time: a finding older than a week is no longer new."""
    new = F.aggregate(F.filter("recent", lambda r: r["t"] >= now - 7 * DAY), F.lit(0).cast("bigint"), lambda total, r: total + r["n"])
    return rows.select("hostname", "findings", "cves", "kev", new.alias("new_7d"), "top_epss", "accepted", F.lit(now).cast("bigint").alias("rolled_at"))


def cve_rows(state: DataFrame, only: DataFrame | None = None) -> DataFrame:
    rows = open_findings(state).filter("cve_id IS NOT NULL")
    return rollups.rollup_cve(rows if only is None else rows.join(only, "cve_id", "left_semi"))
