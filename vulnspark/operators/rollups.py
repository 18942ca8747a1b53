"""Roll-ups of open findings that pages read instead of the finding table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import present
from vulnspark.operators.generic import dimension_rows, lookup, set_size, values
from vulnspark.operators.lifecycle import accepted_findings, open_findings, root_label
from vulnspark.params import DAY


def rollup_host(state: DataFrame, now: int) -> DataFrame:
    recent = F.coalesce("first_found", "first_seen") >= now - 7 * DAY
    rows = open_findings(state).groupBy("hostname").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("cve_id").alias("cves"),
        F.count_if(present("kev_added")).alias("kev"), F.count_if(recent).alias("new_7d"), F.max("epss").alias("top_epss"))
    accepted = accepted_findings(state).groupBy("hostname").agg(F.count(F.lit(1)).alias("accepted"))
    rows = lookup(rows, accepted, ["hostname"], ["accepted"]).fillna(0, ["accepted"])
    return rows.withColumn("rolled_at", F.lit(now).cast("bigint"))


def dimensions(names: tuple[str, ...]) -> dict:
    columns = {"package": F.col("package"), "confidence": F.col("confidence"), "ecosystem": F.col("ecosystem"),
               "severity": F.coalesce("severity", F.lit("unrated")), "root": root_label()}
    return {n: columns[n] for n in names}


DIMS = ("package", "confidence", "severity", "ecosystem", "root")
HOST_DIMS = ("root", "ecosystem", "severity", "confidence")


def rollup_dim(state: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Counts and age quartiles per package, confidence, severity, ecosystem and root; of the pairs in ``only`` if given.

    A value as low as a severity may hold the whole fleet, so its CVEs, hosts
    and ages are first rows of their own with a count, then counted.
    """
    rows = dimension_rows(open_findings(state), dimensions(DIMS))
    rows = rows if only is None else rows.join(only, ["dim", "value"], "left_semi")
    no_text, no_age = F.lit(None).cast("string"), F.lit(None).cast("double")
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text"), age.alias("age")) for kind, text, age in (
        ("cve", F.col("cve_id"), no_age), ("host", F.col("hostname"), no_age), ("age", no_text, F.col("age_days").cast("double")))])
    rows = rows.select("dim", "value", "epss", F.explode(items).alias("_i")).select("dim", "value", "epss", "_i.*")
    rows = rows.groupBy("dim", "value", "kind", "text", "age").agg(F.count(F.lit(1)).alias("n"), F.max("epss").alias("epss"))
    kind, weight = F.col("kind"), F.when(F.col("kind") == "age", F.col("n")).otherwise(F.lit(0))
    quart = F.percentile("age", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), weight)
    rows = rows.groupBy("dim", "value").agg(
        F.sum(weight).alias("findings"), F.count(F.when(kind == "cve", F.col("text"))).alias("cves"),
        F.count(F.when(kind == "host", F.col("text"))).alias("hosts"), F.max("epss").alias("top_epss"),
        F.min("age").alias("age_lo"), quart.alias("_q"), F.max("age").alias("age_hi"))
    return rows.withColumns({"age_q1": F.get("_q", F.lit(0)), "age_med": F.get("_q", F.lit(1)), "age_q3": F.get("_q", F.lit(2))}).drop("_q")


def rollup_host_dim(state: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Counts per host and root, ecosystem, severity and confidence; of the groups in ``only`` if given.

    A host bounds its CVEs and packages, so they are sets, made where the host's findings are: a finding is moved once
    and not as a part of the sets of every dimension.
    """
    facts = open_findings(state).select("hostname", "cve_id", "package", "epss", *[c.alias(n) for n, c in dimensions(HOST_DIMS).items()])
    rows = dimension_rows(facts.repartition("hostname"), {n: F.col(n) for n in HOST_DIMS})
    rows = rows if only is None else rows.join(only, ["hostname", "dim", "value"], "left_semi")
    return rows.groupBy("hostname", "dim", "value").agg(
        F.count(F.lit(1)).alias("findings"), set_size("cve_id").alias("cves"), set_size("package").alias("packages"),
        F.max("epss").alias("top_epss"))


def rollup_cve(state: DataFrame) -> DataFrame:
    """Counts per CVE with the shortest title and the first of each text."""
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.struct(
        F.length("title").alias("l"), F.col("title").alias("t"))))
    return open_findings(state).groupBy("cve_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("hostname").alias("hosts"), values("package").alias("packages"),
        F.max("epss").alias("top_epss"), F.min("severity").alias("severity"), F.min("kev_added").alias("kev_added"),
        F.min("kev_due").alias("kev_due"), title.alias("title"))


def host_overview(hoststate: DataFrame, matchstate: DataFrame, host_rollup: DataFrame, now: int) -> DataFrame:
    """One row per host seen; a host without a roll-up says it is not counted yet."""
    from vulnspark.operators.inventory import silent_for

    rows = lookup(silent_for(hoststate, now), matchstate, ["hostname"], ["n_components"])
    rows = lookup(rows, host_rollup, ["hostname"], ["findings", "cves", "kev", "top_epss", "rolled_at"])
    counted = F.col("rolled_at").isNotNull()
    return rows.select(
        "hostname", "os", "release", "n_components",
        F.when(counted, F.col("findings").cast("string")).otherwise("not counted yet").alias("findings"),
        F.when(counted, F.col("cves").cast("string")).otherwise("").alias("cves"), F.coalesce("kev", F.lit(0)).alias("kev"),
        F.round(F.col("top_epss") * 100, 1).alias("top_epss_pct"), "quiet_for")
