"""Read-only reports over the maintained tables.

A row limit appears only where the report itself is a top list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.cvss import cvss_english, cvss_reach
from vulnspark.functions.text import blank, glob_match, percent, present, stamp_text
from vulnspark.operators.attack import cve_facts
from vulnspark.operators.evidence import scope_key
from vulnspark.operators.generic import lookup, newest_verdicts, values
from vulnspark.operators.lifecycle import accepted_findings, findings_for, open_findings_all, root_label, unfolded_receipts
from vulnspark.operators.network import grade_order
from vulnspark.operators.routes import PATH_ORDER
from vulnspark.params import DAY, Params


def stale_host_count(receipts: DataFrame, matchstate: DataFrame, p: Params = Params()) -> DataFrame:
    return unfolded_receipts(receipts, matchstate, p).agg(F.count(F.lit(1)).alias("stale"))


def rollup_age(host_rollup: DataFrame, now: int) -> DataFrame:
    row = host_rollup.agg(F.count(F.lit(1)).alias("rows"), F.max("rolled_at").alias("rolled_at"))
    return row.withColumn("rolled_mins", F.coalesce(F.round((F.lit(now) - F.col("rolled_at")) / 60.0).cast("bigint"), F.lit(99999)))


def fleet_tiles(feedstate: DataFrame, hoststate: DataFrame, fleet_counts: DataFrame, host_rollup: DataFrame, state: DataFrame,
                now: int) -> DataFrame:
    """Feed age, reporting hosts, components, open and accepted findings in one row."""
    row = feedstate.agg(F.round((F.lit(now) - F.max("imported_at")) / 86400.0, 1).alias("feed_age_days"))
    return row.withColumns({
        "hosts": hoststate.filter(F.col("host_last_scan") >= now - 7 * DAY).agg(F.count_distinct("hostname")).scalar(),
        "components": fleet_counts.filter("hostname = '__fleet__'").agg(F.sum("instances")).scalar(),
        "open": host_rollup.agg(F.sum("findings")).scalar(), "accepted": host_rollup.agg(F.sum("accepted")).scalar(),
        "accepted_kev": accepted_findings(state).filter(present("kev_added")).agg(F.count_distinct("cve_id")).scalar()})


def host_picker(hoststate: DataFrame) -> DataFrame:
    return hoststate.select("hostname").orderBy("hostname")


def components_by_type(host_counts: DataFrame, host: str = "*", top: int = 25) -> DataFrame:
    rows = host_counts.filter(glob_match("hostname", host)).groupBy("type").agg(F.sum("components").alias("components"))
    return rows.orderBy(F.col("components").desc(), "type").limit(top)


def cves_by_root(state: DataFrame, host: str = "*", top: int = 12) -> DataFrame:
    """CVEs per root and severity; roots beyond the largest ``top`` fold into one row that says how many."""
    rows = findings_for(state, host).filter("confidence <> 'informational'")
    counts = rows.groupBy(root_label().alias("root"), F.coalesce("severity", F.lit("unrated")).alias("sev")).agg(
        F.count_distinct("cve_id").alias("cves"))
    totals = counts.groupBy("root").agg(F.sum("cves").alias("_total"))
    n_roots = totals.agg(F.count(F.lit(1))).scalar()
    best = totals.orderBy(F.col("_total").desc(), "root").limit(top).withColumn("_top", F.lit(True))
    more = F.concat((n_roots - top).cast("string"), F.lit(" more roots"))
    rows = counts.join(best.select("root", "_top"), "root", "left")
    rows = rows.withColumn("root", F.when(F.col("_top"), F.col("root")).otherwise(more))
    return rows.groupBy("root", "sev").agg(F.sum("cves").alias("cves"))


def cves_by_severity_and_type(state: DataFrame, host: str = "*") -> DataFrame:
    return findings_for(state, host).groupBy(F.coalesce("severity", F.lit("unrated")).alias("sev"), "ecosystem").agg(
        F.count_distinct("cve_id").alias("cves"))


def host_findings(state: DataFrame, host: str = "*") -> DataFrame:
    return findings_for(state, host).filter("confidence <> 'informational'").select(
        "cve_id", "package", "ecosystem", F.col("last_version").alias("installed_version"), "fixed_version", root_label().alias("root"),
        "confidence", "epss", "title").orderBy(F.col("epss").desc_nulls_last(), "cve_id", "package")


def age_boxes(dim_rollup: DataFrame, at_least: int = 3) -> DataFrame:
    return dim_rollup.filter((F.col("dim") == "severity") & (F.col("cves") >= at_least)).select(
        F.col("value").alias("sev"), "age_lo", "age_q1", "age_med", "age_q3", "age_hi")


def top_types(fleet_counts: DataFrame, top: int = 40) -> DataFrame:
    rows = fleet_counts.filter("hostname = '__fleet__'").select("type", "components")
    return rows.orderBy(F.col("components").desc(), "type").limit(top)


def identifiable_share(fleet_counts: DataFrame) -> DataFrame:
    rows = fleet_counts.filter("hostname = '__fleet__'").groupBy("type").agg(
        F.sum("instances").alias("components"), F.sum("with_identifier").alias("with_identifier"))
    return rows.withColumns({"without_identifier": F.col("components") - F.col("with_identifier"),
                             "identifier_pct": percent(F.col("with_identifier"), F.col("components"))})


def roots_per_ecosystem(state: DataFrame, ecosystem: str) -> DataFrame:
    rows = findings_for(state).filter(F.col("ecosystem") == ecosystem)
    return rows.groupBy(root_label().alias("root"), "hostname").agg(
        F.count_distinct("package").alias("packages"), F.count_distinct("cve_id").alias("cves"))


def windows_distance(winstate: DataFrame) -> DataFrame:
    behind = F.col("behind_ubr")
    return winstate.withColumn("behind", F.when(F.col("latest_ubr").isNull(), "not in the feed").when(
        behind <= 0, "up to date").otherwise(F.concat(behind.cast("string"), F.lit(" builds behind"))))


def cve_tiles(facts: DataFrame, state: DataFrame) -> DataFrame:
    """Highest scores, how many are known exploited, and hosts affected, for a set of CVE facts."""
    row = facts.agg(F.count(F.lit(1)).alias("n"), F.count_if(present("kev_added")).alias("kev"), F.max("cvss_score").alias("_c"), F.max("epss").alias("_e"))
    hosts = open_findings_all(state).join(facts.select("cve_id"), "cve_id", "left_semi").agg(F.count_distinct("hostname")).scalar()
    n, k = F.col("n"), F.col("kev")
    row = row.withColumns({
        "max_cvss": F.coalesce(F.round("_c", 1).cast("string"), F.lit("not scored")),
        "max_epss": F.coalesce(F.concat(F.round(F.col("_e") * 100, 1).cast("string"), F.lit("%")), F.lit("unscored")),
        "kev_text": F.when((n == 1) & (k == 1), "YES").when(n == 1, "not listed").when(
            k == 0, F.concat(F.lit("none of "), n.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(" of "), n.cast("string"))),
        "hosts": hosts})
    return row.filter("n > 0").select("max_cvss", "max_epss", "kev_text", "hosts")


def cve_in_fleet(state: DataFrame, reach: DataFrame, cve: str = "*") -> DataFrame:
    rows = state.filter(glob_match("cve_id", cve)).withColumn("rk_key", scope_key())
    rows = lookup(rows, reach, ["hostname", "rk_key"], {"reach_class": "_r"})
    return rows.select("cve_id", "hostname", "package", "last_version", "fixed_version", "path", "scope", "confidence",
                       F.coalesce("_r", F.lit("not assessed")).alias("reach"), "status",
                       F.when(F.col("accepted") == "1", "yes").otherwise("").alias("accepted"))


def cve_identity(advisories: DataFrame, cvedetail: DataFrame, cve: str | None = None) -> DataFrame:
    """Product and description with their fallbacks, scores and publication."""
    rows = lookup(cve_facts(advisories, cve), cvedetail, ["cve_id"], {
        "products": "_products", "description": "_desc", "assigner": "_assigner", "published": "_pub"})
    kev_name = blank("kev_name") if "kev_name" in rows.columns else F.lit("")
    kev_text = blank("kev_description") if "kev_description" in rows.columns else F.lit("")
    return rows.select(
        "cve_id",
        F.when(present("_products"), F.replace("_products", F.lit("\n"), F.lit(", "))).when(kev_name != "", kev_name).otherwise(
            "not named by the feed").alias("product"),
        F.when(present("_desc"), F.col("_desc")).when(kev_text != "", kev_text).when(present("best_title"), F.col("best_title")).otherwise(
            "No loaded source describes this CVE.").alias("description"),
        "severity", "cvss_score", F.round(F.col("epss") * 100, 1).alias("epss_pct"),
        F.when(present("kev_added"), "yes").otherwise("").alias("kev"),
        F.trim(F.concat(blank("_assigner"), F.lit(" "), F.coalesce("_pub", "published"))).alias("published"))


def kev_detail(facts: DataFrame) -> DataFrame:
    return facts.filter(present("kev_added")).select(
        "cve_id", F.col("kev_added").alias("added"),
        F.when(present("kev_due"), F.col("kev_due")).otherwise("no date given").alias("remediate_by"),
        F.when(present("kev_ransomware"), F.col("kev_ransomware")).otherwise("not stated").alias("ransomware"))


def cve_words(facts: DataFrame) -> DataFrame:
    return cvss_english(facts)


def encyclopaedia_size(cvedetail: DataFrame) -> DataFrame:
    return cvedetail.agg(F.count(F.lit(1)).alias("rows"))


def audit_trail(audit: DataFrame) -> DataFrame:
    return audit.withColumn("when", stamp_text(F.col("at"), "yyyy-MM-dd HH:mm:ss")).orderBy(F.col("at").desc(), "exception_key")


def evidence_ledger(evidence: DataFrame, host: str = "*") -> DataFrame:
    rows = evidence.filter(glob_match("hostname", host)).withColumn("rk_order", grade_order(F.col("observed_grade")))
    last = F.coalesce(stamp_text(F.col("edge_last_seen")), F.lit("never"))
    return rows.withColumn("last_edge", last).orderBy("rk_order", "hostname", "port")


def route_state(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether routes are unconfigured, empty or ready."""
    row = evidence.agg(F.count(F.lit(1)).alias("ledger"), F.count_if(F.col("coverage_state") == "no firewall data").alias("nofw"))
    row = row.withColumn("edges", edges.agg(F.count(F.lit(1))).scalar())
    return row.withColumn("state", F.when((F.col("edges") == 0) & ((F.col("ledger") == 0) | (F.col("nofw") == F.col("ledger"))), "unconfigured").when(
        F.col("edges") == 0, "empty").otherwise("ready"))


def walk_freshness(route_edges: DataFrame) -> DataFrame:
    return route_edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("hosts"), F.max("walked_at").alias("walked_at"))


def path_table(paths: DataFrame, entry: str = "*", host: str = "*", show: str = "all", top: int | None = None) -> DataFrame:
    rows = paths.filter(glob_match("entry", entry))
    if host not in ("*", ""):
        rows = rows.filter(F.exists("hosts", lambda h: glob_match(h, host)))
    if show == "cve":
        rows = rows.filter("full_cve = 1")
    elif show == "no permitted":
        rows = rows.filter(~F.col("flags").contains("P"))
    run = F.when(F.col("full_cve") == 1, "yes, every jump").when(F.col("cve_run") == 0, "no, not even the first").otherwise(
        F.concat(F.lit("the first "), F.col("cve_run").cast("string"), F.lit(" of "), F.col("jumps").cast("string")))
    ordered = rows.withColumn("on_cves_alone", run).orderBy(*[F.col(c).desc() for c in PATH_ORDER], "path_text")
    return ordered if top is None else ordered.limit(top)


def findings_behind(state: DataFrame, exposure: DataFrame, evidence: DataFrame, verdicts: DataFrame, advisories: DataFrame,
                    host: str = "*") -> DataFrame:
    """Open findings behind an observed port, with what they need over the wire; one row per finding."""
    seen = evidence.filter(F.col("observed_grade").isin("confirmed observed", "historically observed")).select(
        "hostname", F.col("port").cast("string").alias("port")).distinct()
    ports = exposure.filter(F.col("package").isNotNull()).select("hostname", "package", F.col("port").cast("string").alias("port")).join(
        seen, ["hostname", "port"], "left_semi").select("hostname", "package").distinct()
    rows = open_findings_all(state).filter(glob_match("hostname", host)).join(ports, ["hostname", "package"], "left_semi")
    vectors = advisories.groupBy("cve_id").agg(cvss_reach(values("cvss_vector")).alias("_r"))
    rows = lookup(rows, vectors, ["cve_id"], {"_r": "_r"})
    rows = lookup(rows, newest_verdicts(verdicts), ["cve_id"], {"priority_tier": "_tier", "priority_score": "score"})
    rank, down = F.coalesce("_r.rank", F.lit(1)), F.coalesce("_r.down", F.lit(0))
    severity = F.when(F.col("severity") == "critical", "P1").when(F.col("severity") == "high", "P2").when(F.col("severity") == "medium", "P3").otherwise("P4")
    return rows.select(
        "finding_key", "hostname", "package", "cve_id", F.coalesce("_tier", severity).alias("tier"), "score",
        F.when(rank == 3, "yes, by anyone").when(rank == 2, "yes, with an account or a victim's action").when(
            rank == 1, "unrated").when(down == 1, "to stop the service only").when(
            down == 2, "to read or change little only").otherwise("no").alias("over_the_wire"))


def jump_list(route_edges: DataFrame, listeners: DataFrame, top: int | None = None) -> DataFrame:
    """Jumps of the graph, one row per port, with what listens there."""
    best = route_edges
    if top is not None:
        best = route_edges.orderBy("hop", F.col("rk_rank").desc(), F.col("sessions").desc(), "src", "dst").limit(top)
    rows = best.withColumn("listen_port", F.explode(F.split("ports", ",")))
    rows = lookup(rows, listeners, {"dst": "hostname", "listen_port": "port"}, {"packages": "_sw", "rk_open": "_open", "rk_hop_class": "_class"})
    return rows.select(
        "src", "dst", "hop", "listen_port", F.coalesce("_sw", F.lit("nothing the inventory knows of")).alias("listening"),
        F.coalesce("_open", F.lit(0)).alias("open"),
        F.when(F.col("_class") == "cve", "a CVE alone").when(F.col("_class") == "foothold", "a foothold first").when(
            F.col("_class") == "unrated", "cannot say, no CVSS vector").otherwise("a zero-day or permissions").alias("this_port_needs"))


def top_hosts(host_rollup: DataFrame, n: int = 20) -> DataFrame:
    return host_rollup.orderBy(F.col("kev").desc(), F.col("cves").desc(), "hostname").limit(n)


def kev_table(cve_rollup: DataFrame) -> DataFrame:
    return cve_rollup.filter(present("kev_added")).withColumn("epss_pct", F.round(F.col("top_epss") * 100, 1)).orderBy(
        F.col("hosts").desc(), "cve_id")


def package_treemap(dim_rollup: DataFrame, n: int = 60) -> DataFrame:
    rows = dim_rollup.filter("dim = 'package'").select(F.col("value").alias("package"), "cves", "top_epss")
    return rows.orderBy(F.col("cves").desc(), "package").limit(n)


def confidence_split(dim_rollup: DataFrame) -> DataFrame:
    return dim_rollup.filter("dim = 'confidence'").select(F.col("value").alias("confidence"), "findings").orderBy("confidence")


def replay_view(replay: DataFrame) -> DataFrame:
    return replay.withColumn("move", F.concat("from_tier", F.lit(" to "), "to_tier"))
