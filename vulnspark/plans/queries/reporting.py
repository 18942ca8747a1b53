"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.operators import attack, evidence, reports, rollups, routes
from vulnspark.plans.queries.context import _HOP, _LONG, _OPEN, _hop_classes
from vulnspark.plans.queries.evidence import _REACH
from vulnspark.plans.queries.lifecycle import _MATCHED, _RECEIPTS
from vulnspark.plans.queries.registry import query
from vulnspark.plans.testbed import NOW, Bed


@query("stale_host_count", f"""WITH r AS ({_RECEIPTS}), m AS ({_MATCHED}), g AS (SELECT hostname, max(match_run) AS run, sum(findings_produced) AS p FROM r GROUP BY hostname)
SELECT count(*) AS stale FROM g LEFT JOIN m ON m.hostname = g.hostname WHERE p > 0 AND NOT coalesce(abs(m.folded_run - g.run) < 300, false)""")
def stale_host_count(bed: Bed):
    return reports.stale_host_count(bed.sql(_RECEIPTS), bed.sql(_MATCHED))


@query("rollup_age", f"WITH {_OPEN} SELECT count(DISTINCT hostname) AS rows, max(last_seen) AS rolled_at, CAST(round((1005000000 - max(last_seen)) / 60.0) AS BIGINT) AS rolled_mins FROM op")
def rollup_age(bed: Bed):
    rolled = bed.finding.filter("status = 'open' and accepted <> '1'").groupBy("hostname").agg(F.max("last_seen").alias("rolled_at"))
    return reports.rollup_age(rolled, NOW)


_FLEET = "SELECT '__fleet__' AS hostname, type, count(DISTINCT name) AS components, count(*) AS instances, CAST(count(CASE WHEN purl <> '' THEN 1 END) AS BIGINT) AS with_identifier FROM t_component GROUP BY type"


@query("fleet_tiles", f"""WITH {_OPEN}, fl AS ({_FLEET}) SELECT round((1005000000 - (SELECT max(floor(epoch(o_orderdate))) FROM b_orders)) / 86400.0, 1) AS feed_age_days, (SELECT count(*) FROM t_host WHERE host_last_scan >= 1005000000 - 604800) AS hosts,
  (SELECT CAST(sum(instances) AS BIGINT) FROM fl) AS components, (SELECT count(*) FROM op) AS open, (SELECT count(*) FROM t_finding WHERE status = 'open' AND accepted = '1' AND hostname IN (SELECT hostname FROM op)) AS accepted,
  (SELECT count(DISTINCT cve_id) FROM t_finding WHERE status = 'open' AND accepted = '1' AND kev_added <> '') AS accepted_kev""")
def fleet_tiles(bed: Bed):
    feed = bed.sql("SELECT max(@EPOCH(o_orderdate)) AS imported_at FROM b_orders")
    return reports.fleet_tiles(feed, bed.host, bed.sql(_FLEET), rollups.rollup_host(bed.finding, NOW), bed.finding, NOW)


@query("components_by_type", "SELECT type, CAST(sum(n) AS BIGINT) AS components FROM (SELECT hostname, type, count(DISTINCT name) AS n FROM t_component GROUP BY ALL) GROUP BY type ORDER BY components DESC, type LIMIT 25")
def components_by_type(bed: Bed):
    per = bed.component.groupBy("hostname", "type").agg(F.count_distinct("name").alias("components"))
    return reports.components_by_type(per)


@query("top12_bucket", f"""WITH {_OPEN}, c AS (SELECT CASE WHEN scope_id <> '' THEN scope_id ELSE 'host' END AS root, coalesce(severity, 'unrated') AS sev, count(DISTINCT cve_id) AS cves FROM op WHERE confidence <> 'informational' GROUP BY ALL),
t AS (SELECT root, row_number() OVER (ORDER BY sum(cves) DESC, root) AS k FROM c GROUP BY root)
SELECT CASE WHEN t.k <= 12 THEN c.root ELSE concat((SELECT count(*) - 12 FROM t), ' more roots') END AS root, sev, CAST(sum(cves) AS BIGINT) AS cves FROM c JOIN t ON t.root = c.root GROUP BY ALL""")
def top12_bucket(bed: Bed):
    return reports.cves_by_root(bed.finding)


@query("cves_by_severity_type", f"WITH {_OPEN} SELECT coalesce(severity, 'unrated') AS sev, ecosystem, count(DISTINCT cve_id) AS cves FROM op GROUP BY ALL")
def cves_by_severity_type(bed: Bed):
    return reports.cves_by_severity_and_type(bed.finding)


@query("host_finding_list", f"WITH {_OPEN} SELECT cve_id, package, last_version AS installed_version, CASE WHEN scope_id <> '' THEN scope_id ELSE 'host' END AS root, epss FROM op WHERE confidence <> 'informational'")
def host_finding_list(bed: Bed):
    return reports.host_findings(bed.finding).select("cve_id", "package", "installed_version", "root", "epss")


@query("age_boxes", f"WITH {_LONG} SELECT p.value AS sev, min(age_days) AS age_lo, round(quantile_cont(age_days, 0.5), 3) AS age_med, max(age_days) AS age_hi FROM long WHERE p.dim = 'severity' GROUP BY p.value HAVING count(DISTINCT cve_id) >= 3")
def age_boxes(bed: Bed):
    return reports.age_boxes(rollups.rollup_dim(bed.finding)).select("sev", "age_lo", F.round("age_med", 3).alias("age_med"), "age_hi")


@query("identifiable_share", f"WITH fl AS ({_FLEET}) SELECT type, instances AS components, with_identifier, instances - with_identifier AS without_identifier, round(100.0 * with_identifier / instances, 1) AS identifier_pct FROM fl")
def identifiable_share(bed: Bed):
    return reports.identifiable_share(bed.sql(_FLEET))


@query("top_types", f"WITH fl AS ({_FLEET}) SELECT type, components FROM fl ORDER BY components DESC, type LIMIT 40")
def top_types(bed: Bed):
    return reports.top_types(bed.sql(_FLEET))


@query("roots_per_ecosystem", f"WITH {_OPEN} SELECT CASE WHEN scope_id <> '' THEN scope_id ELSE 'host' END AS root, hostname, count(DISTINCT package) AS packages, count(DISTINCT cve_id) AS cves FROM op WHERE ecosystem = 'deb' GROUP BY ALL")
def roots_per_ecosystem(bed: Bed):
    return reports.roots_per_ecosystem(bed.finding, "deb")


@query("cve_tiles", """WITH f AS (SELECT cve_id, max(cvss_score) AS c, max(epss) AS e, max(kev_added) AS k FROM t_advisory GROUP BY cve_id)
SELECT concat(round(max(c), 1)) AS max_cvss, concat(round(max(e) * 100, 1), '%') AS max_epss, concat(count_if(k <> ''), ' of ', count(*)) AS kev_text, (SELECT count(DISTINCT hostname) FROM t_finding WHERE status = 'open' AND cve_id IN (SELECT cve_id FROM f)) AS hosts FROM f""")
def cve_tiles(bed: Bed):
    return reports.cve_tiles(attack.cve_facts(bed.advisory), bed.finding)


@query("cve_in_fleet", f"""WITH {_REACH} SELECT f.cve_id, f.hostname, f.package, coalesce(r.reach_class, 'not assessed') AS reach, f.status, CASE WHEN f.accepted = '1' THEN 'yes' ELSE '' END AS accepted FROM t_finding f
LEFT JOIN reach r ON r.hostname = f.hostname AND r.rk_key = CASE WHEN f.scope_id LIKE 'container:%' THEN concat('container:', substr(f.scope_id, 11, 12)) ELSE f.package END""")
def cve_in_fleet(bed: Bed):
    return reports.cve_in_fleet(bed.finding, evidence.reach(bed.exposure, NOW)).select("cve_id", "hostname", "package", "reach", "status", "accepted")


@query("cve_identity", """WITH f AS (SELECT cve_id, arg_min(title, (-length(title), title)) AS t, max(epss) AS e, min(published) AS p FROM t_advisory GROUP BY cve_id), d AS (SELECT cve_id, max(title) AS products, any_value('') AS description FROM t_advisory GROUP BY cve_id)
SELECT f.cve_id, coalesce(d.products, 'not named by the feed') AS product, f.t AS description, round(f.e * 100, 1) AS epss_pct FROM f LEFT JOIN d ON d.cve_id = f.cve_id""")
def cve_identity(bed: Bed):
    detail = bed.advisory.groupBy("cve_id").agg(F.max("title").alias("products")).withColumns(
        {"description": F.lit(""), "assigner": F.lit("cna"), "published": F.lit("2001")})
    return reports.cve_identity(bed.advisory, detail).select("cve_id", "product", "description", "epss_pct")


@query("kev_detail", """SELECT cve_id, min(nullif(kev_added, '')) AS added, min(nullif(kev_due, '')) AS remediate_by, min(nullif(kev_ransomware, '')) AS ransomware FROM t_advisory GROUP BY cve_id HAVING min(nullif(kev_added, '')) IS NOT NULL""")
def kev_detail(bed: Bed):
    return reports.kev_detail(attack.cve_facts(bed.advisory))


@query("evidence_ledger", """SELECT hostname, port, observed_grade, CASE observed_grade WHEN 'confirmed observed' THEN 0 WHEN 'historically observed' THEN 1 WHEN 'not observed' THEN 2 ELSE 3 END AS rk_order FROM t_netevidence""")
def evidence_ledger(bed: Bed):
    return reports.evidence_ledger(bed.netevidence).select("hostname", "port", "observed_grade", "rk_order")


@query("route_state", "SELECT (SELECT count(*) FROM t_netevidence) AS ledger, CAST(0 AS BIGINT) AS nofw, (SELECT count(*) FROM t_edge) AS edges, 'ready' AS state")
def route_state(bed: Bed):
    return reports.route_state(bed.edge, bed.netevidence)


@query("findings_behind_ports", f"""WITH {_HOP}, seen AS (SELECT DISTINCT hostname, port FROM t_netevidence WHERE observed_grade IN ('confirmed observed', 'historically observed'))
SELECT DISTINCT f.finding_key, x.top AS tier, CASE x.r WHEN 3 THEN 'yes, by anyone' WHEN 2 THEN 'yes, with an account or a victim''s action' WHEN 1 THEN 'unrated' ELSE CASE WHEN x.down = 1 THEN 'to stop the service only' ELSE 'no' END END AS over_the_wire
FROM t_finding f JOIN hf x ON x.hostname = f.hostname AND x.package = f.package AND x.cve_id = f.cve_id JOIN seen s ON s.hostname = x.hostname AND s.port = x.port WHERE f.status = 'open'""")
def findings_behind_ports(bed: Bed):
    out = reports.findings_behind(bed.finding, bed.exposure, bed.netevidence, bed.verdict, bed.advisory)
    return out.select("finding_key", "tier", "over_the_wire")


@query("jump_list", f"""WITH {_HOP}, bare AS (SELECT DISTINCT hostname, concat(port) AS port, package FROM t_exposure WHERE package IS NOT NULL AND hostname IN (SELECT dst FROM t_jump)),
ls AS (SELECT b.hostname, b.port, string_agg(b.package, ', ' ORDER BY b.package) AS packages, CAST(sum(coalesce(h.rk_open, 0)) AS BIGINT) AS o FROM bare b LEFT JOIN hc h ON h.hostname = b.hostname AND h.port = b.port AND h.package = b.package GROUP BY ALL),
e AS (SELECT src, dst, max(rk_rank) AS rk, sum(sessions) AS s FROM t_jump WHERE src <> dst GROUP BY ALL), x AS (SELECT DISTINCT e.src, e.dst, j.port FROM e JOIN t_jump j ON j.src = e.src AND j.dst = e.dst)
SELECT x.src, x.dst, x.port AS listen_port, coalesce(ls.packages, 'nothing the inventory knows of') AS listening, coalesce(ls.o, 0) AS open FROM x LEFT JOIN ls ON ls.hostname = x.dst AND ls.port = x.port""")
def jump_list(bed: Bed):
    edges = routes.merge_edges(bed.jump).withColumns({"ports": F.array_join("ports", ","), "hop": F.lit(1)})
    listeners = routes.route_listeners(_hop_classes(bed), bed.exposure, bed.jump)
    return reports.jump_list(edges, listeners).select("src", "dst", "listen_port", "listening", "open")


@query("top_hosts", f"WITH {_OPEN} SELECT hostname, count_if(kev_added <> '') AS kev, count(DISTINCT cve_id) AS cves FROM op GROUP BY hostname ORDER BY kev DESC, cves DESC, hostname LIMIT 20")
def top_hosts(bed: Bed):
    return reports.top_hosts(rollups.rollup_host(bed.finding, NOW)).select("hostname", "kev", "cves")


@query("kev_table", f"WITH {_OPEN} SELECT cve_id, count(DISTINCT hostname) AS hosts, round(max(epss) * 100, 1) AS epss_pct FROM op GROUP BY cve_id HAVING min(kev_added) <> ''")
def kev_table(bed: Bed):
    return reports.kev_table(rollups.rollup_cve(bed.finding)).select("cve_id", "hosts", "epss_pct")


@query("package_treemap", f"WITH {_OPEN} SELECT package, count(DISTINCT cve_id) AS cves, max(epss) AS top_epss FROM op GROUP BY package ORDER BY cves DESC, package LIMIT 60")
def package_treemap(bed: Bed):
    return reports.package_treemap(rollups.rollup_dim(bed.finding))


@query("daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM b_events GROUP BY ALL")
def daily_counts(bed: Bed):
    from vulnspark.streaming.incremental import daily_counts as per_day

    return per_day(bed.b_events)
