"""Inventory, host state and generic relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.operators import generic, inventory
from vulnspark.params import Params
from vulnspark.plans import snapshot_state
from vulnspark.plans.queries.registry import GONE, query
from vulnspark.plans.testbed import EVENTS_NOW, NOW, Bed
from vulnspark.sources.state import backfill_summary, feed_manifest, feed_summary, scratch_store

# Components seen over several scans of a host: one scan per line number.
_SCANS = """
SELECT concat('host-', l_suppkey) AS hostname, concat('pkg', l_partkey % 400) AS name, l_returnflag AS type,
  concat('/p/', l_partkey % 400) AS path, '' AS root, concat('1.', CAST(l_quantity AS INT)) AS version,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('pkg:generic/x@', l_partkey % 400) END AS purl,
  CASE WHEN l_partkey % 4 = 0 THEN concat('vendor ', l_partkey % 5) END AS vendor,
  CAST(1004000000 + l_linenumber * 3600 - l_suppkey AS BIGINT) AS scanned_at
FROM b_lineitem"""
_LATEST = f"""
scans AS ({_SCANS}),
grouped AS (SELECT hostname, name, type, path, root, max(scanned_at) AS scanned_at, arg_max(version, (scanned_at, version)) AS version,
  arg_max(purl, (scanned_at, purl)) AS purl, arg_max(vendor, (scanned_at, vendor)) FILTER (vendor IS NOT NULL) AS vendor
  FROM scans GROUP BY ALL),
latest AS (SELECT * FROM grouped QUALIFY scanned_at >= max(scanned_at) OVER (PARTITION BY hostname))"""
_HASH = "CAST(concat('0x', substr(md5(concat(type, '|', name, '|', version, '|', path)), 1, 8)) AS BIGINT)"


def latest_rows(bed: Bed):
    return inventory.latest_inventory(bed.sql(_SCANS))


@query("latest_inventory", f"WITH {_LATEST} SELECT hostname, name, type, path, version, purl, vendor, scanned_at FROM latest")
def latest_inventory(bed: Bed):
    return latest_rows(bed).select("hostname", "name", "type", "path", "version", "purl", "vendor", "scanned_at")


@query("latest_inventory_batches", f"WITH {_LATEST} SELECT hostname, name, type, path, version, purl, vendor, scanned_at FROM latest")
def latest_inventory_batches(bed: Bed):
    """The same snapshot kept in the store, from three batches of scans that arrive out of order, one of them twice."""
    store, scans = scratch_store(bed.spark, "components"), bed.sql(_SCANS)
    early, late = F.col("scanned_at") < 1004009000, F.col("scanned_at") >= 1004016000
    for run, batch in (("b", scans.filter(~early & ~late)), ("c", scans.filter(late)), ("a", scans.filter(early)), ("c", scans.filter(late))):
        snapshot_state.update_components(store, batch, run)
    return snapshot_state.current_components(store).select("hostname", "name", "type", "path", "version", "purl", "vendor", "scanned_at")


@query("inventory_digest", f"""WITH {_LATEST}
SELECT hostname, CAST(sum({_HASH}) AS BIGINT) AS digest, count(*) AS n_components, max(scanned_at) AS scanned_at FROM latest GROUP BY hostname""")
def inventory_digest(bed: Bed):
    return inventory.inventory_digest(latest_rows(bed))


_BEATS = """
SELECT concat('host-', s_suppkey) AS hostname, CAST(s_suppkey * 1000 AS BIGINT) AS digest, CAST(s_suppkey AS BIGINT) AS n_components,
  CAST(1004000000 + (s_suppkey % 9) * 3600 - s_suppkey AS BIGINT) AS scanned_at FROM b_supplier"""
_DIGEST = f"""
calc AS (SELECT hostname, CAST(sum({_HASH}) AS BIGINT) AS digest, count(*) AS n, max(scanned_at) AS seen_at FROM latest GROUP BY hostname),
beats AS ({_BEATS}),
digests AS (SELECT coalesce(b.hostname, c.hostname) AS hostname,
  CASE WHEN b.hostname IS NOT NULL AND (c.seen_at IS NULL OR b.scanned_at >= c.seen_at) THEN b.digest ELSE c.digest END AS digest,
  CASE WHEN b.hostname IS NOT NULL AND (c.seen_at IS NULL OR b.scanned_at >= c.seen_at) THEN b.n_components ELSE c.n END AS n_components,
  greatest(b.scanned_at, c.seen_at) AS scanned_at,
  CASE WHEN b.hostname IS NOT NULL AND (c.seen_at IS NULL OR b.scanned_at >= c.seen_at) THEN 'heartbeat' ELSE 'computed' END AS digest_source
  FROM beats b FULL JOIN calc c ON b.hostname = c.hostname)"""


@query("host_digest", f"WITH {_LATEST}, {_DIGEST} SELECT * FROM digests")
def host_digest(bed: Bed):
    return inventory.host_digest(bed.sql(_BEATS), latest_rows(bed))


_MATCHSTATE = """
SELECT concat('host-', s_suppkey) AS hostname, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey * 1000 AS BIGINT) END AS digest,
  CASE WHEN s_suppkey % 7 = 0 THEN '6' ELSE '7' END AS feed_gen, '2026.08.23.2' AS matcher_version,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(1005000000 - (s_suppkey % 6) * 30000 AS BIGINT) END AS matched_at,
  CAST(s_suppkey AS BIGINT) AS n_components, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(1005000000 - (s_suppkey % 8) * 25000 AS BIGINT) END AS folded_run,
  CAST(1004000000 AS BIGINT) AS folded_at, CAST(s_suppkey % 4 AS BIGINT) AS folded_findings, CAST(NULL AS BIGINT) AS digest_changed_at
FROM b_supplier"""
_DIRTY = f"""matchstate AS ({_MATCHSTATE}), flagged AS (SELECT d.*, m.digest AS prev_digest, m.feed_gen AS prev_gen, m.matched_at AS prev_matched_at,
  (m.digest IS DISTINCT FROM d.digest OR coalesce(m.feed_gen, 'none') <> '7' OR m.hostname IS NULL OR m.matched_at IS NULL
   OR m.matched_at < 1005000000 - 86400 - CAST(concat('0x', substr(md5(d.hostname), 1, 5)) AS BIGINT) % 86400) AS was_dirty
  FROM digests d LEFT JOIN matchstate m ON m.hostname = d.hostname)"""


@query("dirty_hosts", f"WITH {_LATEST}, {_DIGEST}, {_DIRTY} SELECT hostname, digest, n_components, digest_source FROM flagged WHERE was_dirty")
def dirty_hosts(bed: Bed):
    digests = inventory.host_digest(bed.sql(_BEATS), latest_rows(bed))
    return inventory.dirty_hosts(digests, bed.sql(_MATCHSTATE), "7", NOW)


def _other(prefix: str, every: int):
    """The host's name, or for every so many hosts one that older tables do not have."""
    return F.concat(F.when(F.col("user_id") % every == 0, prefix).otherwise("host-"), F.col("user_id"))


@query("carry_forward_state", """
WITH old AS (SELECT concat('host-', user_id) AS hostname, event_type, count(*) AS n, max(@EPOCH(ts)) AS seen_at FROM b_events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL),
new AS (SELECT concat(CASE WHEN user_id % 3 = 0 THEN 'renamed-' ELSE 'host-' END, user_id) AS hostname, event_type, count(*) AS n, max(@EPOCH(ts)) AS seen_at
  FROM b_events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL),
n2 AS (SELECT hostname, event_type, n, max(seen_at) OVER (PARTITION BY hostname) AS seen_at FROM new),
o2 AS (SELECT hostname, event_type, n, max(seen_at) OVER (PARTITION BY hostname) AS seen_at FROM old)
SELECT hostname, event_type, n, seen_at FROM n2
UNION ALL SELECT hostname, event_type, n, seen_at FROM o2 WHERE hostname NOT IN (SELECT hostname FROM n2)
  AND seen_at >= 1706659200 - 17 * 86400""")
def carry_forward_state(bed: Bed):
    rows = bed.heartbeat.withColumn("later", F.col("scanned_at") >= 1705276800)

    def snapshot(df):
        per = df.groupBy("hostname", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("scanned_at").alias("seen_at"))
        return per.drop("seen_at").join(per.groupBy("hostname").agg(F.max("seen_at").alias("seen_at")), "hostname")

    old = snapshot(rows.filter("not later"))
    new = snapshot(rows.filter("later").withColumn("hostname", _other("renamed-", 3)))
    hosts = old.unionByName(new).groupBy("hostname").agg(F.max("seen_at").alias("host_last_scan"))
    return generic.carry_forward(new, old, "seen_at", ["hostname", "event_type"], hosts, EVENTS_NOW, 17)


@query("host_cadence", """
WITH c AS (SELECT DISTINCT user_id, @EPOCH(ts) AS t FROM b_events),
g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS rn FROM c),
l AS (SELECT user_id, max(t) AS last_contact_at, list(gap ORDER BY gap) FILTER (gap IS NOT NULL AND rn <= 10) AS gaps FROM g GROUP BY user_id)
SELECT concat('host-', user_id) AS hostname, last_contact_at, CAST(coalesce(len(gaps), 0) AS INT) AS n_gaps, gaps[CAST(floor((len(gaps) - 1) / 2) AS INT) + 1] AS median_gap,
  gaps[len(gaps)] AS p95_gap, CAST(len(gaps) >= 3 AS INT) AS learned,
  CAST(len(gaps) >= 3 AND 1706659200 - last_contact_at > greatest(2 * gaps[len(gaps)], 93600) AS INT) AS late, 1706659200 - last_contact_at AS contact_age
FROM l""")
def host_cadence(bed: Bed):
    return inventory.cadence_from_contacts(bed.heartbeat, EVENTS_NOW).drop("gaps")


@query("host_cadence_step", """
WITH s AS (SELECT s_suppkey, host_last_scan, host_last_scan - 5000 - s_suppkey AS prev, s_suppkey % 13 AS k FROM t_host),
g AS (SELECT *, list_concat(CASE WHEN k > 10 THEN range(k - 10, k) WHEN k > 0 THEN range(0, k) ELSE [] END, [5000 + s_suppkey]) AS all_gaps FROM s),
h AS (SELECT *, list_sort(all_gaps[greatest(len(all_gaps) - 9, 1):]) AS gaps FROM g)
SELECT concat('host-', s_suppkey) AS hostname, CAST(len(gaps) AS INT) AS n_gaps, CAST(gaps[CAST(floor((len(gaps) - 1) / 2) AS INT) + 1] AS BIGINT) AS median_gap,
  CAST(gaps[len(gaps)] AS BIGINT) AS p95_gap, CAST(len(gaps) >= 3 AS INT) AS learned,
  CAST(len(gaps) >= 3 AND 1005000000 - host_last_scan > greatest(2 * gaps[len(gaps)], 93600) AS INT) AS late FROM h""")
def host_cadence_step(bed: Bed):
    # The stored list holds min(k, 10) earlier gaps.
    k = F.col("s_suppkey") % 13
    past = F.when(k > 0, F.sequence(F.greatest(k - 10, F.lit(0)), k - 1)).otherwise(F.array().cast("array<bigint>"))
    old = bed.host.select("hostname", (F.col("host_last_scan") - 5000 - F.col("s_suppkey")).alias("last_contact_at"), past.alias("gaps"),
                          F.lit(1).cast("bigint").alias("first_seen_at"))
    return inventory.host_cadence(bed.host, old, NOW).select("hostname", "n_gaps", "median_gap", "p95_gap", "learned", "late")


@query("host_state", """
WITH new AS (SELECT concat(CASE WHEN user_id % 4 = 0 THEN 'first-' ELSE 'host-' END, user_id) AS hostname, max(@EPOCH(ts)) AS host_last_scan, arg_max(event_type, (ts, event_type)) AS os
  FROM b_events GROUP BY ALL),
old AS (SELECT concat('host-', user_id) AS hostname, max(@EPOCH(ts)) + 50 * (user_id % 2) AS host_last_scan, 'old' AS os FROM b_events GROUP BY user_id)
SELECT coalesce(n.hostname, o.hostname) AS hostname, greatest(n.host_last_scan, o.host_last_scan) AS host_last_scan,
  CASE WHEN o.hostname IS NULL OR n.host_last_scan >= o.host_last_scan THEN n.os ELSE o.os END AS os FROM new n FULL JOIN old o ON o.hostname = n.hostname""")
def host_state(bed: Bed):
    rows = bed.heartbeat.withColumn("os_id", F.col("event_type"))
    old = rows.groupBy("hostname", "user_id").agg(F.max("scanned_at").alias("t")).select(
        "hostname", (F.col("t") + 50 * (F.col("user_id") % 2)).alias("host_last_scan"), F.lit("old").alias("os"))
    return inventory.host_state(rows.withColumn("hostname", _other("first-", 4)), old).select("hostname", "host_last_scan", "os")


@query("ecosystem_counts", f"""WITH {_LATEST}, c AS (SELECT hostname, type, count(DISTINCT name) AS components, count(*) AS instances, count_if(purl <> '') AS with_identifier
  FROM latest WHERE hostname NOT IN (SELECT hostname FROM t_host WHERE 1005000000 - host_last_scan > 180 * 86400) GROUP BY ALL)
SELECT hostname, type, components, instances, with_identifier, CAST(0 AS BIGINT) AS cpe_ident FROM c
UNION ALL SELECT '__fleet__', type, CAST(sum(components) AS BIGINT), CAST(sum(instances) AS BIGINT), CAST(sum(with_identifier) AS BIGINT), CAST(0 AS BIGINT) FROM c GROUP BY type""")
def ecosystem_counts(bed: Bed):
    rows = latest_rows(bed)
    old = bed.spark.createDataFrame([], "hostname string, type string, components bigint, instances bigint, with_identifier bigint, cpe_ident bigint, assessed_at bigint")
    return inventory.ecosystem_counts(rows, old, bed.host, NOW).drop("assessed_at")


@query("package_vendors", f"WITH {_LATEST} SELECT name AS package, min(vendor) AS vendor FROM latest WHERE vendor IS NOT NULL AND vendor <> '' GROUP BY name")
def package_vendors(bed: Bed):
    return inventory.vendors(latest_rows(bed))


@query("feed_summary", "SELECT ecosystem, count(DISTINCT package) AS feed_packages, count(*) AS feed_ranges FROM t_range GROUP BY ecosystem")
def feed_summary_query(bed: Bed):
    return backfill_summary(bed.spark.createDataFrame([], "ecosystem string, feed_packages bigint, feed_ranges bigint"), bed.range)


@query("feed_manifest", """
SELECT 'advisories' AS member, count(*) AS rows, CAST(NULL AS VARCHAR) AS warning FROM t_advisory UNION ALL
SELECT 'ranges', count(*), NULL FROM t_range UNION ALL SELECT 'notaffected', count(*), NULL FROM t_notaffected UNION ALL
SELECT 'mitigations', count(*), 'no rows in mitigations' FROM t_range WHERE ecosystem = 'none'""")
def feed_manifest_query(bed: Bed):
    return feed_manifest({"advisories": bed.advisory, "ranges": bed.range, "notaffected": bed.notaffected,
                          "mitigations": bed.range.filter("ecosystem = 'none'")})


@query("coverage_status", """
WITH f AS (SELECT type, count(*) AS components, count_if(l_returnflag = 'N') AS cpe_ident FROM t_component GROUP BY type),
e AS (SELECT CASE WHEN ecosystem = 'windows' THEN 'cpe' WHEN ecosystem IN ('binary', 'npm', 'go-module') THEN 'other' ELSE ecosystem END AS type,
  count(DISTINCT package) AS p, count(*) AS r FROM t_range GROUP BY 1)
SELECT f.type, f.components, format('{:,}', coalesce(e.p, 0)) AS feed_packages,
  CASE WHEN coalesce(e.r, 0) > 0 THEN format('{:,}', e.r) WHEN f.cpe_ident > 0 AND f.type <> 'npm' THEN concat(format('{:,}', (SELECT r FROM e WHERE type = 'cpe')), ' CPE ranges') ELSE '0' END AS reach,
  CASE WHEN coalesce(e.r, 0) > 0 THEN 'covered' WHEN f.cpe_ident > 0 AND f.type <> 'npm' THEN 'covered through CPE' WHEN f.type = 'binary' THEN 'no feed exists for this type'
    ELSE 'add this ecosystem to the bundle' END AS status
FROM f LEFT JOIN e ON e.type = f.type""")
def coverage_status(bed: Bed):
    fleet = bed.component.groupBy("type").agg(F.count(F.lit(1)).alias("instances"), F.count_if((F.col("l_returnflag") == "N") & (F.col("type") != "npm")).alias("cpe_ident"))
    eco = F.when(F.col("ecosystem") == "windows", "cpe").when(F.col("ecosystem").isin("binary", "npm", "go-module"), "other").otherwise(F.col("ecosystem"))
    return inventory.coverage(fleet, feed_summary(bed.range.withColumn("ecosystem", eco)))


_BEAT_JSON = """
SELECT concat('host-', o_custkey) AS hostname, @EPOCH(o_orderdate) AS scanned_at, o_orderkey,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('v0.', o_custkey % 11, '.', o_orderkey % 10) END AS collector_version,
  CAST(o_custkey * 10 AS BIGINT) AS n_components, o_orderkey % 3 AS k FROM b_orders"""


def _beats(bed: Bed):
    rows = bed.sql(_BEAT_JSON)
    text = F.concat(F.lit('{"a":{"status":"ok"},"b":{"status":"'), F.when(F.col("k") == 0, "failed").when(F.col("k") == 1, "skipped").otherwise("ok"),
                    F.lit('","reason":"r'), F.col("o_orderkey").cast("string"), F.lit('"}'), F.when(F.col("k") == 2, ',"c":{"status":"failed"}').otherwise(""), F.lit("}"))
    counts = F.concat(F.lit('{"component":'), F.when(F.col("k") == 1, "null").otherwise((F.col("o_orderkey") % 50).cast("string")), F.lit(',"link":7}'))
    return rows.withColumns({
        "sources": F.from_json(text, "map<string,struct<status:string,reason:string>>"),
        "counts": F.from_json(counts, "struct<component:bigint,exposure:bigint,link:bigint,container:bigint>"),
        "scan_profile": F.when(F.col("k") == 0, F.struct(F.lit("yes").alias("full_scan"), F.lit("all").alias("elf_scope"), F.lit("").alias("config_scope")))})


_MANIFEST = f"""beats AS ({_BEAT_JSON}),
newest AS (SELECT * FROM beats WHERE {GONE} QUALIFY scanned_at = max(scanned_at) OVER (PARTITION BY hostname) AND row_number() OVER (PARTITION BY hostname, scanned_at ORDER BY o_orderkey DESC) = 1),
arrived AS (SELECT hostname, n FROM (SELECT concat('host-', o_custkey) AS hostname, count(*) AS n, @EPOCH(o_orderdate) AS seen_at FROM b_orders GROUP BY o_custkey, o_orderdate)
  QUALIFY seen_at = max(seen_at) OVER (PARTITION BY hostname)),
manifest AS (SELECT w.hostname, w.scanned_at, w.collector_version, CASE WHEN k = 1 THEN n_components ELSE o_orderkey % 50 END AS said_component, CAST(7 AS BIGINT) AS said_link, a.n AS arrived_components,
  CASE k WHEN 2 THEN 2 ELSE 1 END AS sources_ok, CASE k WHEN 1 THEN 1 ELSE 0 END AS sources_skipped, CASE k WHEN 1 THEN 0 ELSE 1 END AS sources_failed,
  CASE k WHEN 0 THEN concat('b: r', o_orderkey) WHEN 2 THEN 'c: no reason given' ELSE '' END AS failed_text, CASE k WHEN 2 THEN 'a,b,c' ELSE 'a,b' END AS sources_text,
  CASE WHEN k <> 2 THEN 1 ELSE 0 END AS sources_shrank, CASE k WHEN 0 THEN 1 ELSE 0 END AS has_profile
  FROM newest w LEFT JOIN arrived a ON a.hostname = w.hostname)"""


def _manifest(bed: Bed):
    # Ties in time are settled by the larger order key before the snapshot.
    beats = generic.first_per_key(_beats(bed), ["hostname", "scanned_at"], F.col("o_orderkey").desc())
    comps = bed.sql("SELECT concat('host-', o_custkey) AS hostname, @EPOCH(o_orderdate) AS scanned_at FROM b_orders")
    old = beats.select("hostname").distinct().withColumns({"scanned_at": F.lit(0).cast("bigint"), "sources_text": F.lit("a,b,c"), "n_sources": F.lit(3)})
    return inventory.scan_manifest(beats, comps, old, bed.host, NOW)


@query("scan_manifest", f"WITH {_MANIFEST} SELECT * EXCLUDE (collector_version) FROM manifest")
def scan_manifest(bed: Bed):
    return _manifest(bed).select("hostname", "scanned_at", "said_component", "said_link", "arrived_components", "sources_ok", "sources_skipped", "sources_failed",
                                 "failed_text", "sources_text", "sources_shrank", "has_profile")


@query("arrival_check", f"""WITH {_MANIFEST}
SELECT hostname, CASE WHEN arrived_components IS NULL THEN 'last scan is older than the check window' WHEN sources_failed > 0 THEN 'a source failed on the host'
    WHEN said_component > arrived_components THEN 'components went missing on the way in' ELSE 'everything arrived' END AS verdict,
  CASE WHEN collector_version IS NULL THEN 'not reported' WHEN n < 701 THEN concat(collector_version, ' (below the 0.7.1 floor)') WHEN n < 800 THEN concat(collector_version, ' (no configuration surface)')
    WHEN n < 900 THEN concat(collector_version, ' (no Windows library loads or Windows autoruns)') WHEN n < 902 THEN concat(collector_version, ' (no Windows build number)') ELSE collector_version END AS collector,
  round(100.0 * arrived_components / nullif(said_component, 0), 1) AS arrived_pct, CAST(coalesce(l, 0) AS BIGINT) AS links_arrived
FROM (SELECT *, CAST(split_part(collector_version, '.', 2) AS INT) * 100 + CAST(split_part(collector_version, '.', 3) AS INT) AS n FROM manifest) m
LEFT JOIN (SELECT hostname AS h, s_suppkey AS l FROM t_host) x ON x.h = m.hostname
UNION ALL SELECT hostname, 'collector does not report a manifest', 'not reported', NULL, s_suppkey FROM t_host WHERE hostname NOT IN (SELECT hostname FROM manifest)""")
def arrival_check(bed: Bed):
    links = bed.host.select("hostname", F.col("s_suppkey").alias("link_rows"))
    return inventory.arrival_check(_manifest(bed), links).select(
        "hostname", "verdict", "collector", "arrived_pct", "links_arrived")


_HOTFIX = """
SELECT concat('host-', l_suppkey) AS hostname, CASE WHEN l_linenumber = 1 THEN 'cumulative' ELSE 'other' END AS servicing_stream,
  concat(19000 + l_suppkey % 3, '.', 100 + l_suppkey * 3 % 500) AS version, concat('KB', l_partkey % 30) AS kb,
  CASE WHEN l_suppkey % 4 = 0 THEN '2022' ELSE '11' END AS os_version_id, CAST(1000 AS BIGINT) AS scanned_at FROM b_lineitem"""
_WINPATCH = """
SELECT concat('KB', p_partkey) AS kb, concat(19000 + p_partkey % 2) AS branch, CASE WHEN p_size % 2 = 0 THEN 'client' ELSE 'server' END AS edition,
  CAST(floor(p_retailprice) AS BIGINT) % 700 AS ubr, concat('10.0.', 19000 + p_partkey % 2, '.', CAST(floor(p_retailprice) AS BIGINT) % 700) AS fixed_build,
  concat('d', p_size) AS released, concat('Windows ', p_size) AS product FROM b_part"""


@query("windows_patch_level", f"""
WITH hf AS ({_HOTFIX}), wp AS ({_WINPATCH}),
h AS (SELECT hostname, min(version) FILTER (servicing_stream = 'cumulative') AS cum, string_agg(DISTINCT kb, ', ' ORDER BY kb) AS kbs, count(DISTINCT kb) AS n_installed_kbs, min(os_version_id) AS osv FROM hf WHERE {GONE} GROUP BY hostname),
b AS (SELECT *, split_part(cum, '.', 1) AS branch, CAST(split_part(cum, '.', 2) AS BIGINT) AS ubr, CASE WHEN osv = '2022' THEN 'server' ELSE 'client' END AS edition FROM h WHERE cum IS NOT NULL),
t AS (SELECT branch, edition, max(ubr) AS latest_ubr, string_agg(DISTINCT kb, ', ' ORDER BY kb) AS latest_kb, min(fixed_build) AS latest_build FROM (SELECT * FROM wp QUALIFY ubr = max(ubr) OVER (PARTITION BY branch, edition)) GROUP BY branch, edition)
SELECT b.hostname, b.branch, b.edition, b.ubr, concat('10.0.', b.branch, '.', b.ubr) AS current_build, t.latest_ubr, t.latest_kb, t.latest_build, t.latest_ubr - b.ubr AS behind_ubr, b.kbs AS installed_kbs, b.n_installed_kbs,
  CASE WHEN t.latest_ubr IS NULL THEN 'no update data for this build in the feed' WHEN t.latest_ubr <= b.ubr THEN 'current with the feed' ELSE 'behind the feed' END AS status
FROM b LEFT JOIN t ON t.branch = b.branch AND t.edition = b.edition""")
def windows_patch_level(bed: Bed):
    scan = bed.spark.createDataFrame([], "hostname string, os_build string, os_display_version string, os_installation_type string")
    old = bed.spark.createDataFrame([], "hostname string, rolled_at bigint")
    out = inventory.windows_patch_level(bed.sql(_HOTFIX), scan, bed.sql(_WINPATCH), old, bed.host, NOW)
    return out.select("hostname", "branch", "edition", "ubr", "current_build", "latest_ubr", "latest_kb", "latest_build", "behind_ubr", "installed_kbs", "n_installed_kbs", "status")


@query("config_surface", f"""
WITH new AS (SELECT concat('host-', l_suppkey) AS hostname, l_returnflag AS kind, concat('/c/', l_partkey % 100) AS path_key FROM b_lineitem WHERE l_linestatus = 'O'),
old AS (SELECT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'host-' ELSE 'old-' END, l_suppkey) AS hostname, l_returnflag AS kind, concat('/c/', l_partkey % 100) AS path_key FROM b_lineitem WHERE l_linestatus = 'F'),
every AS (SELECT * FROM new UNION SELECT * FROM old WHERE hostname NOT IN (SELECT hostname FROM new))
SELECT DISTINCT hostname, kind, path_key FROM every WHERE {GONE}""")
def config_surface(bed: Bed):
    rows = bed.b_lineitem.select(F.concat(F.lit("host-"), "l_suppkey").alias("hostname"), F.col("l_returnflag").alias("kind"), F.lit(None).cast("string").alias("name"),
                                 F.concat(F.lit("/c/"), F.col("l_partkey") % 100).alias("path"), F.lit(None).cast("string").alias("executable"), F.lit(5).alias("scanned_at"), "l_linestatus", "l_suppkey")
    old = rows.filter("l_linestatus = 'F'").withColumns({"path_key": F.col("path"), "name": F.lit(""), "hostname": F.concat(
        F.when(F.col("l_suppkey") % 2 == 0, "host-").otherwise("old-"), "l_suppkey")})
    out = inventory.config_surface(rows.filter("l_linestatus = 'O'"), old, bed.host, NOW)
    return out.select("hostname", "kind", "path_key")


@query("inventory_state", """
WITH comps AS (SELECT concat(CASE WHEN l_suppkey % 5 = 0 THEN 'renamed-' ELSE 'host-' END, l_suppkey) AS hostname, concat('pkg', l_partkey) AS package, concat('/usr/lib/pkg', l_partkey) AS path, concat('2.', CAST(l_quantity AS INT)) AS version,
    concat('src', l_partkey % 3) AS source, CAST(1004000000 + (l_linenumber % 2) * 100000 AS BIGINT) AS seen_at FROM b_lineitem WHERE l_linestatus = 'O'),
last AS (SELECT *, max(seen_at) OVER (PARTITION BY hostname) AS lastat FROM comps),
ran AS (SELECT DISTINCT hostname, source FROM last WHERE seen_at >= lastat - 300),
fresh AS (SELECT hostname, package, path, arg_max(version, (seen_at, version)) AS current_version, max(seen_at) AS inv_time FROM comps GROUP BY ALL),
kept AS (SELECT f.*, 1 AS cat_ran FROM fresh f WHERE EXISTS (SELECT 1 FROM t_finding x WHERE x.hostname = f.hostname AND x.package = f.package AND x.path = f.path)),
old AS (SELECT hostname, package, path, last_version AS current_version, t_finding.last_seen AS inv_time, concat('src', l_partkey % 3) AS source FROM t_finding JOIN t_finding_parts p ON finding_key = concat(p.l_suppkey, '-', p.l_partkey)),
gone AS (SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.hostname = o.hostname AND k.package = o.package AND k.path = o.path)),
held AS (SELECT g.hostname, g.package, g.path, g.current_version, g.inv_time,
  CASE WHEN g.hostname NOT IN (SELECT hostname FROM kept) OR EXISTS (SELECT 1 FROM ran r WHERE r.hostname = g.hostname AND r.source = g.source) THEN 1 ELSE 0 END AS cat_ran FROM gone g)
SELECT hostname, package, path, current_version, inv_time, cat_ran FROM (SELECT * FROM kept UNION ALL SELECT * FROM held WHERE cat_ran = 0 OR hostname NOT IN (SELECT hostname FROM kept)) z
WHERE hostname NOT IN (SELECT hostname FROM t_host WHERE 1005000000 - host_last_scan > 180 * 86400)""")
def inventory_state(bed: Bed):
    comps = bed.b_lineitem.filter("l_linestatus = 'O'").select(
        F.concat(F.when(F.col("l_suppkey") % 5 == 0, "renamed-").otherwise("host-"), "l_suppkey").alias("hostname"), F.concat(F.lit("pkg"), "l_partkey").alias("name"),
        F.concat(F.lit("/usr/lib/pkg"), "l_partkey").alias("path"), F.concat(F.lit("2."), F.col("l_quantity").cast("int")).alias("version"),
        F.concat(F.lit("src"), F.col("l_partkey") % 3).alias("source_key"), (1004000000 + (F.col("l_linenumber") % 2) * 100000).cast("bigint").alias("scanned_at"))
    parts = bed.finding_parts.select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("finding_key"), F.concat(F.lit("src"), F.col("l_partkey") % 3).alias("source"))
    old = bed.finding.join(parts, "finding_key").select("hostname", "package", "path", F.col("last_version").alias("current_version"), F.col("last_seen").alias("inv_time"),
                                                        "source", F.lit(None).cast("string").alias("found_by"))
    return inventory.inventory_state(bed.finding, comps, old, bed.host, NOW).select("hostname", "package", "path", "current_version", "inv_time", "cat_ran")


@query("feed_age", """SELECT CAST(o_custkey AS BIGINT) AS bundle, round((1005000000 - max(@EPOCH(o_orderdate))) / 86400.0, 1) AS age_days FROM b_orders GROUP BY o_custkey
HAVING round((1005000000 - max(@EPOCH(o_orderdate))) / 86400.0, 1) > 30""")
def feed_age(bed: Bed):
    rows = bed.sql("SELECT o_custkey AS bundle, max(@EPOCH(o_orderdate)) AS imported_at FROM b_orders GROUP BY o_custkey")
    return inventory.feed_age(rows, NOW, Params().feed_stale_days).select("bundle", "age_days")


@query("hosts_reporting", "SELECT count(DISTINCT hostname) AS hosts FROM t_host WHERE host_last_scan >= 1005000000 - 7 * 86400")
def hosts_reporting(bed: Bed):
    return inventory.hosts_reporting(bed.host, NOW)


@query("keyed_delete", """
WITH req AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat(o_custkey % 10, '-', o_orderkey % 5000) END AS finding_key FROM b_orders)
SELECT count(*) AS requested, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM t_finding f WHERE f.finding_key = req.finding_key) THEN finding_key END) AS deleted, count_if(finding_key = '') AS skipped FROM req""")
def keyed_delete(bed: Bed):
    key = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat_ws("-", F.col("o_custkey") % 10, F.col("o_orderkey") % 5000))
    store = scratch_store(bed.spark, "keyed-delete")
    store.upsert_state(bed.finding.select("finding_key", "status"), "findings", ["finding_key"])
    return store.delete_state(bed.b_orders.select(key.alias("finding_key")), "findings", "finding_key")


@query("state_after_delete", """
WITH req AS (SELECT concat(o_custkey % 10, '-', o_orderkey % 5000) AS finding_key FROM b_orders WHERE o_orderkey % 10 <> 0)
SELECT finding_key, status FROM t_finding WHERE finding_key NOT IN (SELECT finding_key FROM req)""")
def state_after_delete(bed: Bed):
    key = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat_ws("-", F.col("o_custkey") % 10, F.col("o_orderkey") % 5000))
    store = scratch_store(bed.spark, "keyed-delete")
    store.upsert_state(bed.finding.select("finding_key", "status"), "findings", ["finding_key"])
    store.delete_state(bed.b_orders.select(key.alias("finding_key")), "findings", "finding_key")
    return store.read_state("findings")


@query("state_upsert", """
SELECT finding_key, status, NULL AS title FROM t_finding WHERE accepted = '1' UNION ALL SELECT finding_key, status, title FROM t_finding WHERE accepted <> '1'""")
def state_upsert(bed: Bed):
    # A whole-row replace: the title the new rows do not carry is lost.
    store = scratch_store(bed.spark, "state-upsert")
    store.upsert_state(bed.finding.select("finding_key", "status", "title"), "findings", ["finding_key"])
    store.upsert_state(bed.finding.filter("accepted = '1'").select("finding_key", "status"), "findings", ["finding_key"])
    return store.read_state("findings")
