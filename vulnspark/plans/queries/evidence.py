"""Local evidence and network evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.functions import address as addr
from vulnspark.functions.cvss import cvss_english, cvss_reach
from vulnspark.operators import evidence, network
from vulnspark.operators.generic import values
from vulnspark.params import Params
from vulnspark.plans.queries.registry import GONE, query
from vulnspark.plans.testbed import NOW, Bed
from vulnspark.sources import flows
from vulnspark.sources.state import written

_REACH = """reach AS (SELECT hostname, rk_key, max(rnk) AS reach_rank, count(DISTINCT ep) AS listeners, string_agg(DISTINCT ep, ', ' ORDER BY ep) AS ports_text,
  string_agg(DISTINCT li, ', ' ORDER BY li) AS listener_text, string_agg(DISTINCT co, ', ' ORDER BY co) AS container_text, string_agg(DISTINCT concat(ep, '|', li, '|', co), ';' ORDER BY concat(ep, '|', li, '|', co)) AS chain_text,
  CASE max(rnk) WHEN 3 THEN 'answers any address' WHEN 2 THEN 'answers one address' ELSE 'loopback only' END AS reach_class
  FROM (SELECT *, CASE WHEN container_id <> '' THEN concat('container:', substr(container_id, 1, 12)) ELSE package END AS rk_key, CASE bind_scope WHEN 'wildcard' THEN 3 WHEN 'specific' THEN 2 ELSE 1 END AS rnk,
    concat(address, ':', port, '/', protocol) AS ep, coalesce(unit, regexp_extract(executable, '[^/]*$')) AS li, replace(container_name, '|', '_') AS co FROM t_exposure) e WHERE rk_key IS NOT NULL GROUP BY hostname, rk_key)"""


@query("reach_rollup", f"WITH {_REACH} SELECT hostname, rk_key, reach_rank, listeners, ports_text, listener_text, container_text, chain_text, reach_class FROM reach")
def reach_rollup(bed: Bed):
    return evidence.reach(bed.exposure, NOW).select("hostname", "rk_key", "reach_rank", "listeners", "ports_text", "listener_text", "container_text", "chain_text", "reach_class")


@query("exposure_coverage", """SELECT hostname, count(DISTINCT ep) AS listeners, count(DISTINCT ep) FILTER (bind_scope = 'wildcard') AS wildcard_listeners,
  count(DISTINCT ep) FILTER (package IS NULL AND held_by_os <> 1) AS unattributed_listeners, count(DISTINCT ep) FILTER (package IS NULL AND held_by_os = 1) AS os_listeners,
  count(DISTINCT package) AS packages_behind_ports, count(DISTINCT container_name) AS containers, max(scanned_at) AS assessed_at
FROM (SELECT *, concat(address, ':', port, '/', protocol) AS ep FROM t_exposure) GROUP BY hostname""")
def exposure_coverage(bed: Bed):
    return evidence.exposure_coverage(bed.exposure)


@query("listening_ports", f"""
WITH e AS (SELECT hostname, port, protocol, coalesce(package, 'unattributed') AS package_key, scanned_at FROM t_exposure
  UNION ALL SELECT CASE WHEN port % 2 = 0 THEN concat('old-', hostname) ELSE hostname END, port, protocol, 'old', scanned_at - 50000000 FROM t_exposure)
SELECT DISTINCT hostname, port, protocol, package_key, scanned_at FROM e WHERE {GONE} QUALIFY scanned_at = max(scanned_at) OVER (PARTITION BY hostname)""")
def listening_ports(bed: Bed):
    # The purl form: the name is what the operator has to recover.
    purl = F.when(F.col("package").isNotNull(), F.concat(F.lit("pkg:deb/ubuntu/"), "package", F.lit("@1.0?arch=amd64"))).otherwise("null")
    rows = bed.exposure.withColumns({"purl": purl, "os_component": F.col("held_by_os").cast("string")}).drop("package", "held_by_os")
    # The earlier snapshot has every port: of hosts that reported since, and of others that fell silent.
    old = bed.exposure.withColumns({"hostname": F.when(F.col("port") % 2 == 0, F.concat(F.lit("old-"), "hostname")).otherwise(F.col("hostname")),
                                    "scanned_at": F.col("scanned_at") - 50000000, "package": F.lit("old"), "package_key": F.lit("old")})
    return evidence.listening_ports(rows, old, bed.host, NOW).select("hostname", "port", "protocol", "package_key", "scanned_at")


_BOXES = """
SELECT concat('host-', l_suppkey) AS hostname, concat('c', l_suppkey) AS container_id, CASE l_partkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'exited' ELSE 'null' END AS state,
  concat('img', l_partkey % 9) AS image_ref, l_partkey, @EPOCH(l_shipdate) AS scanned_at, l_linenumber FROM b_lineitem"""


# The snapshot before: a container that its host has replaced, and one of a host that has not reported since.
_OLD_BOXES = """
SELECT concat('host-', s_suppkey) AS hostname, concat('before', s_suppkey) AS container_id, 'before' AS container_short, 'c' AS container_name, 'docker' AS runtime, 'running' AS state, 'old' AS image_ref,
  '' AS image_digest, 'debian' AS os_id, '11' AS os_version_id, 'e' AS endpoints_text, 'd' AS declared_text, 3 AS n_endpoints, 2 AS n_public_endpoints, CAST(5 AS BIGINT) AS scanned_at FROM b_supplier
UNION ALL SELECT concat('quiet-', s_suppkey), concat('kept', s_suppkey), 'kept', 'c', 'docker', 'running', concat('old', s_suppkey % 4), '', 'debian', '11', 'e', 'd', 3, 2, CAST(5 AS BIGINT) FROM b_supplier"""


def _boxes(bed: Bed):
    rows = bed.sql(_BOXES)
    ends = F.when(F.col("l_partkey") % 4 == 0, F.array().cast("array<string>")).when(
        F.col("l_partkey") % 4 == 1, F.array(F.lit("127.0.0.1:80"))).otherwise(F.array(F.lit("0.0.0.0:443"), F.lit("[::1]:1")))
    one = rows.groupBy("hostname", "container_id").agg(F.max(F.struct("scanned_at", "l_partkey", "state", "image_ref")).alias("m")).select("hostname", "container_id", "m.*")
    one = one.withColumns({"container_name": F.lit("null"), "runtime": F.lit("docker"), "image_digest": F.lit(""), "os_id": F.lit("debian"), "os_version_id": F.lit("12"), "endpoints": ends, "declared_endpoints": F.array(F.lit("80"))})
    return evidence.containers(one.drop("l_partkey"), bed.sql(_OLD_BOXES), bed.host, NOW)


_BOX_SQL = f"""boxes AS (SELECT hostname, container_id, nullif(state, 'null') AS state, image_ref, l_partkey % 4 AS k FROM ({_BOXES}) WHERE {GONE} QUALIFY row_number() OVER (PARTITION BY hostname, container_id ORDER BY scanned_at DESC, l_partkey DESC) = 1)"""


@query("container_snapshot", f"WITH {_BOX_SQL} SELECT hostname, container_id, state, image_ref, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_endpoints, CASE WHEN k >= 2 THEN 1 ELSE 0 END AS n_public_endpoints FROM boxes UNION ALL SELECT hostname, container_id, state, image_ref, n_endpoints, n_public_endpoints FROM ({_OLD_BOXES}) WHERE hostname LIKE 'quiet%' OR hostname NOT IN (SELECT hostname FROM boxes) AND {GONE} AND hostname NOT IN (SELECT concat('host-', l_suppkey) FROM b_lineitem)")
def container_snapshot(bed: Bed):
    return _boxes(bed).select("hostname", "container_id", "state", "image_ref", "n_endpoints", "n_public_endpoints")


@query("container_findings", f"""WITH {_BOX_SQL} SELECT f.finding_key, CASE WHEN b.state <> 'running' AND k > 0 THEN 'declares a port' WHEN b.state <> 'running' THEN 'no declared port' WHEN k >= 2 THEN 'publishes a port' WHEN k = 1 THEN 'loopback only' ELSE 'no published port' END AS published,
  CASE WHEN b.state <> 'running' THEN '4. stopped, still vulnerable' WHEN k >= 2 THEN '1. running and published' WHEN k = 1 THEN '2. running, loopback only' ELSE '3. running, not published' END AS ctr_tier, coalesce(b.image_ref, 'unknown image') AS image_label
FROM t_finding f LEFT JOIN boxes b ON b.hostname = f.hostname AND b.container_id = replace(f.scope_id, 'container:', '') WHERE f.status = 'open' AND f.accepted <> '1' AND f.scope = 'container'""")
def container_findings(bed: Bed):
    found = bed.finding.filter("status = 'open' and accepted <> '1'")
    return evidence.container_findings(found, _boxes(bed)).select("finding_key", "published", "ctr_tier", "image_label")


_LINKS = """
SELECT concat('host-', l_suppkey) AS hostname, CASE WHEN l_partkey % 6 = 0 THEN 'null' ELSE concat('pkg:deb/debian/pkg', l_partkey, '@1') END AS purl, concat('/bin/tool', l_partkey % 9) AS executable,
  CASE WHEN l_partkey % 3 = 0 THEN concat('pkg:deb/debian/own', l_partkey % 5, '@2') ELSE '' END AS executable_purl, concat('/lib/l', l_partkey % 50) AS path, 'so' AS soname, '' AS container_id, '/' AS root,
  CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END AS listening, CASE WHEN l_partkey % 12 = 0 THEN 'true' ELSE 'false' END AS os_component, CAST(77 AS BIGINT) AS scanned_at, l_partkey FROM b_lineitem"""
_LOADED = f"""links AS (SELECT * FROM ({_LINKS}) WHERE {GONE}), lk AS (SELECT hostname, concat('pkg', l_partkey) AS package, listening = 'true' AS lis, CASE WHEN l_partkey % 3 = 0 THEN concat('own', l_partkey % 5) ELSE concat('tool', l_partkey % 9) END AS loader FROM links WHERE purl <> 'null'),
loaded AS (SELECT hostname, package, CASE WHEN bool_or(lis) THEN 3 ELSE 2 END AS load_rank, CASE WHEN bool_or(lis) THEN 'a listener loads it' ELSE 'loaded, not listening' END AS load_class, count(DISTINCT loader) AS loader_count, min(loader) AS loaders FROM lk GROUP BY ALL)"""


def _loaded(bed: Bed):
    old = bed.spark.createDataFrame([], "hostname string, scope_key string, package string, load_class string, load_rank int, loaders string, loader_count bigint, loaded_listening int, scanned_at bigint")
    return evidence.loaded_libraries(bed.sql(_LINKS), old, bed.host, NOW)


def _links(bed: Bed):
    old = bed.spark.createDataFrame([], "hostname string, link_rows bigint, linked_packages bigint, listening_loaders bigint, unowned_libraries bigint, assessed_at bigint")
    return evidence.link_coverage(bed.sql(_LINKS), old, bed.host, NOW)


@query("loaded_libraries", f"WITH {_LOADED} SELECT hostname, package, load_rank, load_class, loader_count, loaders FROM loaded")
def loaded_libraries(bed: Bed):
    return _loaded(bed).select("hostname", "package", "load_rank", "load_class", "loader_count", "loaders")


@query("link_coverage", f"""WITH l AS (SELECT * FROM ({_LINKS}) WHERE {GONE}) SELECT hostname, count(*) AS link_rows, count(DISTINCT CASE WHEN purl <> 'null' THEN l_partkey END) AS linked_packages, count(DISTINCT executable) FILTER (listening = 'true') AS listening_loaders,
  count(DISTINCT path) FILTER (purl = 'null' AND os_component <> 'true') AS unowned_libraries FROM l GROUP BY hostname""")
def link_coverage(bed: Bed):
    return _links(bed).drop("assessed_at")


@query("load_evidence", f"""WITH {_LOADED}, hosts AS (SELECT DISTINCT hostname FROM links)
SELECT f.finding_key, CASE WHEN l.load_class IS NOT NULL THEN l.load_class WHEN f.ecosystem NOT IN ('deb', 'rpm', 'apk', 'binary', 'windows') THEN 'not a linked library' WHEN h.hostname IS NULL THEN 'not assessed' ELSE 'not in the load list' END AS load_class,
  CASE WHEN l.load_rank IS NOT NULL THEN l.load_rank WHEN f.ecosystem IN ('deb', 'rpm', 'apk', 'binary', 'windows') AND h.hostname IS NOT NULL THEN 1 ELSE 0 END AS load_rank
FROM t_finding f LEFT JOIN loaded l ON l.hostname = f.hostname AND l.package = f.package AND f.scope_id = '' LEFT JOIN hosts h ON h.hostname = f.hostname""")
def load_evidence(bed: Bed):
    return evidence.with_load_evidence(bed.finding, _loaded(bed), _links(bed)).select("finding_key", "load_class", "load_rank")


_KEY = "CASE WHEN f.scope_id LIKE 'container:%' THEN concat('container:', substr(f.scope_id, 11, 12)) ELSE f.package END"
_TRIAGE = f"""{_REACH}, seen AS (SELECT DISTINCT hostname FROM t_exposure),
tr AS (SELECT f.*, coalesce(r.reach_class, CASE WHEN s.hostname IS NULL THEN 'not assessed' ELSE 'no listening port' END) AS reach_class, r.chain_text, f.kev_added <> '' AS kev
  FROM t_finding f LEFT JOIN reach r ON r.hostname = f.hostname AND r.rk_key = {_KEY} LEFT JOIN seen s ON s.hostname = f.hostname WHERE f.status = 'open' AND f.accepted <> '1'),
tr2 AS (SELECT *, CASE reach_class WHEN 'answers any address' THEN 3 WHEN 'answers one address' THEN 2 WHEN 'loopback only' THEN 1 WHEN 'no listening port' THEN 0 ELSE -1 END AS rr,
  CASE WHEN kev THEN 5 WHEN epss >= 0.5 THEN 4 WHEN epss >= 0.1 THEN 3 WHEN epss >= 0.01 THEN 2 WHEN epss IS NOT NULL THEN 1 ELSE 0 END AS er FROM tr)"""


def triaged(bed: Bed):
    found = bed.finding.filter("status = 'open' and accepted <> '1'")
    cover = evidence.exposure_coverage(bed.exposure)
    return evidence.triage(found, evidence.reach(bed.exposure, NOW), cover)


@query("reach_tier", f"""WITH {_TRIAGE} SELECT finding_key, reach_class, rr AS reach_rank, er AS exploit_rank, CASE WHEN rr = -1 THEN 'unknown-risk' WHEN rr >= 2 AND (er >= 3 OR er = 0) THEN 'act-now' WHEN rr >= 2 THEN 'act-soon'
  WHEN rr = 1 AND er >= 4 THEN 'act-soon' WHEN er >= 4 THEN 'plan' ELSE 'watch' END AS tier FROM tr2""")
def reach_tier(bed: Bed):
    return triaged(bed).select("finding_key", "reach_class", "reach_rank", "exploit_rank", "tier")


@query("exposure_chain", f"""WITH {_TRIAGE}, h AS (SELECT cve_id, package, kev, string_split(unnest(string_split(chain_text, ';')), '|') AS p FROM tr2 WHERE rr >= 1 AND chain_text <> ''),
e AS (SELECT p[1] AS source, 'edge' AS source_kind, p[2] AS target, 'listener' AS target_kind FROM h UNION ALL
SELECT p[2], 'listener', CASE WHEN p[3] = '' THEN package ELSE p[3] END, CASE WHEN p[3] = '' THEN 'package' ELSE 'container' END FROM h UNION ALL
SELECT p[3], 'container', package, 'package' FROM h WHERE p[3] <> '' UNION ALL SELECT package, 'package', cve_id, CASE WHEN kev THEN 'cve-kev' ELSE 'cve' END FROM h)
SELECT source, source_kind, target, target_kind, count(*) AS n FROM e GROUP BY ALL""")
def exposure_chain(bed: Bed):
    return evidence.exposure_chain(triaged(bed)).groupBy("source", "source_kind", "target", "target_kind").agg(F.count(F.lit(1)).alias("n"))


_LIFE = """
SELECT DISTINCT concat('pkg|', p_size) AS k, 'pkg' AS product, concat(p_size) AS cycle, CASE WHEN p_size % 3 = 0 THEN '2001-01-01' WHEN p_size % 3 = 1 THEN '2003-01-01' ELSE '' END AS eol_from, '' AS eoes_from,
  concat('Product ', p_size) AS label, 'lib' AS category FROM b_part UNION ALL
SELECT DISTINCT concat('pkg|', p_size % 9, '.', p_size % 5), 'pkg', concat(p_size % 9, '.', p_size % 5), '2000-06-01', '', concat('Minor ', p_size % 9), 'lib' FROM b_part UNION ALL
SELECT 'ubuntu|22.04', 'ubuntu', '22.04', '2027-04-01', '', 'Ubuntu', 'os' FROM b_region WHERE r_regionkey = 0 UNION ALL SELECT 'alpine|3.19.1', 'alpine', '3.19.1', '2001-02-01', '', 'Alpine', 'os' FROM b_region WHERE r_regionkey = 0"""
_SUPPORT = f"""life AS ({_LIFE}), c AS (SELECT hostname, name, type, os_id, os_version_id, path, l_returnflag, concat(maj, '.', mnr) AS k2, concat(maj) AS k1 FROM t_component),
m AS (SELECT c.*, coalesce(a.cycle, b.cycle) AS cycle, CASE WHEN a.cycle IS NOT NULL THEN a.eol_from ELSE b.eol_from END AS eol_from, coalesce(a.label, b.label) AS label, o.eol_from AS os_eol,
  CASE WHEN EXISTS (SELECT 1 FROM t_exposure e WHERE e.hostname = c.hostname AND e.package = c.name AND e.bind_scope <> 'loopback') THEN 1 WHEN EXISTS (SELECT 1 FROM t_exposure e WHERE e.hostname = c.hostname AND e.package = c.name) THEN 2 ELSE 5 END AS rung
  FROM c LEFT JOIN life a ON a.k = concat('pkg|', k2) LEFT JOIN life b ON b.k = concat('pkg|', k1) LEFT JOIN life o ON o.k = concat(os_id, '|', os_version_id)
  WHERE coalesce(a.cycle, b.cycle) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_finding f WHERE f.accepted = '1' AND f.hostname = c.hostname AND f.package = c.name)),
support AS (SELECT *, CASE WHEN eol_from = '' OR eol_from > '2001-11-05' THEN 'supported' WHEN type IN ('deb', 'rpm', 'apk') AND os_eol > '2001-11-06' THEN 'supported by the distribution'
  WHEN type IN ('deb', 'rpm', 'apk') AND os_eol IS NULL THEN 'distribution lifecycle unknown' ELSE 'no supported release' END AS support FROM m)"""


def support(bed: Bed):
    life = bed.sql(_LIFE).drop("k")
    # Only the first two numbers of a generated version are listed by the catalogue.
    rows = bed.component.withColumn("version", F.concat_ws(".", "maj", "mnr"))
    config = bed.spark.createDataFrame([], "hostname string, purl string, kind string")
    return evidence.support_lifecycle(rows.withColumn("name", F.col("name")), life, bed.exposure, config, bed.finding, NOW)


@query("support_lifecycle", f"WITH {_SUPPORT} SELECT hostname, name AS package, path, cycle, label, eol_from, support, rung, CAST(NOT (eol_from = '' OR eol_from > '2001-11-05') AS INT) AS past_eol FROM support")
def support_lifecycle(bed: Bed):
    return support(bed).select("hostname", "package", "path", "cycle", "label", "eol_from", "support", "rung", "past_eol")


@query("eol_horizon", f"""WITH {_SUPPORT}, d AS (SELECT concat(label, ' ', cycle) AS product_line, hostname, CAST(floor(epoch(CAST(eol_from AS TIMESTAMP))) AS BIGINT) AS eol_at FROM support WHERE eol_from <> '')
SELECT product_line, min(eol_at) AS eol_at, CAST(min(round((eol_at - 1005000000) / 86400.0)) AS BIGINT) AS days, count(DISTINCT hostname) AS hosts, CASE WHEN min(round((eol_at - 1005000000) / 86400.0)) < 0 THEN 'overdue' ELSE 'supported' END AS state
FROM d WHERE round((eol_at - 1005000000) / 86400.0) <= 30.44 * 6 GROUP BY product_line""")
def eol_horizon(bed: Bed):
    return evidence.eol_horizon(support(bed), 6, NOW)


# --- network ----------------------------------------------------------------

@query("permitted_edges", "SELECT src_ip, dest_ip, port, protocol, sessions, edge_first_seen, edge_last_seen FROM t_edge")
def permitted_edges(bed: Bed):
    return flows.permitted_edges(bed.flow, flows.FlowMapping(port="port", protocol="protocol", time="ts"))


@query("permitted_edges_summary", "SELECT src_ip, dest_ip, port, protocol, sessions, edge_first_seen, edge_last_seen FROM t_edge")
def permitted_edges_summary(bed: Bed):
    daily = bed.flow.filter("action = 'allowed'").groupBy("src_ip", "dest_ip", "port", "protocol", F.floor(F.col("ts") / 86400).alias("d")).agg(
        F.count(F.lit(1)).alias("sessions"), F.min("ts").alias("edge_first_seen"), F.max("ts").alias("edge_last_seen"))
    return flows.permitted_edges_from_summary(daily, flows.FlowMapping(port="port", protocol="protocol", action=None))


@query("edge_test", "SELECT count(*) AS edges, count(DISTINCT src_ip) AS sources, count(DISTINCT dest_ip) AS destinations, max(edge_last_seen) AS newest_edge FROM t_edge")
def edge_test(bed: Bed):
    return flows.edge_test(bed.edge)


@query("edge_preview", "SELECT src_ip, dest_ip, port, protocol, sessions FROM t_edge ORDER BY sessions DESC, src_ip, dest_ip, port, protocol LIMIT 100")
def edge_preview(bed: Bed):
    return flows.edge_preview(bed.edge).drop("first_seen", "last_seen")


@query("entry_point_lines", """SELECT concat('203.0.', n_nationkey % 4, '.', 0, '/24') AS cidr, concat('net ', n_nationkey) AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'constant' WHEN n_nationkey % 5 = 1 THEN 'often' ELSE 'occasional' END AS pressure,
  CASE WHEN n_nationkey % 5 = 1 THEN 'pressure must be constant or occasional' END AS problem FROM b_nation""")
def entry_point_lines(bed: Bed):
    k = F.col("n_nationkey")
    tail = F.when(k % 5 == 0, " | Constant").when(k % 5 == 1, "|often").otherwise("")
    line = F.concat(F.lit(" 203.0."), k % 4, F.lit(".77/24 | net "), k, tail)
    return flows.entry_points(bed.b_nation.select(line.alias("line")))


_IN = "CAST(split_part(e.src_ip, '.', 3) AS INT) = CAST(split_part(n.cidr, '.', 3) AS INT) AND e.src_ip LIKE '203.0.%' AND CAST(split_part(e.src_ip, '.', 4) AS INT) >> (32 - b) = o >> (32 - b)"
_ENTRY = f"""nets AS (SELECT *, CAST(split_part(cidr, '/', 2) AS INT) AS b, CAST(split_part(split_part(cidr, '.', 4), '/', 1) AS INT) AS o FROM t_entry),
src AS (SELECT DISTINCT src_ip FROM t_edge),
loose AS (SELECT e.src_ip, string_agg(DISTINCT n.cidr, ' ' ORDER BY n.cidr) AS entry_text, max(CASE WHEN n.pressure = 'constant' THEN 1 ELSE 0 END) AS const FROM src e JOIN nets n ON {_IN} GROUP BY e.src_ip)"""


@query("entry_join_range", f"""WITH {_ENTRY} SELECT e.src_ip, e.dest_ip, e.port, e.protocol, h.entry_text, CAST(h.entry_text IS NOT NULL AS INT) AS from_entry,
  CASE WHEN h.const = 1 THEN 'constant' WHEN h.entry_text IS NOT NULL THEN 'occasional' ELSE 'none' END AS entry_pressure FROM t_edge e LEFT JOIN loose h ON h.src_ip = e.src_ip""")
def entry_join_range(bed: Bed):
    return network.join_entry_points(bed.edge, bed.entry).select("src_ip", "dest_ip", "port", "protocol", "entry_text", "from_entry", "entry_pressure")


@query("address_scope", """WITH a AS (SELECT DISTINCT src_ip AS address FROM t_edge UNION SELECT DISTINCT concat(CAST(o_custkey % 256 AS INT), '.', CAST(o_orderkey % 256 AS INT), '.2.', CAST(o_custkey % 256 AS INT)) FROM b_orders),
p AS (SELECT address, CAST(split_part(address, '.', 1) AS INT) AS a, CAST(split_part(address, '.', 2) AS INT) AS b, CAST(split_part(address, '.', 3) AS INT) AS c FROM a)
SELECT address, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN 'x' WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgnat' WHEN a = 10 THEN 'private' WHEN a = 172 AND b BETWEEN 16 AND 31 THEN 'private'
  WHEN a = 192 AND b = 168 THEN 'private' WHEN a = 192 AND b = 0 AND c IN (0, 2) THEN 'reserved' WHEN a = 198 AND b BETWEEN 18 AND 19 THEN 'reserved' WHEN a = 198 AND b = 51 AND c = 100 THEN 'reserved' WHEN a = 203 AND b = 0 AND c = 113 THEN 'reserved'
  WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a >= 240 THEN 'reserved' ELSE 'public' END AS scope FROM p""")
def address_scope(bed: Bed):
    made = bed.b_orders.select(F.concat_ws(".", F.col("o_custkey") % 256, F.col("o_orderkey") % 256, F.lit("2"), F.col("o_custkey") % 256).alias("address"))
    both = bed.edge.select(F.col("src_ip").alias("address")).union(made).distinct()
    return both.select("address", addr.address_scope(F.col("address")).alias("scope"))


@query("host_addresses_gap", """WITH d AS (SELECT DISTINCT concat('host-', l_suppkey) AS hostname, concat('10.', l_suppkey % 200, '.', l_linenumber, '.1') AS address, @EPOCH(l_shipdate) AS t FROM b_lineitem WHERE l_returnflag <> 'A'),
g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY hostname, address ORDER BY t), 0) AS gap FROM d)
SELECT hostname, address, min(t) AS addr_first_seen, max(t) AS addr_last_seen, count(*) AS observations, max(gap) AS max_gap FROM g GROUP BY ALL""")
def host_addresses_gap(bed: Bed):
    rows = bed.sql("SELECT concat('host-', l_suppkey) AS hostname, concat('10.', l_suppkey % 200, '.', l_linenumber, '.1') AS address, @EPOCH(l_shipdate) AS scanned_at, 'ipv4' AS family, "
                   "CASE WHEN l_returnflag = 'A' THEN 'wildcard' ELSE 'specific' END AS bind_scope, 'null' AS container_id FROM b_lineitem")
    return network.host_addresses(rows).drop("family", "addr_source")


@query("address_claims", """WITH n AS (SELECT hostname, address, addr_first_seen, addr_last_seen, max_gap FROM t_claim), o AS (SELECT hostname, address, addr_first_seen - 90000000 AS f, addr_first_seen - 80000000 AS l, 5 AS g FROM t_claim WHERE max_gap > 300000),
m AS (SELECT n.hostname, n.address, coalesce(least(n.addr_first_seen, o.f), n.addr_first_seen) AS addr_first_seen, n.addr_last_seen, greatest(n.max_gap, coalesce(n.addr_first_seen - o.l, 0)) AS max_gap FROM n LEFT JOIN o ON o.hostname = n.hostname AND o.address = n.address),
k AS (SELECT m.* FROM m JOIN t_host h ON h.hostname = m.hostname WHERE 1005000000 - h.host_last_scan <= 180 * 86400)
SELECT hostname, address, addr_first_seen, addr_last_seen, max_gap, count(*) OVER (PARTITION BY address) AS claimants, 'private' AS addr_scope FROM k""")
def address_claims(bed: Bed):
    old = bed.claim.filter("max_gap > 300000").select("hostname", "address", "family", (F.col("addr_first_seen") - 90000000).alias("addr_first_seen"),
                                                      (F.col("addr_first_seen") - 80000000).alias("addr_last_seen"), F.lit(1).cast("bigint").alias("observations"), F.lit(5).cast("bigint").alias("max_gap"), F.lit("old").alias("addr_source"))
    out = network.address_claims(bed.claim.withColumn("addr_source", F.lit("bind")), old, bed.host, NOW)
    return out.select("hostname", "address", "addr_first_seen", "addr_last_seen", "max_gap", "claimants", "addr_scope")


@query("address_coverage", """SELECT h.hostname, coalesce(c.n, 0) AS addresses, coalesce(c.x, 0) AS contested_addresses, CASE WHEN coalesce(c.n, 0) > 0 THEN 'bind' ELSE 'none' END AS addr_source, coalesce(b.v, 'unknown') AS collector_version FROM t_host h
LEFT JOIN (SELECT hostname, count(*) AS n, count_if(max_gap > 86400) AS x FROM t_claim GROUP BY hostname) c ON c.hostname = h.hostname LEFT JOIN (SELECT hostname, arg_max(event_type, (scanned_at, event_type)) AS v FROM t_heartbeat GROUP BY hostname) b ON b.hostname = h.hostname""")
def address_coverage(bed: Bed):
    claims = bed.claim.withColumns({"claimants": F.when(F.col("max_gap") > 86400, 2).otherwise(1), "addr_source": F.lit("bind")})
    beats = bed.heartbeat.withColumns({"collector_version": F.col("event_type"), "schema_version": F.lit("1")})
    return network.address_coverage(bed.host, claims, beats).select("hostname", "addresses", "contested_addresses", "addr_source", "collector_version")


_OBS = "SELECT o_orderkey, concat(CASE WHEN o_custkey % 2 = 0 THEN '10.' ELSE '52.' END, o_custkey % 13, '.', o_custkey % 5, '.1') AS address, @EPOCH(o_orderdate) AS observed_at FROM b_orders"
_HOLD = """SELECT concat('host-', l_suppkey % 7) AS hostname, concat(CASE WHEN l_suppkey % 2 = 0 THEN '10.' ELSE '52.' END, l_partkey % 13, '.', l_linenumber % 4, '.1') AS address, min(@EPOCH(l_shipdate)) AS first_seen,
  CASE WHEN l_suppkey % 7 = 3 THEN NULL ELSE min(@EPOCH(l_shipdate)) + 30000000 END AS last_seen FROM b_lineitem WHERE l_quantity > 30 GROUP BY l_suppkey, l_partkey % 13, l_linenumber % 4"""


@query("address_resolution", f"""
WITH obs AS ({_OBS}), c AS ({_HOLD}), w AS (SELECT hostname, address, min(first_seen) AS s, CASE WHEN count(*) = count(last_seen) THEN max(last_seen) END AS e FROM c GROUP BY ALL),
n AS (SELECT address, count(*) AS claimants FROM w GROUP BY address),
h AS (SELECT o.o_orderkey, count(w.hostname) AS holders, min(w.hostname) AS host, min(CASE WHEN o.observed_at < w.s OR o.observed_at > w.e THEN 0.7 ELSE 1.0 END) AS wide, min(CASE WHEN w.e IS NULL AND w.hostname IS NOT NULL THEN 0.7 ELSE 1.0 END) AS opened
  FROM obs o LEFT JOIN w ON w.address = o.address AND o.observed_at >= w.s - 86400 AND (w.e IS NULL OR o.observed_at <= w.e + 86400) GROUP BY o.o_orderkey),
r AS (SELECT o.o_orderkey, coalesce(n.claimants, 0) AS claimants, h.*, CASE WHEN coalesce(n.claimants, 0) > 1 AND o.address LIKE '52.%' THEN 'shared' WHEN h.holders > 1 THEN 'shared' WHEN h.holders = 1 THEN 'resolved' WHEN coalesce(n.claimants, 0) = 0 THEN 'outside estate'
  WHEN n.claimants > 1 THEN 'reassigned' ELSE 'stale' END AS outcome FROM obs o JOIN h ON h.o_orderkey = o.o_orderkey LEFT JOIN n ON n.address = o.address)
SELECT r.o_orderkey, outcome, claimants, CASE WHEN outcome = 'resolved' THEN host END AS held_by, CASE WHEN outcome = 'resolved' THEN round(CAST(0.95 AS DOUBLE) * wide * opened * CASE WHEN claimants > 1 THEN 0.6 ELSE 1.0 END, 3) ELSE 0.0 END AS confidence FROM r""")
def address_resolution(bed: Bed):
    return network.resolve_addresses(bed.sql(_OBS), bed.sql(_HOLD), 86400).select("o_orderkey", "outcome", "claimants", "held_by", "confidence")


_ROUTES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 4 AS INT) END AS hops, CAST(o_orderkey % 150 AS BIGINT) AS sessions, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1005000000 - (o_orderkey % 20) * 86400 END AS route_last_seen,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1005000000 - (o_orderkey % 4) * 40000 END AS feed_last_seen, CASE o_custkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS coverage, CASE WHEN o_custkey % 2 = 0 THEN 'constant' ELSE 'occasional' END AS entry_pressure FROM b_orders"""


@query("grade_evidence", f"""WITH r AS ({_ROUTES}) SELECT o_orderkey, CASE WHEN route_last_seen IS NOT NULL THEN CASE WHEN 1005000000 - route_last_seen <= 604800 THEN 'confirmed observed' ELSE 'historically observed' END
  WHEN coverage = 'full' AND 1005000000 - feed_last_seen <= 86400 AND entry_pressure = 'constant' THEN 'not observed' ELSE 'unknown' END AS grade,
  CASE WHEN route_last_seen IS NOT NULL THEN greatest(0.05, round(CASE WHEN 1005000000 - route_last_seen <= 604800 THEN CAST(0.9 AS DOUBLE) ELSE 0.55 END * pow(0.75, hops - 1) * CASE WHEN sessions >= 100 THEN 1.0 WHEN sessions >= 10 THEN 0.95 ELSE 0.85 END, 3))
  WHEN coverage = 'full' AND 1005000000 - feed_last_seen <= 86400 AND entry_pressure = 'constant' THEN 0.7 ELSE 0.0 END AS confidence FROM r""")
def grade_evidence(bed: Bed):
    return network.grade_evidence(bed.sql(_ROUTES), NOW).select("o_orderkey", "grade", "confidence")


_SMALL_CLAIM = "SELECT hostname, address, addr_first_seen, addr_last_seen, max_gap, CAST(count(*) OVER (PARTITION BY address) AS BIGINT) AS claimants FROM t_claim"


_DETAIL = network.IDENTITY_DETAIL


@query("assess_observed", f"""
WITH {_ENTRY}, cl AS ({_SMALL_CLAIM}),
fe AS (SELECT e.dest_ip, e.port, sum(e.sessions) FILTER (h.entry_text IS NOT NULL) AS sessions, min(e.edge_first_seen) FILTER (h.entry_text IS NOT NULL) AS first_seen, max(e.edge_last_seen) FILTER (h.entry_text IS NOT NULL) AS last_seen,
  max(CAST(h.entry_text IS NOT NULL AS INT)) AS from_entry, max(coalesce(h.const, 0)) AS const, count(DISTINCT h.entry_text) AS n_entries, count(DISTINCT e.src_ip) FILTER (h.entry_text IS NOT NULL) AS n_srcs,
  array_to_string(list_slice(list_sort(list(DISTINCT e.src_ip) FILTER (h.entry_text IS NOT NULL)), 1, 10), ' ') AS srcs
  FROM t_edge e LEFT JOIN loose h ON h.src_ip = e.src_ip GROUP BY e.dest_ip, e.port),
ow AS (SELECT address, count(DISTINCT hostname) AS n, min(addr_first_seen) AS f, max(addr_last_seen) AS l, max(max_gap) AS g, max(claimants) AS cm FROM cl GROUP BY address),
st AS (SELECT fe.*, ow.n, ow.f, ow.l, ow.g, ow.cm, CASE WHEN coalesce(ow.n, 0) = 0 THEN 'outside estate' WHEN ow.n > 1 THEN 'shared' WHEN ow.g > 7 * 86400 THEN 'stale' WHEN fe.last_seen >= ow.f AND fe.last_seen <= ow.l THEN 'resolved' ELSE 'stale' END AS ident,
  CASE WHEN coalesce(ow.n, 0) = 0 THEN '{_DETAIL["unheld"]}' WHEN ow.n > 1 THEN '{_DETAIL["hosts"]}' WHEN ow.g > 7 * 86400 THEN '{_DETAIL["gap"]}' WHEN fe.last_seen >= ow.f AND fe.last_seen <= ow.l THEN '{_DETAIL["inside"]}'
    WHEN fe.last_seen > ow.l THEN '{_DETAIL["late"]}' ELSE '{_DETAIL["early"]}' END AS detail FROM fe LEFT JOIN ow ON ow.address = fe.dest_ip),
ev AS (SELECT *, CASE WHEN from_entry <> 1 THEN 0 WHEN ident <> 'resolved' THEN 1 WHEN 1005000000 - last_seen <= 7 * 86400 THEN 3 ELSE 2 END AS rnk FROM st),
pl AS (SELECT DISTINCT c.hostname, ev.* FROM ev JOIN cl c ON c.address = ev.dest_ip),
pp AS (SELECT hostname, port, max(rnk) AS rnk, max(sessions) AS sessions, min(first_seen) AS edge_first_seen, max(last_seen) AS edge_last_seen, max(const) AS const, max(n_entries) AS n_entries, max(n_srcs) AS n_srcs, max(f) AS f, max(l) AS l, max(g) AS g, max(cm) AS cm,
  string_agg(DISTINCT nullif(srcs, ''), ' ' ORDER BY nullif(srcs, '')) AS srcs, string_agg(DISTINCT ident, '; ' ORDER BY ident) AS ident, string_agg(DISTINCT detail, '; ' ORDER BY detail) AS detail, string_agg(DISTINCT dest_ip, ' ' ORDER BY dest_ip) AS dest FROM pl GROUP BY hostname, port),
cov AS (SELECT DISTINCT hostname FROM pl WHERE ident = 'resolved'),
op AS (SELECT hostname, package FROM t_finding WHERE status = 'open' AND accepted <> '1'),
ports AS (SELECT e.hostname, e.port FROM t_exposure e JOIN op ON op.hostname = e.hostname AND op.package = coalesce(e.package, 'unattributed') GROUP BY ALL),
j AS (SELECT p.hostname, p.port, coalesce(x.rnk, 0) AS rnk, x.sessions, x.edge_first_seen, x.edge_last_seen, coalesce(x.const, 0) AS const, coalesce(x.n_entries, 0) AS n_entries, coalesce(x.n_srcs, 0) AS n_srcs, x.f, x.l, x.g, x.cm, coalesce(x.srcs, '') AS srcs, x.ident, x.detail, x.dest,
  c.hostname IS NOT NULL AS covered, v.observed_grade AS pg, v.grade_changed_at AS pc, k.hostname AS known
  FROM ports p LEFT JOIN pp x ON x.hostname = p.hostname AND x.port = p.port LEFT JOIN cov c ON c.hostname = p.hostname LEFT JOIN t_netevidence v ON v.hostname = p.hostname AND v.port = p.port LEFT JOIN (SELECT DISTINCT hostname FROM t_netevidence) k ON k.hostname = p.hostname),
g AS (SELECT *, CASE WHEN covered THEN 'covered' ELSE 'host not in graph' END AS coverage_state, CASE WHEN rnk = 3 THEN 'confirmed observed' WHEN rnk = 2 THEN 'historically observed' WHEN rnk = 1 THEN 'unknown' WHEN covered THEN 'not observed' ELSE 'unknown' END AS observed_grade FROM j)
SELECT hostname, concat(port) AS port, observed_grade, coverage_state, sessions, edge_first_seen, edge_last_seen, CASE WHEN rnk >= 2 AND const = 1 THEN 'boundary' WHEN rnk >= 2 THEN 'interior' WHEN observed_grade = 'not observed' THEN 'boundary' ELSE 'none' END AS evidence_strength,
  CASE WHEN pg IS NOT NULL THEN pg WHEN known IS NULL THEN observed_grade ELSE '' END AS previous_grade,
  CASE WHEN (CASE WHEN pg IS NOT NULL THEN pg WHEN known IS NULL THEN observed_grade ELSE '' END) <> observed_grade THEN 1005000000 ELSE coalesce(pc, 1005000000) END AS grade_changed_at,
  CASE rnk WHEN 3 THEN '{network.REASONS[3]}' WHEN 2 THEN '{network.REASONS[2]}' WHEN 1 THEN concat('{network.REASONS[1]}', detail) ELSE CASE WHEN observed_grade = 'not observed' THEN '{network.REASONS["quiet"]}' ELSE coverage_state END END AS observed_reason,
  coalesce(ident, 'no edge to resolve') AS identity_state, dest AS dest_address, srcs AS srcs_text, n_srcs, n_entries, f AS addr_first_seen, l AS addr_last_seen, g AS addr_max_gap, cm AS claimants FROM g""")
def assess_observed(bed: Bed):
    # Tables that the assessment reads more than once are derived once.
    previous = bed.netevidence.select("hostname", "port", "observed_grade", "grade_changed_at", "reappeared_at")
    edges, claims, previous = (written(df, "assess") for df in (bed.edge.drop("protocol"), bed.sql(_SMALL_CLAIM), previous))
    out = network.assess_observed(edges, bed.entry, claims, bed.exposure, bed.finding, previous, NOW, Params(flow_stale_days=60))
    return out.select("hostname", "port", "observed_grade", "coverage_state", "sessions", "edge_first_seen", "edge_last_seen", "evidence_strength", "previous_grade",
                      "grade_changed_at", "observed_reason", "identity_state", "dest_address", "srcs_text", "n_srcs", "n_entries", "addr_first_seen",
                      "addr_last_seen", "addr_max_gap", "claimants")


@query("evidence_coverage", """
WITH s AS (SELECT DISTINCT src_ip AS a FROM t_edge UNION SELECT DISTINCT dest_ip FROM t_edge), k AS (SELECT c.hostname, count(*) AS known, count(s.a) AS ing FROM t_claim c LEFT JOIN s ON s.a = c.address GROUP BY c.hostname),
h AS (SELECT t.hostname, coalesce(k.known, 0) AS known, coalesce(k.ing, 0) AS ing FROM t_host t LEFT JOIN k ON k.hostname = t.hostname)
SELECT count(*) AS hosts_total, count_if(ing > 0) AS hosts_in_graph, count_if(known = 0) AS hosts_without_addresses, CAST(sum(known) AS BIGINT) AS addresses_known, CAST(sum(ing) AS BIGINT) AS addresses_in_graph,
  (SELECT count(*) FROM t_edge) AS fw_edges, round(100.0 * count_if(ing > 0) / count(*), 1) AS hosts_in_graph_pct, 'covered' AS coverage_state, 1 AS negative_claims_permitted FROM h""")
def evidence_coverage(bed: Bed):
    out = network.evidence_coverage(bed.host, bed.claim, bed.edge, bed.entry, NOW, Params(flow_stale_days=60))
    return out.select("hosts_total", "hosts_in_graph", "hosts_without_addresses", "addresses_known", "addresses_in_graph", "fw_edges", "hosts_in_graph_pct", "coverage_state", "negative_claims_permitted")


@query("net_evidence_join", """
WITH r AS (SELECT f.finding_key, n.observed_grade AS g, CASE n.observed_grade WHEN 'confirmed observed' THEN 3 WHEN 'historically observed' THEN 2 WHEN 'not observed' THEN 1 ELSE 0 END AS k
  FROM t_finding f LEFT JOIN t_exposure e ON e.hostname = f.hostname AND e.package = f.package AND f.scope <> 'container' LEFT JOIN t_netevidence n ON n.hostname = e.hostname AND n.port = e.port)
SELECT finding_key, max(k) AS observed_rank, CASE max(k) WHEN 3 THEN 'confirmed observed' WHEN 2 THEN 'historically observed' WHEN 1 THEN 'not observed' ELSE 'unknown' END AS observed_grade FROM r GROUP BY finding_key""")
def net_evidence_join(bed: Bed):
    return network.net_evidence(bed.finding, bed.exposure, bed.netevidence).select("finding_key", "observed_rank", "observed_grade")


@query("exposure_regressions", """SELECT hostname, port, CASE WHEN coalesce(1005000000 - reappeared_at < 5400, false) THEN 'reappeared' ELSE 'first-observed' END AS regression_kind FROM t_netevidence WHERE observed_grade = 'confirmed observed'
AND ((previous_grade = '' AND 1005000000 - grade_changed_at < 5400) OR coalesce(1005000000 - reappeared_at < 5400, false))""")
def exposure_regressions(bed: Bed):
    return network.exposure_regressions(bed.netevidence, NOW).select("hostname", "port", "regression_kind")


@query("grade_summary", """SELECT observed_grade, count(*) AS count, CASE observed_grade WHEN 'confirmed observed' THEN 0 WHEN 'historically observed' THEN 1 WHEN 'not observed' THEN 2 ELSE 3 END AS rk_order FROM t_netevidence GROUP BY observed_grade""")
def grade_summary(bed: Bed):
    return network.grade_summary(bed.netevidence)


@query("coverage_summary", "SELECT coverage_state, count(*) AS rows, count(DISTINCT hostname) AS hosts FROM t_netevidence GROUP BY coverage_state")
def coverage_summary(bed: Bed):
    return network.coverage_summary(bed.netevidence).drop("meaning")


@query("identity_summary", "SELECT identity_state, count(*) AS rows, count(DISTINCT hostname) AS hosts FROM t_netevidence WHERE identity_state <> 'resolved' GROUP BY identity_state")
def identity_summary(bed: Bed):
    return network.identity_summary(bed.netevidence).drop("meaning")


@query("identity_hosts", "SELECT DISTINCT identity_state, hostname FROM t_netevidence WHERE identity_state <> 'resolved'")
def identity_hosts(bed: Bed):
    return network.identity_hosts(bed.netevidence)


@query("cvss_words", """SELECT advisory_id, CASE WHEN cvss_vector = '' THEN 'none published' ELSE cvss_vector END AS vector, CASE WHEN cvss_vector LIKE '%AV:N%' THEN 'over a network' WHEN cvss_vector LIKE '%AV:A%' THEN 'from an adjacent network'
  WHEN cvss_vector LIKE '%AV:L%' THEN 'with local access to the machine' ELSE 'not stated' END AS reach, CASE WHEN cvss_vector LIKE '%UI:N%' THEN 'none, nobody has to be tricked' WHEN cvss_vector LIKE '%UI:R%' THEN 'somebody must open or click something' ELSE 'not stated' END AS user_interaction FROM t_advisory""")
def cvss_words(bed: Bed):
    return cvss_english(bed.advisory).select("advisory_id", "vector", "reach", "user_interaction")


@query("cvss_network_reach", """WITH v AS (SELECT cve_id, CASE WHEN cvss_vector LIKE '%AV:N%PR:N%UI:N%C:H%' THEN 3 WHEN cvss_vector LIKE '%AV:N%' THEN 2 ELSE 0 END AS r, cvss_vector LIKE '%AV:N%' OR cvss_vector LIKE '%AV:A%' AS net FROM t_advisory WHERE cvss_vector <> '')
SELECT a.cve_id, coalesce(max(v.r), 1) AS rank, CASE WHEN coalesce(max(v.r), 1) <> 0 OR NOT coalesce(bool_or(v.net), false) THEN 0 ELSE 1 END AS down FROM (SELECT DISTINCT cve_id FROM t_advisory) a LEFT JOIN v ON v.cve_id = a.cve_id GROUP BY a.cve_id""")
def cvss_network_reach(bed: Bed):
    return bed.advisory.groupBy("cve_id").agg(cvss_reach(values("cvss_vector")).alias("r")).select("cve_id", "r.rank", "r.down")
