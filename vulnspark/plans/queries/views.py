"""Queries of the small page views and of column rules that larger queries reach only in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.functions.address import address_in_network, address_scope, norm_address, norm_network
from vulnspark.functions.versions import rpm_version_only_key
from vulnspark.operators import evidence, exceptions, identity, lifecycle, matching, network, priority, reports, rollups, routes
from vulnspark.params import Params
from vulnspark.plans.queries import context
from vulnspark.plans.queries import inventory as inventory_queries
from vulnspark.plans.queries.context import _LONG, _PATHS, _RESULTS
from vulnspark.plans.queries.evidence import _LIFE
from vulnspark.plans.queries.lifecycle import _MATCHED, _RECEIPTS, _STATE
from vulnspark.plans.queries.registry import ORACLES, query
from vulnspark.plans.testbed import NOW, Bed
from vulnspark.sources.flows import no_edges

_DAYTIME = "strftime(make_timestamp(CAST({} * 1000000 AS BIGINT)), '{}')"
_MINUTES, _SECONDS = (lambda c: _DAYTIME.format(c, "%Y-%m-%d %H:%M")), (lambda c: _DAYTIME.format(c, "%Y-%m-%d %H:%M:%S"))
_ROOT = "CASE WHEN scope_id <> '' THEN scope_id ELSE 'host' END"


# --- page views -------------------------------------------------------------

@query("host_picker", "SELECT hostname FROM t_host")
def host_picker(bed: Bed):
    return reports.host_picker(bed.host)


@query("windows_distance")
def windows_distance(bed: Bed):
    return reports.windows_distance(inventory_queries.windows_patch_level(bed)).select("hostname", "branch", "behind_ubr", "behind")


ORACLES["windows_distance"] = f"""SELECT hostname, branch, behind_ubr, CASE WHEN latest_ubr IS NULL THEN 'not in the feed' WHEN behind_ubr <= 0 THEN 'up to date' ELSE concat(behind_ubr, ' builds behind') END AS behind
FROM ({ORACLES["windows_patch_level"]}) w"""


@query("eol_list", f"WITH life AS ({_LIFE}) SELECT product, cycle, concat(label, ' ', cycle) AS product_line, CASE WHEN eol_from = '' THEN 'not stated' ELSE eol_from END AS support_ends FROM life")
def eol_list(bed: Bed):
    return evidence.eol_list(bed.sql(_LIFE)).select("product", "cycle", "product_line", "support_ends")


@query("eol_products", f"WITH life AS ({_LIFE}) SELECT concat(label, ' ', cycle) AS product_line, count(*) AS count FROM life WHERE eol_from <> '' GROUP BY ALL")
def eol_products(bed: Bed):
    return evidence.eol_products(bed.sql(_LIFE))


@query("encyclopaedia_size", "SELECT count(DISTINCT cve_id) AS rows FROM t_advisory")
def encyclopaedia_size(bed: Bed):
    return reports.encyclopaedia_size(bed.advisory.groupBy("cve_id").agg(F.max("title").alias("products")))


@query("stale_hosts", f"""WITH r AS ({_RECEIPTS}), m AS ({_MATCHED}), g AS (SELECT hostname, max(match_run) AS run, CAST(sum(findings_produced) AS BIGINT) AS p FROM r GROUP BY hostname),
s AS (SELECT g.*, m.folded_run, 1005000000 - run AS w FROM g LEFT JOIN m ON m.hostname = g.hostname WHERE p > 0 AND NOT coalesce(abs(m.folded_run - g.run) < 300, false))
SELECT hostname, {_SECONDS("run")} AS matched, p AS findings_produced, coalesce({_SECONDS("folded_run")}, 'never') AS folded,
  concat(CASE WHEN w >= 86400 THEN concat(w // 86400, '+') ELSE '' END, lpad(concat(w % 86400 // 3600), 2, '0'), ':', lpad(concat(w % 3600 // 60), 2, '0'), ':', lpad(concat(w % 60), 2, '0')) AS waiting FROM s""")
def stale_hosts(bed: Bed):
    return lifecycle.stale_hosts(bed.sql(_RECEIPTS), bed.sql(_MATCHED), NOW)


@query("remediation_gone", f"""SELECT cve_id, package, last_version, status, {_ROOT} AS root, hostname, path, {_MINUTES("last_seen")} AS last_seen
FROM t_finding WHERE status IN ('removed', 'unknown') AND archived IS NULL""")
def remediation_gone(bed: Bed):
    return lifecycle.remediation_gone(bed.finding)


_AUDIT = """SELECT exception_key, created_at AS at, 'created' AS action, control AS detail FROM t_exception UNION ALL
SELECT exception_key, CAST(revoked_at AS BIGINT), 'revoked', control FROM t_exception WHERE revoked_at <> ''"""


@query("audit_trail", f"""WITH a AS ({_AUDIT}) SELECT exception_key, action, detail, a.at AS at, {_SECONDS("a.at")} AS "when" FROM a""")
def audit_trail(bed: Bed):
    return reports.audit_trail(bed.sql(_AUDIT)).select("exception_key", "action", "detail", "at", "when")


@query("exceptions_ended", f"""WITH s AS (SELECT *, {_STATE} AS exc_state FROM t_exception)
SELECT exception_key, exc_state, CASE WHEN exc_state = 'revoked' THEN {_MINUTES("CAST(nullif(revoked_at, '') AS BIGINT)")} ELSE {_MINUTES("CAST(nullif(expires_at, '') AS BIGINT)")} END AS ended FROM s WHERE exc_state <> 'active'""")
def exceptions_ended(bed: Bed):
    return exceptions.ended(bed.exception, NOW).select("exception_key", "exc_state", "ended")


@query("path_table", f"""WITH {_PATHS}, s AS (SELECT array_to_string(nodes, ' → ') AS path_text, length(flags) AS jumps, length(regexp_extract(flags, '^C*')) AS cve_run FROM allp WHERE flags NOT LIKE '%P%' AND nodes[1] IN ('entry-1', 'entry-2'))
SELECT path_text, CAST(jumps AS INT) AS jumps, CASE WHEN cve_run = jumps THEN 'yes, every jump' WHEN cve_run = 0 THEN 'no, not even the first' ELSE concat('the first ', cve_run, ' of ', jumps) END AS on_cves_alone FROM s""")
def path_table(bed: Bed):
    """Paths from two entries without a jump that flows merely permit."""
    paths = routes.enumerate_paths(bed.jump, Params(path_fanout=8))
    shown = reports.path_table(paths, "entry-1", show="no permitted").unionByName(reports.path_table(paths, "entry-2", show="no permitted"))
    return shown.select("path_text", "jumps", "on_cves_alone")


@query("walk_freshness", "SELECT count(*) AS edges, count(DISTINCT dst) AS hosts, CAST(1005000000 - 600 AS BIGINT) AS walked_at FROM (SELECT DISTINCT src, dst, port, protocol FROM t_jump) j")
def walk_freshness(bed: Bed):
    jumps = bed.jump.select("src", "dst", "port", "protocol").distinct()
    return reports.walk_freshness(jumps.withColumn("walked_at", F.lit(NOW - 600).cast("bigint")))


@query("replay_view")
def replay_view(bed: Bed):
    return reports.replay_view(context.escalation_replay(bed))


ORACLES["replay_view"] = f"SELECT r.*, concat(from_tier, ' to ', to_tier) AS move FROM ({ORACLES['escalation_replay']}) r"


@query("results_stopped", f"WITH r AS ({_RESULTS}) SELECT count(*) AS results FROM r WHERE result_at >= 1005000000 HAVING count(*) = 0")
def results_stopped(bed: Bed):
    return priority.results_stopped(bed.sql(_RESULTS), NOW)


@query("newest_run", f"WITH r AS ({_RESULTS}) SELECT cve_id, asset_id, run_id, priority_tier, result_at FROM r WHERE result_at >= (SELECT max(result_at) - 1 FROM r)")
def newest_run(bed: Bed):
    return priority.newest_run(bed.sql(_RESULTS)).select("cve_id", "asset_id", "run_id", "priority_tier", "result_at")


@query("confidence_split", f"WITH {_LONG} SELECT p.value AS confidence, count(*) AS findings FROM long WHERE p.dim = 'confidence' GROUP BY ALL")
def confidence_split(bed: Bed):
    return reports.confidence_split(rollups.rollup_dim(bed.finding))


_NAMED_OS = """SELECT s_suppkey, concat('host-', s_suppkey) AS hostname, CASE s_nationkey % 5 WHEN 0 THEN 'Ubuntu' WHEN 1 THEN 'Windows Server 2022' WHEN 2 THEN 'macOS'
  WHEN 3 THEN 'rhel' ELSE 'plan9' END AS os FROM b_supplier"""
_FAMILY = "CASE s_nationkey % 5 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Windows' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Linux' ELSE '__unknown__' END"


@query("host_family", f"SELECT {_FAMILY} AS family, count(*) AS hosts FROM b_supplier GROUP BY ALL")
def host_family(bed: Bed):
    return bed.sql(_NAMED_OS).groupBy(identity.host_family(F.col("os")).alias("family")).agg(F.count(F.lit(1)).alias("hosts"))


@query("host_platforms", f"SELECT count(*) AS hosts, string_agg(DISTINCT {_FAMILY}, ' ' ORDER BY {_FAMILY}) AS families FROM b_supplier")
def host_platforms(bed: Bed):
    return identity.host_platforms(bed.sql(_NAMED_OS)).select("hosts", F.array_join("families", " ").alias("families"))


@query("coverage_without_flows", """SELECT (SELECT count(*) FROM t_host) AS hosts_total, CAST(0 AS BIGINT) AS hosts_in_graph, (SELECT count(*) FROM t_claim) AS addresses_known, CAST(0 AS BIGINT) AS fw_edges,
  'no firewall data' AS coverage_state, 0 AS negative_claims_permitted""")
def coverage_without_flows(bed: Bed):
    """A fleet that sends no flow logs: nothing may be claimed from silence."""
    out = network.evidence_coverage(bed.host, bed.claim, no_edges(bed.spark), bed.entry, NOW)
    return out.select("hosts_total", "hosts_in_graph", "addresses_known", "fw_edges", "coverage_state", "negative_claims_permitted")


# --- column rules -----------------------------------------------------------

# Each customer has one address and one network, in spellings that must come out canonical; the oracle builds the canonical text from the numbers.
_SPELLED = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat('10.', c_custkey % 200, '.7.1') WHEN 1 THEN concat('FD00:0:0:', 1 + c_custkey % 9, ':0000:0:0:0A')
  WHEN 2 THEN concat('[fe80::', 1 + c_custkey % 9, ']%eth0') WHEN 3 THEN concat('::ffff:192.0.2.', c_custkey % 200) ELSE concat('10.', c_custkey % 200, '.300.1') END AS address,
  CASE c_custkey % 5 WHEN 0 THEN concat('10.', (c_custkey + c_custkey % 2) % 200, '.0.0/16') WHEN 1 THEN concat('Fd00:0:0:', 1 + c_custkey % 9, '::/64') WHEN 2 THEN 'fe80:0::/10'
    WHEN 3 THEN concat('192.0.2.', c_custkey % 2, '/24') ELSE '10.0.0.0' END AS network FROM b_customer"""


@query("network_texts", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat('10.', c_custkey % 200, '.7.1') WHEN 1 THEN concat('fd00:0:0:', 1 + c_custkey % 9, '::a')
  WHEN 2 THEN concat('fe80::', 1 + c_custkey % 9) WHEN 3 THEN concat('192.0.2.', c_custkey % 200) END AS address,
  CASE c_custkey % 5 WHEN 0 THEN concat('10.', (c_custkey + c_custkey % 2) % 200, '.0.0/16') WHEN 1 THEN concat('fd00:0:0:', 1 + c_custkey % 9, '::/64') WHEN 2 THEN 'fe80::/10'
    WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN '192.0.2.0/24' END END AS network,
  CASE c_custkey % 5 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN c_custkey % 2 = 0 ELSE false END AS inside,
  CASE c_custkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'unique-local' WHEN 2 THEN 'link-local' WHEN 3 THEN 'reserved' ELSE 'unknown' END AS scope FROM b_customer""")
def network_texts(bed: Bed):
    address, network = F.col("address"), F.col("network")
    return bed.sql(_SPELLED).select("c_custkey", norm_address(address).alias("address"), norm_network(network).alias("network"),
                                    address_in_network(address, network).alias("inside"), address_scope(address).alias("scope"))


@query("rpm_version_only", """WITH pair AS (SELECT (c.maj, c.mnr, c.pat, CASE WHEN c.rc = 0 THEN 9 ELSE c.rc END) AS v, (r.f_maj, r.f_mnr, r.f_pat, 1) AS f
  FROM t_component c JOIN t_range r ON r.ecosystem = c.type AND r.package = c.name WHERE c.type = 'rpm' AND r.fixed <> '')
SELECT CASE WHEN v < f THEN -1 WHEN v > f THEN 1 ELSE 0 END AS result, count(*) AS n FROM pair GROUP BY ALL""")
def rpm_version_only(bed: Bed):
    """Installed against fixed version where the releases differ and must not count."""
    installed = bed.component.filter("type = 'rpm'").select("name", F.concat("version", F.lit("."), "l_suppkey").alias("version"))
    fixed = bed.range.filter("ecosystem = 'rpm' and fixed <> ''").select(F.col("package").alias("name"), "fixed")
    a, b = rpm_version_only_key(F.col("version")), rpm_version_only_key(F.col("fixed"))
    result = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return installed.join(fixed, "name").groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


_VARIANT = """CASE l_partkey % 6 WHEN 0 THEN 'pro' WHEN 1 THEN 'fips-updates' WHEN 2 THEN 'pro:fips' WHEN 3 THEN 'realtime' WHEN 4 THEN 'nonsense' ELSE '' END"""
_MARK = "CASE l_suppkey % 4 WHEN 0 THEN '+ESM1' WHEN 1 THEN '+fips' WHEN 2 THEN '+esm1.fips2' ELSE '' END"


@query("variant_evidence", f"""SELECT {_VARIANT} AS variant, {_MARK} AS mark, count(*) AS n, CASE l_partkey % 6 WHEN 0 THEN l_suppkey % 4 IN (0, 2) WHEN 1 THEN l_suppkey % 4 IN (1, 2) WHEN 2 THEN l_suppkey % 4 = 2 ELSE false END AS applies
FROM t_component GROUP BY ALL""")
def variant_evidence(bed: Bed):
    rows = bed.component.select(F.expr(_VARIANT).alias("variant"), F.expr(_MARK).alias("mark"), "version")
    applies = matching.variant_applies(F.concat("version", "mark"), F.col("variant"))
    return rows.groupBy("variant", "mark", applies.alias("applies")).agg(F.count(F.lit(1)).alias("n"))


_PLACE = """CASE l_partkey % 6 WHEN 0 THEN concat('/usr/lib/python3/dist-packages/pkg', l_partkey) WHEN 1 THEN concat('/usr/lib64/python3.9/site-packages/pkg', l_partkey)
  WHEN 2 THEN concat('/opt/venv/lib/python3.9/site-packages/pkg', l_partkey) WHEN 3 THEN concat('/usr/share/nodejs/pkg', l_partkey) WHEN 4 THEN concat('/srv/app/node_modules/pkg', l_partkey)
  ELSE concat('/usr/lib/python3.9/other/pkg', l_partkey) END"""


@query("distro_managed", """SELECT l_partkey % 6 AS place, l_suppkey % 7 = 0 AS owned, count(*) AS n, l_suppkey % 7 = 0 OR l_partkey % 6 IN (0, 1, 3) AS managed FROM t_component GROUP BY ALL""")
def distro_managed(bed: Bed):
    owned = F.col("l_suppkey") % 7 == 0
    rows = bed.component.withColumns({"path": F.expr(_PLACE), "owned_by": F.when(owned, "python3-base").otherwise("")})
    return rows.groupBy((F.col("l_partkey") % 6).alias("place"), owned.alias("owned"), identity.distro_managed(rows).alias("managed")).agg(F.count(F.lit(1)).alias("n"))


# --- matching with claims the feeds seldom have -----------------------------

@query("match_without_informational")
def match_without_informational(bed: Bed):
    found = matching.match(bed.component, bed.range, bed.notaffected, include_informational=False)
    return found.select("finding_key", "advisory_id", "confidence")


ORACLES["match_without_informational"] = f"SELECT finding_key, advisory_id, confidence FROM ({ORACLES['match_findings']}) m WHERE confidence <> 'informational'"


# Claims of two more families: a release of Alpine holds by its first two numbers, one of an RPM distribution by its first.
_RELEASES = """SELECT ecosystem, package, advisory_id, cve_id, '' AS introduced, '' AS introduced_excluding, '' AS last_affected, '99' AS fixed, CASE ecosystem WHEN 'apk' THEN 'alpine' ELSE 'redhat' END AS distro,
  CASE ecosystem WHEN 'apk' THEN CASE o_orderkey % 3 WHEN 0 THEN '3.19' WHEN 1 THEN 'v3.19.7' ELSE '3.18.1' END ELSE CASE o_orderkey % 3 WHEN 0 THEN '9' WHEN 1 THEN '9.1' ELSE '8.3' END END AS distro_release,
  '' AS distro_variant, 'osv' AS feed_source, 'ECOSYSTEM' AS range_type, 'affected' AS status, o_orderkey FROM t_range WHERE ecosystem IN ('apk', 'rpm')"""


@query("match_release_rules", f"""WITH r AS ({_RELEASES})
SELECT DISTINCT c.hostname, c.name AS package, c.path, r.cve_id, 'distro' AS match_authority FROM t_component c JOIN r ON r.ecosystem = c.type
  AND r.package IN (c.name, concat('src', c.l_partkey % 10, '-', CAST(floor(c.l_partkey / 40) AS BIGINT))) WHERE c.l_returnflag = 'A' AND r.o_orderkey % 3 < 2 AND c.os_id = CASE c.type WHEN 'apk' THEN 'alpine' ELSE 'rhel' END""")
def match_release_rules(bed: Bed):
    """Alpine and RPM claims on the packages of the hosts themselves."""
    empty = bed.notaffected.filter(F.lit(False))
    found = matching.match(bed.component.filter("l_returnflag = 'A' and type in ('apk', 'rpm')"), bed.sql(_RELEASES), empty)
    return found.select("hostname", "package", "path", "cve_id", "match_authority")
