"""Graph, ATT&CK, priority and roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnspark.functions.cvss import cvss_letters
from vulnspark.operators import attack, evidence, priority, rollup_changes, rollups, routes
from vulnspark.operators.generic import first_per_key, salted_join, subtotal
from vulnspark.params import Params
from vulnspark.plans import rollup_state
from vulnspark.plans.queries.evidence import _LOADED, _REACH, _SUPPORT, _TRIAGE, _links, _loaded, support, triaged
from vulnspark.plans.queries.registry import query
from vulnspark.plans.testbed import NOW, Bed
from vulnspark.sources.state import scratch_store, written

# --- graph ------------------------------------------------------------------

_MERGED = """j AS (SELECT src, dst, sum(sessions) AS sessions, max(edge_last_seen) AS edge_last_seen, arg_min(struct_pack(kind := kind, rk := rk_rank, port := port, w := wire_text, f := foot_text),
    (-rk_rank, -sessions, port, kind, wire_text, foot_text)) AS b, string_agg(DISTINCT port, ',' ORDER BY port) AS ports, count(DISTINCT port) AS n_ports FROM t_jump WHERE src <> dst GROUP BY src, dst),
m AS (SELECT src, dst, sessions, edge_last_seen, b.kind AS kind, b.rk AS rk_rank, b.port AS port, ports, n_ports, CASE b.rk WHEN 3 THEN 'cve' WHEN 2 THEN 'foothold' WHEN 1 THEN 'unrated' ELSE 'permitted' END AS rk_class FROM j)"""


@query("merge_edges", f"WITH {_MERGED} SELECT src, dst, sessions, edge_last_seen, kind, rk_rank, rk_class, port, ports, CAST(n_ports AS INT) AS n_ports FROM m")
def merge_edges(bed: Bed):
    out = routes.merge_edges(bed.jump)
    return out.select("src", "dst", "sessions", "edge_last_seen", "kind", "rk_rank", "rk_class", "port", F.array_join("ports", ",").alias("ports"), "n_ports")


_WALK = f"""{_MERGED}, starts AS (SELECT DISTINCT src AS entry FROM m WHERE kind = 'entry'),
d1 AS (SELECT DISTINCT s.entry, m.dst AS node FROM starts s JOIN m ON m.src = s.entry),
d2 AS (SELECT DISTINCT d.entry, m.dst AS node FROM d1 d JOIN m ON m.src = d.node), d3 AS (SELECT DISTINCT d.entry, m.dst AS node FROM d2 d JOIN m ON m.src = d.node), d4 AS (SELECT DISTINCT d.entry, m.dst AS node FROM d3 d JOIN m ON m.src = d.node),
depth AS (SELECT entry, node, min(d) AS d FROM (SELECT entry, entry AS node, 0 AS d FROM starts UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3 UNION ALL SELECT *, 4 FROM d4) GROUP BY ALL),
c AS (SELECT * FROM m WHERE rk_class = 'cve'), c1 AS (SELECT DISTINCT s.entry, m.dst AS node FROM starts s JOIN c m ON m.src = s.entry), c2 AS (SELECT DISTINCT d.entry, m.dst AS node FROM c1 d JOIN c m ON m.src = d.node),
c3 AS (SELECT DISTINCT d.entry, m.dst AS node FROM c2 d JOIN c m ON m.src = d.node), c4 AS (SELECT DISTINCT d.entry, m.dst AS node FROM c3 d JOIN c m ON m.src = d.node), c5 AS (SELECT DISTINCT d.entry, m.dst AS node FROM c4 d JOIN c m ON m.src = d.node),
creach AS (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3 UNION SELECT * FROM c4 UNION SELECT * FROM c5)"""


@query("hops_bfs", f"""WITH {_WALK}, g AS (SELECT m.src, m.dst, m.rk_class, min(d.d) + 1 AS hop, string_agg(concat(d.entry, ':', d.d + 1), ',' ORDER BY concat(d.entry, ':', d.d + 1)) AS hops FROM m JOIN depth d ON d.node = m.src WHERE d.d < 5 GROUP BY ALL)
SELECT g.src, g.dst, g.rk_class, CAST(g.hop AS INT) AS hop, g.hops, coalesce(r.reach, '') AS dst_reach FROM g LEFT JOIN (SELECT node, string_agg(DISTINCT entry, ',' ORDER BY entry) AS reach FROM creach GROUP BY node) r ON r.node = g.dst""")
def hops_bfs(bed: Bed):
    out = routes.grade_edges(bed.jump, 5)
    return out.select("src", "dst", "rk_class", "hop", F.array_join("hops", ",").alias("hops"), F.array_join("dst_reach", ",").alias("dst_reach"))


_PATHS = f"""{_MERGED}, bst AS (SELECT *, CASE rk_class WHEN 'cve' THEN 'C' WHEN 'foothold' THEN 'F' WHEN 'unrated' THEN 'U' ELSE 'P' END AS flag FROM m QUALIFY row_number() OVER (PARTITION BY src ORDER BY rk_rank DESC, sessions DESC, dst) <= 8),
p1 AS (SELECT [src, dst] AS nodes, dst AS node, flag AS flags, sessions AS smin FROM bst WHERE src IN (SELECT src FROM m WHERE kind = 'entry')),
p2 AS (SELECT list_append(nodes, dst) AS nodes, dst AS node, concat(flags, flag) AS flags, least(smin, sessions) AS smin FROM p1 JOIN bst ON bst.src = p1.node WHERE NOT list_contains(nodes, dst)),
q2 AS (SELECT * FROM p2 WHERE length(regexp_replace(flags, '^C*', '')) <= 2),
p3 AS (SELECT list_append(nodes, dst) AS nodes, dst AS node, concat(flags, flag) AS flags, least(smin, sessions) AS smin FROM q2 JOIN bst ON bst.src = q2.node WHERE NOT list_contains(nodes, dst)),
q3 AS (SELECT * FROM p3 WHERE length(regexp_replace(flags, '^C*', '')) <= 2),
p4 AS (SELECT list_append(nodes, dst) AS nodes, dst AS node, concat(flags, flag) AS flags, least(smin, sessions) AS smin FROM q3 JOIN bst ON bst.src = q3.node WHERE NOT list_contains(nodes, dst)),
q4 AS (SELECT * FROM p4 WHERE length(regexp_replace(flags, '^C*', '')) <= 2),
p5 AS (SELECT list_append(nodes, dst) AS nodes, dst AS node, concat(flags, flag) AS flags, least(smin, sessions) AS smin FROM q4 JOIN bst ON bst.src = q4.node WHERE NOT list_contains(nodes, dst)),
q5 AS (SELECT * FROM p5 WHERE length(regexp_replace(flags, '^C*', '')) <= 2),
allp AS (SELECT * FROM p1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4 UNION ALL SELECT * FROM q5)"""


@query("paths_topk", f"""WITH {_PATHS}, s AS (SELECT array_to_string(nodes, ' → ') AS path_text, flags, length(flags) AS jumps, length(regexp_extract(flags, '^C*')) AS cve_run, smin AS sessions_min FROM allp)
SELECT path_text, flags, CAST(jumps AS INT) AS jumps, CAST(cve_run AS INT) AS cve_run, CAST(cve_run = jumps AS INT) AS full_cve, sessions_min FROM s""")
def paths_topk(bed: Bed):
    out = routes.enumerate_paths(bed.jump, Params(path_fanout=8))
    return out.select("path_text", "flags", "jumps", "cve_run", "full_cve", "sessions_min")


# Six rounds of a trim, each with a walk of five, are beyond one SQL text: tests hold it against a brute force.
@query("route_view")
def route_view(bed: Bed):
    """Every entry to five hops, trimmed to the best hosts of each hop."""
    out = routes.route_view(bed.jump)
    return out.select("src", "dst", "hop", "src_kind", "rk_class", "dst_mark", "rk_total_hosts", "rk_shown_hosts", "rk_hidden_hosts")


_HOP = """vec AS (SELECT cve_id, max(CASE WHEN cvss_vector LIKE '%AV:N%PR:N%UI:N%C:H%' THEN 3 WHEN cvss_vector LIKE '%AV:N%' THEN 2 ELSE 0 END) FILTER (cvss_vector <> '') AS r, bool_or(cvss_vector LIKE '%AV:N%' OR cvss_vector LIKE '%AV:A%') FILTER (cvss_vector <> '') AS net FROM t_advisory GROUP BY cve_id),
tiers AS (SELECT cve_id, priority_tier FROM t_verdict),
hf AS (SELECT f.hostname, e.port, f.package, f.cve_id, coalesce(v.r, 1) AS r, CASE WHEN coalesce(v.r, 1) = 0 AND coalesce(v.net, false) THEN 1 ELSE 0 END AS down, coalesce(t.priority_tier, CASE f.severity WHEN 'critical' THEN 'P1' WHEN 'high' THEN 'P2' WHEN 'medium' THEN 'P3' ELSE 'P4' END) AS top, CAST(f.kev_added <> '' AS INT) AS kev
  FROM t_finding f JOIN (SELECT DISTINCT hostname, package, port FROM t_exposure) e ON e.hostname = f.hostname AND e.package = f.package LEFT JOIN vec v ON v.cve_id = f.cve_id LEFT JOIN tiers t ON t.cve_id = f.cve_id WHERE f.status = 'open'),
hc AS (SELECT hostname, concat(port) AS port, package, max(r) AS rk_rank, count(DISTINCT cve_id) AS rk_open, min(top) AS rk_top, max(kev) AS rk_kev, count(DISTINCT cve_id) FILTER (r = 3) AS rk_n_wire, count(DISTINCT cve_id) FILTER (r = 2) AS rk_n_foot, count(DISTINCT cve_id) FILTER (down > 0) AS rk_n_down,
  coalesce(string_agg(DISTINCT cve_id, ', ' ORDER BY cve_id) FILTER (r = 3), '') AS rk_wire_text FROM hf GROUP BY ALL)"""


def _hop_classes(bed: Bed):
    return routes.hop_class(bed.finding, bed.exposure, bed.advisory, bed.verdict)


@query("hop_class", f"WITH {_HOP} SELECT hostname, port, package, rk_rank, rk_open, rk_top, rk_kev, rk_n_wire, rk_n_foot, rk_n_down, rk_wire_text, CASE rk_rank WHEN 3 THEN 'cve' WHEN 2 THEN 'foothold' WHEN 1 THEN 'unrated' ELSE 'local' END AS rk_hop_class FROM hc")
def hop_class(bed: Bed):
    return _hop_classes(bed).drop("rk_foot_text")


@query("route_edges", f"""WITH {_HOP}, best AS (SELECT hostname, port, max(rk_rank) AS r FROM hc GROUP BY ALL),
en AS (SELECT unnest(string_split(coalesce(entry_text, 'entry point'), ' ')) AS src, hostname AS dst, 'entry' AS kind, concat(port) AS port, CAST(sessions AS DOUBLE) AS sessions FROM t_netevidence WHERE observed_grade IN ('confirmed observed', 'historically observed')),
ow AS (SELECT address, min(hostname) AS h FROM t_claim GROUP BY address HAVING count(DISTINCT hostname) = 1),
hh AS (SELECT a.h AS src, b.h AS dst, 'host' AS kind, concat(e.port) AS port, CAST(sum(e.sessions) AS DOUBLE) AS sessions FROM t_edge e JOIN ow a ON a.address = e.src_ip JOIN ow b ON b.address = e.dest_ip WHERE a.h <> b.h GROUP BY ALL),
u AS (SELECT * FROM en UNION ALL SELECT * FROM hh)
SELECT u.src, u.dst, u.kind, u.port, u.sessions, coalesce(best.r, 0) AS rk_rank FROM u LEFT JOIN best ON best.hostname = u.dst AND best.port = u.port""")
def route_edges(bed: Bed):
    claims = bed.claim.withColumn("claimants", F.lit(1))
    return routes.route_edges(bed.netevidence, bed.edge, claims, _hop_classes(bed)).select("src", "dst", "kind", "port", "sessions", "rk_rank")


@query("route_listeners", f"""WITH {_HOP}, bare AS (SELECT DISTINCT hostname, concat(port) AS port, package FROM t_exposure WHERE package IS NOT NULL),
a AS (SELECT b.hostname, b.port, b.package, coalesce(h.rk_rank, 0) AS rk_rank, coalesce(h.rk_open, 0) AS rk_open, coalesce(h.rk_n_wire, 0) AS w FROM bare b LEFT JOIN hc h ON h.hostname = b.hostname AND h.port = b.port AND h.package = b.package)
SELECT hostname, port, string_agg(package, ', ' ORDER BY package) AS packages, max(rk_rank) AS rk_rank, CAST(sum(rk_open) AS BIGINT) AS rk_open, CAST(sum(w) AS BIGINT) AS rk_n_wire FROM a WHERE hostname IN (SELECT dst FROM t_jump) GROUP BY ALL""")
def route_listeners(bed: Bed):
    out = routes.route_listeners(_hop_classes(bed), bed.exposure, bed.jump)
    return out.select("hostname", "port", "packages", "rk_rank", "rk_open", "rk_n_wire")


# --- ATT&CK -----------------------------------------------------------------

def advisories(bed: Bed):
    return bed.advisory.withColumn("cwes", F.array("cwe_a", "cwe_b"))


_CWE = "cw AS (SELECT DISTINCT cve_id, cwe FROM (SELECT cve_id, cwe_a AS cwe FROM t_advisory UNION ALL SELECT cve_id, cwe_b FROM t_advisory) z)"
_OPEN = "op AS (SELECT * FROM t_finding WHERE status = 'open' AND accepted <> '1')"
_OPENF = "status = 'open' and accepted <> '1'"
_TAC = "tac AS (SELECT DISTINCT * FROM (SELECT cwe, technique, technique_name, map_source, platforms, unnest(string_split(tactics, ',')) AS tactic FROM t_attack) z WHERE tactic <> '')"


@query("cwe_expand", f"WITH {_CWE}, {_OPEN} SELECT o.cve_id, cwe, count(*) AS findings, count(DISTINCT hostname) AS hosts, max(epss) AS epss FROM op o JOIN cw ON cw.cve_id = o.cve_id GROUP BY ALL")
def cwe_expand(bed: Bed):
    return attack.finding_cwes(bed.finding.filter(_OPENF), advisories(bed)).drop("packages")


@query("technique_surface_detail", f"WITH {_CWE}, {_OPEN} SELECT o.hostname, a.technique, a.technique_name, count(*) AS n, count(DISTINCT o.finding_key) AS findings FROM op o JOIN cw ON cw.cve_id = o.cve_id JOIN t_attack a ON a.cwe = cw.cwe GROUP BY ALL")
def technique_surface_detail(bed: Bed):
    cwes = attack.finding_cwes(bed.finding.filter(_OPENF), advisories(bed), per_cve=False)
    return attack.technique_counts(cwes, bed.attack)


@query("tactic_matrix", f"""WITH {_CWE}, {_OPEN}, {_TAC} SELECT o.cve_id, cw.cwe, t.technique, t.tactic, x.tactic_name, x.tactic_order FROM (SELECT DISTINCT cve_id FROM op) o JOIN cw ON cw.cve_id = o.cve_id JOIN tac t ON t.cwe = cw.cwe LEFT JOIN t_tactic x ON x.tactic = t.tactic""")
def tactic_matrix(bed: Bed):
    surface = attack.technique_surface(attack.finding_cwes(bed.finding.filter(_OPENF), advisories(bed)), bed.attack)
    return attack.tactic_matrix(surface, bed.tactic).select("cve_id", "cwe", "technique", "tactic", "tactic_name", "tactic_order")


_VEC = "vecs AS (SELECT cve_id, min(cvss_vector) AS v FROM t_advisory WHERE cvss_vector <> '' GROUP BY cve_id)"
_PERCVE = f"""{_TRIAGE}, {_CWE}, {_VEC}, pc AS (SELECT t.cve_id, max(rr) AS peak, count(DISTINCT hostname) AS n_hosts, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'low' END AS confidence, any_value(v.v) AS v,
  CASE max(rr) WHEN 3 THEN 'answers any address' WHEN 2 THEN 'answers one address' WHEN 1 THEN 'loopback only' WHEN 0 THEN 'no listening port' ELSE 'not assessed' END AS rc FROM tr2 t LEFT JOIN vecs v ON v.cve_id = t.cve_id GROUP BY t.cve_id)"""


def _placement_inputs(bed: Bed):
    cover = evidence.exposure_coverage(bed.exposure)
    return bed.finding.filter(_OPENF), evidence.reach(bed.exposure, NOW), cover


@query("attack_placement", f"""WITH {_PERCVE}, {_TAC}, branch AS (
  SELECT p.cve_id, n_hosts, rc, confidence, t.technique, t.technique_name, t.map_source, t.tactic FROM pc p JOIN cw ON cw.cve_id = p.cve_id JOIN tac t ON t.cwe = cw.cwe
  UNION ALL SELECT cve_id, n_hosts, rc, confidence, CASE WHEN v LIKE '%AV:N%PR:N/UI:N%' THEN 'T1190' WHEN v LIKE '%AV:N%UI:R%' THEN 'T1203' WHEN v LIKE '%AV:A%' THEN 'T1210' ELSE 'T1068' END,
    CASE WHEN v LIKE '%AV:N%PR:N/UI:N%' THEN 'Exploit Public-Facing Application' WHEN v LIKE '%AV:N%UI:R%' THEN 'Exploitation for Client Execution' WHEN v LIKE '%AV:A%' THEN 'Exploitation of Remote Services' ELSE 'Exploitation for Privilege Escalation' END, 'cvss_vector',
    CASE WHEN v LIKE '%AV:N%PR:N/UI:N%' THEN 'initial-access' WHEN v LIKE '%AV:N%UI:R%' THEN 'execution' WHEN v LIKE '%AV:A%' THEN 'lateral-movement' ELSE 'privilege-escalation' END FROM pc WHERE v IS NOT NULL
  UNION ALL SELECT cve_id, n_hosts, rc, confidence, 'T1190', 'Exploit Public-Facing Application', 'observed', 'initial-access' FROM pc WHERE peak >= 2),
b2 AS (SELECT * FROM branch UNION ALL SELECT cve_id, n_hosts, rc, confidence, technique, technique_name, 'any', tactic FROM branch)
SELECT b.technique, b.technique_name, x.tactic_name, x.tactic_order, b.map_source, b.rc AS reach_class, b.confidence, count(DISTINCT cve_id) AS cves, CAST(sum(n_hosts) AS BIGINT) AS hosts FROM b2 b JOIN t_tactic x ON x.tactic = b.tactic GROUP BY ALL""")
def attack_placement(bed: Bed):
    found, reach, cover = _placement_inputs(bed)
    return attack.attack_placement(found, reach, cover, advisories(bed), bed.attack, bed.tactic).drop("platforms")


@query("placement_ledger", f"""WITH {_PERCVE}, wk AS (SELECT cw.cve_id, max(CAST(a.map_source = 'capec' AS INT)) AS c, max(CAST(a.map_source = 'cwe_parent' AS INT)) AS i FROM cw LEFT JOIN t_attack a ON a.cwe = cw.cwe GROUP BY cw.cve_id),
f AS (SELECT p.confidence, coalesce(c, 0) AS c, coalesce(i, 0) AS i, CAST(coalesce(v LIKE '%AV:A%' OR v LIKE '%AV:N%', false) AS INT) AS v, CAST(peak >= 2 AS INT) AS o, CAST(w.cve_id IS NOT NULL AS INT) AS hc FROM pc p LEFT JOIN wk w ON w.cve_id = p.cve_id)
SELECT confidence, count(*) AS total_open_cves, count_if(c + i + v + o > 0) AS placed_any, count_if(c = 1) AS via_chain, count_if(c = 0 AND i = 1) AS only_inherited, count_if(c = 0 AND i = 0 AND v = 1) AS only_vector, count_if(c = 0 AND i = 0 AND v = 0 AND o = 1) AS only_observed,
  count_if(hc = 0) AS no_cwe_at_all, count(*) - count_if(c + i + v + o > 0) AS unplaced FROM f GROUP BY confidence""")
def placement_ledger(bed: Bed):
    found, reach, cover = _placement_inputs(bed)
    return attack.attack_ledger(found, reach, cover, advisories(bed), bed.attack)


_KEVMAP = """SELECT concat('CVE-2024-', 10000 + CAST(floor(p_partkey * 3 / 4) AS BIGINT) * 4 + p_partkey % 4) AS cve_id, concat('T', p_size) AS technique, concat('Name ', p_size) AS technique_name,
  CASE p_partkey % 4 WHEN 0 THEN 'exploitation_technique' WHEN 1 THEN 'primary_impact' WHEN 2 THEN 'secondary_impact' ELSE 'x' END AS mapping_type, 'c' AS comment FROM b_part"""


@query("kev_bridge", f"""WITH {_OPEN}, km AS ({_KEVMAP}), mp AS (SELECT DISTINCT cve_id, technique, mapping_type FROM km UNION ALL SELECT DISTINCT cve_id, 'T1486', 'ransomware_implication' FROM t_advisory WHERE lower(kev_ransomware) = 'known')
SELECT o.finding_key, m.technique, CASE m.mapping_type WHEN 'exploitation_technique' THEN 'exploitation' WHEN 'primary_impact' THEN 'impact' WHEN 'secondary_impact' THEN 'impact-secondary' WHEN 'ransomware_implication' THEN 'implied' ELSE 'other' END AS map_role,
  CASE m.mapping_type WHEN 'exploitation_technique' THEN 'recorded' WHEN 'ransomware_implication' THEN 'implied' ELSE 'recorded-impact' END AS map_strength FROM op o JOIN mp m ON m.cve_id = o.cve_id""")
def kev_bridge(bed: Bed):
    return attack.kev_bridge(bed.finding.filter(_OPENF), bed.sql(_KEVMAP), bed.advisory).select("finding_key", "technique", "map_role", "map_strength")


_CAPEC = "SELECT DISTINCT concat(p_size % 20) AS capec, concat('Pattern ', p_size % 20) AS name, 'Detailed' AS abstraction, 'High' AS severity, 'Low' AS likelihood, '' AS prerequisites, '' AS first_step FROM b_part WHERE p_size % 3 <> 0"


@query("attack_patterns", f"""WITH {_CWE}, {_OPEN}, cp AS ({_CAPEC}), s AS (SELECT DISTINCT o.cve_id, cw.cwe, a.technique, unnest(list_distinct(string_split(a.via_capec, ','))) AS capec FROM (SELECT DISTINCT cve_id FROM op) o JOIN cw ON cw.cve_id = o.cve_id JOIN t_attack a ON a.cwe = cw.cwe)
SELECT s.cve_id, s.cwe, s.technique, s.capec, cp.name AS capec_name FROM s JOIN cp ON cp.capec = s.capec""")
def attack_patterns(bed: Bed):
    surface = attack.technique_surface(attack.finding_cwes(bed.finding.filter(_OPENF), advisories(bed)), bed.attack)
    return attack.attack_patterns(surface, bed.sql(_CAPEC)).select("cve_id", "cwe", "technique", "capec", "capec_name")


_MITI = "SELECT DISTINCT concat('T1', lpad(CAST(p_size % 40 AS VARCHAR(8)), 3, '0')) AS technique, concat('M', p_partkey % 12) AS mitigation, concat('Mitigation ', p_partkey % 12) AS mitigation_name, concat('d', p_size % 2) AS description FROM b_part"


@query("mitigation_coverage", f"""WITH {_PERCVE}, mi AS ({_MITI}) SELECT mi.mitigation, mi.mitigation_name, p.rc AS reach_class, count(DISTINCT a.technique) AS techniques, count(DISTINCT p.cve_id) AS cves FROM pc p JOIN cw ON cw.cve_id = p.cve_id JOIN t_attack a ON a.cwe = cw.cwe JOIN mi ON mi.technique = a.technique GROUP BY ALL""")
def mitigation_coverage(bed: Bed):
    return attack.mitigation_coverage(triaged(bed), advisories(bed), bed.attack, bed.sql(_MITI)).drop("description")


@query("cve_facts", """SELECT cve_id, arg_min(title, (-length(title), title)) AS best_title, max(cvss_score) AS cvss_score, coalesce(min(nullif(severity, '')), '') AS severity, coalesce(min(nullif(cvss_vector, '')), '') AS cvss_vector, max(epss) AS epss,
  coalesce(min(nullif(kev_added, '')), '') AS kev_added, min(published) AS published FROM t_advisory GROUP BY cve_id""")
def cve_facts(bed: Bed):
    return attack.cve_facts(bed.advisory).select("cve_id", "best_title", "cvss_score", "severity", "cvss_vector", "epss", "kev_added", "published")


@query("cve_search", """WITH d AS (SELECT DISTINCT cve_id, title AS products FROM t_advisory), f AS (SELECT cve_id, max(cvss_score) AS cvss_score, max(epss) AS epss, coalesce(min(nullif(severity, '')), '') AS severity, coalesce(min(nullif(kev_added, '')), '') AS k FROM t_advisory GROUP BY cve_id),
one AS (SELECT cve_id, min(products) AS products FROM d GROUP BY cve_id)
SELECT o.cve_id, o.products AS product, f.severity, f.cvss_score, round(f.epss * 100, 1) AS epss_pct, CASE WHEN f.k <> '' THEN 'yes' ELSE '' END AS kev FROM one o JOIN f ON f.cve_id = o.cve_id WHERE lower(o.products) LIKE '%product 1%'""")
def cve_search(bed: Bed):
    detail = bed.advisory.groupBy("cve_id").agg(F.min("title").alias("products")).withColumn("description", F.lit(""))
    return attack.search_cves(detail, bed.advisory, "Product 1")


@query("cve_fixes", """SELECT cve_id, ecosystem, package, trim(concat(distro, ' ', distro_release)) AS distribution, string_agg(DISTINCT fx, '; ' ORDER BY fx) AS fixed, string_agg(DISTINCT it, '; ' ORDER BY it) AS introduced
FROM (SELECT *, CASE WHEN fixed <> '' THEN fixed WHEN last_affected <> '' THEN concat('no fix; last affected ', last_affected) ELSE 'no fix published' END AS fx, CASE WHEN introduced = '' THEN 'any earlier version' ELSE introduced END AS it FROM t_range) GROUP BY ALL""")
def cve_fixes(bed: Bed):
    return attack.cve_fixes(bed.range)


@query("cve_fix_graph", """WITH e AS (SELECT cve_id AS source, 'cve' AS source_kind, concat(ecosystem, ' ', package) AS target, 'pkg' AS target_kind FROM t_range WHERE fixed <> '' UNION ALL
SELECT concat(ecosystem, ' ', package), 'pkg', concat(package, ' ', fixed, CASE WHEN distro = '' THEN '' ELSE concat(' (', distro, ')') END), 'fix' FROM t_range WHERE fixed <> '') SELECT source, source_kind, target, target_kind, count(*) AS cves FROM e GROUP BY ALL""")
def cve_fix_graph(bed: Bed):
    return attack.fix_graph(bed.range)


@query("cvss_letters", """SELECT advisory_id, nullif(regexp_extract(cvss_vector, 'AV:([NALP])', 1), '') AS av, nullif(regexp_extract(cvss_vector, 'PR:([NLH])', 1), '') AS pr, nullif(regexp_extract(cvss_vector, '/C:([NLH])', 1), '') AS c FROM t_advisory""")
def cvss_letters_query(bed: Bed):
    letters = cvss_letters(F.col("cvss_vector"))
    return bed.advisory.select("advisory_id", *[letters[k].alias(k) for k in ("av", "pr", "c")])


# --- priority ---------------------------------------------------------------

_SCORES = "sc AS (SELECT cve_id, max(cvss_score) AS cvss, coalesce(min(title) FILTER (length(title) > 60), min(title)) AS adv_title FROM t_advisory GROUP BY cve_id)"
_INPUT = f"""{_REACH}, {_SCORES}, inp AS (SELECT f.*, s.cvss, s.adv_title, f.kev_added <> '' AS kev, CASE f.confidence WHEN 'high' THEN 'yes' WHEN 'informational' THEN 'no' ELSE 'unknown' END AS vm,
  CASE WHEN coalesce(r.reach_rank, -9) >= 3 THEN 'internet-facing' ELSE 'internal' END AS zone FROM t_finding f LEFT JOIN reach r ON r.hostname = f.hostname AND r.rk_key = CASE WHEN f.scope_id LIKE 'container:%' THEN concat('container:', substr(f.scope_id, 11, 12)) ELSE f.package END
  LEFT JOIN sc s ON s.cve_id = f.cve_id WHERE f.status = 'open' AND f.accepted <> '1'),
t0 AS (SELECT *, CASE WHEN coalesce(cvss, 0) < 4 AND coalesce(epss, 0) * 1000 < 50 AND NOT kev AND zone <> 'internet-facing' AND vm = 'no' THEN 'P4' WHEN kev AND zone = 'internet-facing' AND vm = 'yes' AND coalesce(cvss, 0) >= 7 THEN 'P0' END AS t0,
  CASE WHEN coalesce(epss, 0) < 0.01 THEN '0' WHEN epss < 0.05 THEN '1' WHEN epss < 0.2 THEN '2' WHEN epss < 0.5 THEN '3' ELSE '4' END AS eb, CASE WHEN cvss IS NULL THEN '' WHEN cvss < 4 THEN '0' WHEN cvss < 7 THEN '1' WHEN cvss < 9 THEN '2' ELSE '3' END AS cb FROM inp)"""


def _inputs(bed: Bed):
    return priority.scored_inputs(bed.finding.filter(_OPENF), evidence.reach(bed.exposure, NOW), bed.advisory, Params())


@query("t0_rules", f"WITH {_INPUT} SELECT finding_key, zone AS exposure_zone, vm AS version_match, t0 AS t0_tier FROM t0")
def t0_rules(bed: Bed):
    return _inputs(bed).select("finding_key", "exposure_zone", "version_match", "t0_tier")


@query("score_tier", f"""WITH {_INPUT}, p AS (SELECT finding_key, greatest(0, least(100, CASE WHEN kev THEN 45 ELSE 0 END + CASE eb WHEN '0' THEN 0 WHEN '1' THEN 8 WHEN '2' THEN 20 WHEN '3' THEN 30 ELSE 40 END + CASE cb WHEN '1' THEN 8 WHEN '2' THEN 16 WHEN '3' THEN 22 ELSE 0 END
  + CASE zone WHEN 'internet-facing' THEN 25 ELSE 8 END + CASE vm WHEN 'yes' THEN 22 WHEN 'unknown' THEN 4 ELSE -25 END)) AS score FROM t0)
SELECT finding_key, score, CASE WHEN score >= 85 THEN 'P0' WHEN score >= 65 THEN 'P1' WHEN score >= 45 THEN 'P2' WHEN score >= 25 THEN 'P3' ELSE 'P4' END AS tier FROM p""")
def score_tier(bed: Bed):
    score = priority.priority_score(F.col("is_kev"), F.col("epss"), F.col("cvss_score"), F.col("exposure_zone"), F.col("version_match"))
    return _inputs(bed).withColumn("score", score).select("finding_key", "score", priority.tier(F.col("score")).alias("tier"))


_SIG = "md5(concat('v2:foundation-sec-8b|', cve_id, '|', lower(coalesce(severity, '')), '|', CASE WHEN kev THEN '1' ELSE '0' END, '|', cb, '|', eb, '|', coalesce(adv_title, title, '')))"
_QUEUE = f"""{_INPUT}, sg AS (SELECT *, {_SIG} AS sig FROM t0 WHERE t0 IS NULL), q1 AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY kev DESC, coalesce(epss, 0) DESC, hostname, finding_key) = 1)"""


@query("verdict_signature", f"WITH {_INPUT} SELECT finding_key, {_SIG} AS sig FROM t0")
def verdict_signature(bed: Bed):
    sig = priority.signature(Params().signature_salt, F.col("cve_id"), F.col("severity"), F.col("is_kev"), F.col("cvss_score"), F.col("epss"), F.coalesce("adv_title", "title"))
    return _inputs(bed).select("finding_key", sig.alias("sig"))


def _queue(bed: Bed):
    # Half of the cached verdicts carry the signature the queue computes, so both answers occur.
    sig = priority.signature(Params().signature_salt, F.col("cve_id"), F.col("severity"), F.col("is_kev"), F.col("cvss_score"), F.col("epss"), F.coalesce("adv_title", "title"))
    cached = _inputs(bed).filter("severity = 'high'").select("cve_id", sig.alias("sig")).distinct()
    none = bed.spark.createDataFrame([], "package string, vendor string")
    return priority.candidate_queue(bed.finding.filter(_OPENF), evidence.reach(bed.exposure, NOW), bed.advisory, none, cached)


@query("candidate_queue", f"""WITH {_QUEUE}, cached AS (SELECT DISTINCT cve_id, {_SIG} AS sig FROM t0 WHERE severity = 'high')
SELECT cve_id, sig, hostname AS worst_asset, package AS affected_product, zone AS exposure_zone FROM q1 WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.cve_id = q1.cve_id AND c.sig = q1.sig)""")
def candidate_queue(bed: Bed):
    return _queue(bed).select("cve_id", "sig", "worst_asset", "affected_product", "exposure_zone")


@query("verdict_triage", f"""WITH {_QUEUE}, cached AS (SELECT DISTINCT cve_id, {_SIG} AS sig FROM t0 WHERE severity = 'low'), hq AS (SELECT DISTINCT cve_id, {_SIG} AS sig FROM t0 WHERE severity = 'high'),
q AS (SELECT q1.*, c.sig IS NOT NULL AS hit FROM (SELECT * FROM q1 WHERE NOT EXISTS (SELECT 1 FROM hq WHERE hq.cve_id = q1.cve_id AND hq.sig = q1.sig)) q1 LEFT JOIN cached c ON c.cve_id = q1.cve_id AND c.sig = q1.sig)
SELECT cve_id, CASE WHEN hit THEN 'cache' WHEN row_number() OVER (PARTITION BY hit ORDER BY kev DESC, epss DESC NULLS LAST, cve_id) <= 50 THEN 'analyse' ELSE 'deferred' END AS route FROM q""")
def verdict_triage(bed: Bed):
    sig = priority.signature(Params().signature_salt, F.col("cve_id"), F.col("severity"), F.col("is_kev"), F.col("cvss_score"), F.col("epss"), F.coalesce("adv_title", "title"))
    cached = _inputs(bed).filter("severity = 'low'").select("cve_id", sig.alias("sig")).distinct()
    return priority.triage_verdicts(_queue(bed), cached, 50).select("cve_id", "route")


_EXPAND = f"""{_INPUT}, ex AS (SELECT i.*, v.priority_tier AS vt, v.priority_score AS vs, v.analysed_at AS va FROM t0 i LEFT JOIN t_verdict v ON v.cve_id = i.cve_id),
ex2 AS (SELECT *, CASE WHEN t0 = 'P0' THEN 95 WHEN t0 = 'P4' THEN 10 ELSE least(greatest(coalesce(vs, 50) + CASE zone WHEN 'internal' THEN -5 ELSE 0 END + CASE vm WHEN 'yes' THEN 10 WHEN 'unknown' THEN -5 ELSE -25 END, 0), 100) END AS score,
  CAST(t0 IS NOT NULL OR (vt IS NOT NULL AND va >= 1005000000 - 604800) AS INT) AS scored FROM ex),
ex3 AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN t0 WHEN score >= 85 THEN 'P0' WHEN score >= 65 THEN 'P1' WHEN score >= 45 THEN 'P2' WHEN score >= 25 THEN 'P3' ELSE 'P4' END AS tier FROM ex2)"""
_FACTS = f"""{_LOADED}, {_SUPPORT}, eol1 AS (SELECT hostname, name, path, min(support) AS support FROM support GROUP BY ALL),
fc AS (SELECT x.*, coalesce(r.reach_rank, 0) AS rr, CASE WHEN l.load_rank IS NOT NULL THEN l.load_rank WHEN x.ecosystem IN ('deb', 'rpm', 'apk', 'binary', 'windows') THEN 1 ELSE 0 END AS lr, coalesce(e.support, '') AS sup, CAST(x.fixed_version <> '' AS INT) AS fx
  FROM ex3 x LEFT JOIN reach r ON r.hostname = x.hostname AND r.rk_key = CASE WHEN x.scope_id LIKE 'container:%' THEN concat('container:', substr(x.scope_id, 11, 12)) ELSE x.package END
  LEFT JOIN loaded l ON l.hostname = x.hostname AND l.package = x.package AND x.scope_id = '' LEFT JOIN eol1 e ON e.hostname = x.hostname AND e.name = x.package AND e.path = x.path)"""
_RULES = {"listener_loads_the_library": "esc_load_rank = 3 AND esc_reach_rank < 2", "no_supported_release_no_fix": "esc_eol_support = 'no supported release' AND esc_has_fix = 0"}
_R1, _R2 = "(lr = 3 AND rr < 2)", "(sup = 'no supported release' AND fx = 0)"


def _fact_tables(bed: Bed):
    eol = support(bed).groupBy("hostname", "package", "path").agg(F.min("support").alias("support"))
    return evidence.reach(bed.exposure, NOW), evidence.exposure_coverage(bed.exposure), _loaded(bed), _links(bed), eol


@query("expand_verdicts", f"""WITH {_EXPAND}, {_FACTS}, z AS (SELECT *, ({_R1} OR {_R2}) AND t0 IS NULL AND tier IN ('P2', 'P3', 'P4') AS esc FROM fc WHERE scored = 1)
SELECT finding_key, tier AS deterministic_tier, CAST(esc AS INT) AS escalated, CASE WHEN NOT esc THEN tier WHEN tier = 'P2' THEN 'P1' WHEN tier = 'P3' THEN 'P2' ELSE 'P3' END AS priority_tier,
  CASE WHEN NOT esc THEN score WHEN tier = 'P2' THEN greatest(score, 65) WHEN tier = 'P3' THEN greatest(score, 45) ELSE greatest(score, 25) END AS priority_score, count(DISTINCT hostname) OVER (PARTITION BY cve_id) AS cve_asset_count FROM z""")
def expand_verdicts(bed: Bed):
    reach, cover, loaded, links, eol = _fact_tables(bed)
    out = priority.expand_verdicts(bed.finding.filter(_OPENF), bed.verdict, reach, cover, loaded, links, eol, bed.advisory, NOW, _RULES)
    return out.select("finding_key", "deterministic_tier", "escalated", "priority_tier", "priority_score", "cve_asset_count")


@query("escalation_replay", f"""WITH {_EXPAND}, {_FACTS}, hits AS (SELECT *, 'listener_loads_the_library' AS rule FROM fc WHERE {_R1} UNION ALL SELECT *, 'no_supported_release_no_fix' FROM fc WHERE {_R2})
SELECT rule, 'no' AS enabled, CASE WHEN scored = 1 THEN tier ELSE 'unscored' END AS from_tier, CASE WHEN scored = 1 AND t0 IS NULL AND tier IN ('P2', 'P3', 'P4') THEN CASE tier WHEN 'P2' THEN 'P1' WHEN 'P3' THEN 'P2' ELSE 'P3' END ELSE 'no change' END AS to_tier,
  count(*) AS findings, count(DISTINCT hostname) AS hosts, count(DISTINCT cve_id) AS cves FROM hits GROUP BY ALL""")
def escalation_replay(bed: Bed):
    reach, cover, loaded, links, eol = _fact_tables(bed)
    rows = priority.score_findings(bed.finding.filter(_OPENF), bed.verdict, reach, bed.advisory, NOW)
    facts = priority.escalation_facts(rows, reach, cover, loaded, links, eol, bed.advisory)
    return priority.replay_rules(facts, _RULES)


@query("rule_mutation", f"""WITH {_EXPAND}, {_FACTS} SELECT 'listener_loads_the_library' AS rule, 'esc_load_rank' AS fact, count(*) FILTER ({_R1}) AS fired, CAST(0 AS BIGINT) AS fired_without FROM fc
UNION ALL SELECT 'no_supported_release_no_fix', 'esc_eol_support', count(*) FILTER ({_R2}), 0 FROM fc""")
def rule_mutation(bed: Bed):
    """How often a rule fires, and how often once the fact it is about is unknown."""
    reach, cover, loaded, links, eol = _fact_tables(bed)
    rows = priority.score_findings(bed.finding.filter(_OPENF), bed.verdict, reach, bed.advisory, NOW)
    facts = priority.escalation_facts(rows, reach, cover, loaded, links, eol, bed.advisory)
    # Both rules and both mutations read the same measured facts, so these are measured once.
    facts = written(facts.select(*priority.FACTS), "facts")

    def fired(rule: str, fact: str):
        both = priority.mutate(facts.withColumn("_fired", F.expr(_RULES[rule])), fact)
        return both.agg(F.count_if("_fired").alias("fired"), F.count_if(F.expr(_RULES[rule])).alias("fired_without")).select(
            F.lit(rule).alias("rule"), F.lit(fact).alias("fact"), "fired", "fired_without")

    return fired("listener_loads_the_library", "esc_load_rank").unionByName(fired("no_supported_release_no_fix", "esc_eol_support"))


_RESULTS = """SELECT o_orderkey, concat('CVE-', o_custkey) AS cve_id, concat('host-', o_orderkey % 50) AS asset_id, concat('run-', o_orderkey % 4) AS run_id, CAST(1000000 + (o_orderkey % 4) * 1000 + o_orderkey % 3 AS BIGINT) AS result_at,
  concat('P', o_orderkey % 5) AS priority_tier, CAST(o_orderkey % 100 AS INT) AS priority_score, CAST(o_orderkey % 8 = 0 AS INT) AS escalated, concat('rule', o_orderkey % 3) AS escalation_rules,
  CASE o_orderkey % 6 WHEN 0 THEN 'deferred' WHEN 1 THEN 'T2' WHEN 2 THEN 'fallback' WHEN 3 THEN 'cache' WHEN 4 THEN 'T0' ELSE 'T2' END AS analysis_source, CAST(o_orderkey AS BIGINT) AS analysed_at FROM b_orders"""


@query("latest_results", f"""WITH r AS ({_RESULTS}), k AS (SELECT * FROM r QUALIFY result_at >= max(result_at) OVER (PARTITION BY run_id) - 1)
SELECT cve_id, asset_id, arg_max(priority_tier, (result_at, priority_tier)) AS priority_tier, arg_max(priority_score, (result_at, priority_score)) AS priority_score, max(result_at) AS analysed_at FROM k GROUP BY ALL""")
def latest_results(bed: Bed):
    return priority.latest_results(bed.sql(_RESULTS)).select("cve_id", "asset_id", "priority_tier", "priority_score", "analysed_at")


@query("rescoring_guard", f"""WITH r AS ({_RESULTS}) SELECT count(*) AS findings, count_if(escalated = 1) AS bumped, count_if(priority_tier IN ('P0', 'P1')) AS alerting, count_if(escalated = 1 AND priority_tier IN ('P0', 'P1')) AS alerting_bumped,
  string_agg(DISTINCT CASE WHEN escalated = 1 THEN escalation_rules END, '; ' ORDER BY CASE WHEN escalated = 1 THEN escalation_rules END) AS rules_firing, round(100.0 * count_if(escalated = 1) / count(*), 1) AS bumped_share,
  round(100.0 * count_if(escalated = 1 AND priority_tier IN ('P0', 'P1')) / count_if(priority_tier IN ('P0', 'P1')), 1) AS alerting_bumped_share FROM r""")
def rescoring_guard(bed: Bed):
    return priority.rescoring_guard(bed.sql(_RESULTS))


@query("run_tally", f"""WITH r AS ({_RESULTS}) SELECT count(*) AS rows, count_if(analysis_source = 'deferred') AS deferred, count_if(analysis_source = 'T2') AS model_calls, count_if(analysis_source = 'fallback') AS fallbacks, count_if(analysis_source = 'cache') AS cache_hits,
  count_if(analysis_source IN ('T2', 'fallback', 'cache')) AS verdicts, count_if(analysis_source = 'T0') AS unclassified FROM r""")
def run_tally(bed: Bed):
    return priority.run_tally(bed.sql(_RESULTS))


@query("priority_overview", f"""WITH r AS ({_RESULTS}), {_OPEN}, b AS (SELECT cve_id, CASE WHEN coalesce(epss, 0) < 0.01 THEN 0 WHEN epss < 0.05 THEN 1 WHEN epss < 0.2 THEN 2 WHEN epss < 0.5 THEN 3 ELSE 4 END AS k FROM op)
SELECT count(*) AS findings, count(DISTINCT cve_id) AS cves, count(DISTINCT asset_id) AS assets, count_if(priority_tier = 'P0') AS p0, count_if(priority_tier = 'P1') AS p1, count_if(priority_tier = 'P4') AS p4,
  (SELECT count(DISTINCT cve_id) FROM b WHERE k = 0) AS sea_0, (SELECT count(DISTINCT cve_id) FROM b WHERE k = 2) AS sea_2, (SELECT count(DISTINCT cve_id) FROM b WHERE k = 4) AS sea_4 FROM r""")
def priority_overview(bed: Bed):
    return priority.overview(bed.sql(_RESULTS), bed.finding.filter(_OPENF), NOW).select("findings", "cves", "assets", "p0", "p1", "p4", "sea_0", "sea_2", "sea_4")


@query("priority_alerts", f"WITH r AS ({_RESULTS}) SELECT o_orderkey, priority_tier FROM r WHERE priority_tier IN ('P0', 'P1')")
def priority_alerts(bed: Bed):
    return priority.alerts(bed.sql(_RESULTS)).select("o_orderkey", "priority_tier")


@query("dead_verdicts", "SELECT cve_id, sig FROM t_verdict WHERE cve_id IN (SELECT cve_id FROM t_finding WHERE status = 'open')")
def dead_verdicts(bed: Bed):
    return priority.drop_dead_verdicts(bed.verdict, bed.finding).select("cve_id", "sig")


_ANSWERS = """SELECT conv_id, turn, concat('{"priority_tier": "P', conv_id % 7, '", "priority_score": ', conv_id % 130, ', "confidence": 0.', turn % 10, ', "rationale": "', CASE WHEN conv_id % 6 = 0 THEN '' ELSE 'It is reachable' END,
  '", "exploitability_signal": "', CASE WHEN conv_id % 4 = 0 THEN 'theoretical' ELSE 'none' END, '", "exposure_signal": "internal", "process_match_confidence": "confirmed", "recommended_action": "', CASE WHEN turn % 5 = 4 THEN 'panic' ELSE 'monitor' END,
  '", "attck_techniques": ["T1190", "T12", "T1059.001"]}') AS answer FROM b_conversations"""


@query("validate_verdicts", f"""WITH a AS ({_ANSWERS}) SELECT conv_id, turn, CASE WHEN conv_id % 7 > 4 THEN 'priority_tier must be one of P0|P1|P2|P3|P4' WHEN conv_id % 130 > 100 THEN 'priority_score out of range' WHEN conv_id % 6 = 0 THEN 'rationale missing'
  WHEN turn % 5 = 4 THEN 'recommended_action must be one of patch-now|mitigate|monitor|accept|risk-accept-with-compensation' END AS problem, 'T1190,T1059.001' AS techniques FROM a""")
def validate_verdicts(bed: Bed):
    out = priority.validate_verdicts(bed.sql(_ANSWERS))
    return out.select("conv_id", "turn", "problem", F.array_join("attck_techniques", ",").alias("techniques"))


_GROUND = """SELECT conv_id, turn, concat(CASE conv_id % 4 WHEN 0 THEN 'It is internet-facing. ' WHEN 1 THEN 'It is not internet-facing. ' WHEN 2 THEN 'Never seen from the internet, yet the box, which has run for a long while, is publicly exposed. ' ELSE '' END, 'See turn ', turn) AS rationale,
  CASE turn % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'isolated' ELSE 'internet-facing' END AS exposure_zone, CASE WHEN conv_id % 3 = 0 THEN 'internet-facing' ELSE 'internal' END AS exposure_signal, CASE WHEN conv_id % 5 = 0 THEN 'no' ELSE 'yes' END AS version_match, 'confirmed' AS process_match_confidence,
  CASE WHEN turn % 2 = 0 THEN 'active-exploit' ELSE 'none' END AS exploitability_signal, conv_id % 2 = 0 AS is_kev FROM b_conversations"""
_FLAGS = f"""g AS ({_GROUND}), fl AS (SELECT conv_id, turn, list_filter([CASE WHEN exposure_zone <> 'internet-facing' AND exposure_signal = 'internet-facing' THEN 'exposure_signal contradicts the measured exposure zone' END,
  CASE WHEN exposure_zone <> 'internet-facing' AND conv_id % 4 IN (0, 2) THEN 'the rationale calls this internet-facing and the measurement does not' END, CASE WHEN version_match = 'no' THEN 'calls the process match confirmed where the installed version is NOT in the affected range' END,
  CASE WHEN is_kev AND exploitability_signal = 'none' THEN 'calls a KEV-listed CVE unexploited' END, CASE WHEN NOT is_kev AND exploitability_signal = 'active-exploit' THEN 'claims active exploitation with no KEV entry in evidence' END], lambda x: x IS NOT NULL) AS flags FROM g)"""


@query("grounding_flags", f"WITH {_FLAGS} SELECT conv_id, turn, array_to_string(flags, '; ') AS flags FROM fl")
def grounding_flags(bed: Bed):
    return priority.grounding_flags(bed.sql(_GROUND)).select("conv_id", "turn", F.array_join("grounding", "; ").alias("flags"))


@query("grounding_rate", f"WITH {_FLAGS} SELECT reason, count(*) AS n, (SELECT count(*) FROM fl) AS checked, (SELECT count(*) FROM fl WHERE len(flags) > 0) AS flagged FROM (SELECT unnest(flags) AS reason FROM fl) GROUP BY reason")
def grounding_rate(bed: Bed):
    return priority.grounding_rate(priority.grounding_flags(bed.sql(_GROUND)))


# --- roll-ups ---------------------------------------------------------------

@query("rollup_host", f"""WITH {_OPEN} SELECT o.hostname, count(*) AS findings, count(DISTINCT cve_id) AS cves, count_if(kev_added <> '') AS kev, count_if(first_found >= 1005000000 - 604800) AS new_7d, max(epss) AS top_epss, any_value(coalesce(a.n, 0)) AS accepted FROM op o
LEFT JOIN (SELECT hostname, count(*) AS n FROM t_finding WHERE status = 'open' AND accepted = '1' GROUP BY hostname) a ON a.hostname = o.hostname GROUP BY o.hostname""")
def rollup_host(bed: Bed):
    return rollups.rollup_host(bed.finding, NOW).drop("rolled_at")


_LONG = f"""{_OPEN}, long AS (SELECT unnest([struct_pack(dim := 'package', value := package), struct_pack(dim := 'confidence', value := confidence), struct_pack(dim := 'severity', value := coalesce(severity, 'unrated')), struct_pack(dim := 'ecosystem', value := ecosystem),
  struct_pack(dim := 'root', value := CASE WHEN scope_id <> '' THEN scope_id ELSE 'host' END)]) AS p, hostname, cve_id, package, epss, age_days FROM op)"""


@query("rollup_dim", f"""WITH {_LONG} SELECT p.dim AS dim, p.value AS value, count(*) AS findings, count(DISTINCT cve_id) AS cves, count(DISTINCT hostname) AS hosts, max(epss) AS top_epss, min(age_days) AS age_lo, round(quantile_cont(age_days, 0.25), 3) AS age_q1, round(quantile_cont(age_days, 0.5), 3) AS age_med,
  round(quantile_cont(age_days, 0.75), 3) AS age_q3, max(age_days) AS age_hi FROM long GROUP BY ALL""")
def rollup_dim(bed: Bed):
    return rollups.rollup_dim(bed.finding).withColumns({c: F.round(c, 3) for c in ("age_q1", "age_med", "age_q3")})


@query("rollup_host_dim", f"WITH {_LONG} SELECT hostname, p.dim AS dim, p.value AS value, count(*) AS findings, count(DISTINCT cve_id) AS cves, count(DISTINCT package) AS packages, max(epss) AS top_epss FROM long WHERE p.dim <> 'package' GROUP BY ALL")
def rollup_host_dim(bed: Bed):
    return rollups.rollup_host_dim(bed.finding)


@query("rollup_cve", f"""WITH {_OPEN} SELECT cve_id, count(*) AS findings, count(DISTINCT hostname) AS hosts, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, max(epss) AS top_epss, min(severity) AS severity, min(kev_added) AS kev_added, arg_min(title, (length(title), title)) AS title FROM op GROUP BY cve_id""")
def rollup_cve(bed: Bed):
    return rollups.rollup_cve(bed.finding).withColumn("packages", F.array_join("packages", ",")).drop("kev_due")


_KEPT: dict = {}


def kept_rollups(bed: Bed):
    """A store whose roll-ups followed the findings from an earlier state, by changes and deletions, to today's; made once a session."""
    session = (bed.spark.sparkContext.applicationId, bed.folder)
    if session in _KEPT:
        return _KEPT[session]
    store, today = scratch_store(bed.spark, "rollups"), written(bed.finding, "findings")
    earlier = today.filter("times_seen < 4").withColumns({
        "status": F.lit("open"), "accepted": F.lit("0"), "severity": F.lit("low"), "title": F.lit("Flaw"), "age_days": F.col("age_days") - 1})
    since_gone = today.filter("kev_added <> ''").withColumn("finding_key", F.concat(F.lit("old-"), "finding_key"))
    store.upsert_state(earlier.unionByName(since_gone), "findings_state", ["finding_key"])
    rollup_state.roll_up(store, NOW - 86400)
    changes = store.changes("findings_state", ["finding_key"], "today")
    changes.upsert(today)
    changes.delete(since_gone)
    changes.commit()
    rollup_state.roll_up(store, NOW)
    _KEPT[session] = store
    return store


def _kept(name: str, of: str, rows):
    from vulnspark.plans.queries.registry import ORACLES, QUERIES

    query(name)(lambda bed: rows(kept_rollups(bed)))
    ORACLES[name] = ORACLES[of]


_kept("rollup_host_kept", "rollup_host", lambda store: rollup_changes.host_view(store.read_state("openstate_host"), NOW).drop("rolled_at"))
_kept("rollup_dim_kept", "rollup_dim", lambda store: store.read_state("openstate_dim").withColumns({c: F.round(c, 3) for c in ("age_q1", "age_med", "age_q3")}))
_kept("rollup_host_dim_kept", "rollup_host_dim", lambda store: store.read_state("openstate_host_dim"))
_kept("rollup_cve_kept", "rollup_cve", lambda store: store.read_state("openstate_cve").withColumn("packages", F.array_join("packages", ",")).drop("kev_due"))


@query("host_overview", f"""WITH {_OPEN}, r AS (SELECT hostname, count(*) AS n, count(DISTINCT cve_id) AS c, count_if(kev_added <> '') AS k, max(epss) AS e FROM op GROUP BY hostname)
SELECT h.hostname, h.os, h.s_suppkey AS n_components, CASE WHEN r.n IS NULL THEN 'not counted yet' ELSE concat(r.n) END AS findings, CASE WHEN r.n IS NULL THEN '' ELSE concat(r.c) END AS cves, coalesce(r.k, 0) AS kev, round(r.e * 100, 1) AS top_epss_pct FROM t_host h LEFT JOIN r ON r.hostname = h.hostname""")
def host_overview(bed: Bed):
    matched = bed.host.select("hostname", F.col("s_suppkey").alias("n_components"))
    rolled = rollups.rollup_host(bed.finding, NOW)
    return rollups.host_overview(bed.host, matched, rolled, NOW).select("hostname", "os", "n_components", "findings", "cves", "kev", "top_epss_pct")


@query("subtotal_rows", "SELECT hostname, status, count(*) AS n FROM t_finding GROUP BY ALL UNION ALL SELECT '__fleet__', status, count(*) FROM t_finding GROUP BY status")
def subtotal_rows(bed: Bed):
    per = bed.finding.groupBy("hostname", "status").agg(F.count(F.lit(1)).alias("n"))
    return subtotal(per, ["status"], {"hostname": "__fleet__"}, F.sum("n").alias("n"))


@query("salted_join_totals", "SELECT f.severity, count(*) AS n, count(DISTINCT h.os) AS systems FROM t_finding f JOIN t_host h ON h.hostname = f.hostname GROUP BY f.severity")
def salted_join_totals(bed: Bed):
    rows = salted_join(bed.finding.select("finding_key", "hostname", "severity"), bed.host.select("hostname", "os"), ["hostname"], 8)
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("os").alias("systems"))


@query("worst_finding_per_host", f"WITH {_OPEN} SELECT hostname, finding_key FROM op QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY epss DESC NULLS LAST, finding_key) = 1")
def worst_finding_per_host(bed: Bed):
    return first_per_key(bed.finding.filter(_OPENF), ["hostname"], F.col("epss").desc_nulls_last(), F.col("finding_key")).select("hostname", "finding_key")
