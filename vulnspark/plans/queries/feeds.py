"""Feed normaliser queries: raw feed documents built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnspark.plans.queries.registry import query
from vulnspark.plans.testbed import Bed
from vulnspark.sources import advisory_feeds, context_feeds

S = F.lit


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if not isinstance(p, str) else S(p) for p in parts])


def _osv(bed: Bed):
    """One OSV document per order, read back through the feed schema."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ks, cs = k.cast("string"), c.cast("string")
    eco = F.when(k % 4 == 0, "Ubuntu:Pro:22.04:LTS").when(k % 4 == 1, "PyPI").when(k % 4 == 2, "Alpine:v3.19").otherwise("Debian:12")
    events = F.when(k % 3 == 0, _text('{"introduced":"0"},{"fixed":"1.', ks, '"}')).when(
        k % 3 == 1, _text('{"introduced":"1.0"},{"fixed":"1.', ks, '"},{"introduced":"2.0"},{"fixed":"2.', cs, '"}')).otherwise('{"introduced":"abc"}')
    kind = F.when(k % 3 == 2, "GIT").otherwise("ECOSYSTEM")
    status = F.when(F.col("o_orderstatus") == "P", "Ignored").otherwise("")
    doc = _text(
        '{"id":"OSV-', ks, '","aliases":["GHSA-', cs, '",', F.when(k % 5 == 0, '"GHSA-x"').otherwise(_text('"cve-2024-', (c + 10000).cast("string"), '"')), '],"summary":" Flaw ', cs, ' ","withdrawn":"',
        F.when(k % 11 == 0, "2020").otherwise(""), '","severity":[{"type":"OTHER","score":"x"},{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],"database_specific":{"severity":"HIGH"},',
        '"references":[{"type":"WEB","url":"w"},{"type":"ADVISORY","url":"u', ks, '"}],"affected":[{"package":{"name":"Pkg', cs, '","ecosystem":"', eco, '"},"ecosystem_specific":{"status":"', status,
        '"},"ranges":[{"type":"', kind, '","events":[', events, ']}],"versions":["9.1","9.2"]}]}')
    return bed.b_orders.select(F.from_json(doc, advisory_feeds.OSV_SCHEMA).alias("d")).select("d.*")


_OSV = """osv AS (SELECT *, concat('OSV-', o_orderkey) AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat('OSV-', o_orderkey) ELSE concat('CVE-2024-', o_custkey + 10000) END AS cve,
  CASE o_orderkey % 4 WHEN 0 THEN 'deb' WHEN 1 THEN 'python' WHEN 2 THEN 'apk' ELSE 'deb' END AS eco, CASE o_orderkey % 4 WHEN 0 THEN 'ubuntu' WHEN 1 THEN '' WHEN 2 THEN 'alpine' ELSE 'debian' END AS distro,
  CASE o_orderkey % 4 WHEN 0 THEN '22.04' WHEN 1 THEN '' WHEN 2 THEN '3.19' ELSE '12' END AS rel, CASE o_orderkey % 4 WHEN 0 THEN 'pro' ELSE '' END AS variant FROM b_orders WHERE o_orderkey % 11 <> 0)"""


@query("osv_advisories", f"WITH {_OSV} SELECT id AS advisory_id, cve AS cve_id, concat('Flaw ', o_custkey) AS title, 'high' AS severity, 'CVSS:3.1/AV:N' AS cvss_vector, concat('u', o_orderkey) AS url FROM osv")
def osv_advisories(bed: Bed):
    return advisory_feeds.osv_advisories(_osv(bed)).select("advisory_id", "cve_id", "title", "severity", "cvss_vector", "url")


@query("osv_ranges", f"""WITH {_OSV}, r AS (SELECT * FROM osv WHERE o_orderstatus <> 'P')
SELECT id AS advisory_id, cve AS cve_id, eco AS ecosystem, concat('pkg', o_custkey) AS package, distro, rel AS distro_release, variant AS distro_variant, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2.0' END AS introduced,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('1.', o_orderkey) ELSE concat('2.', o_custkey) END AS fixed, '' AS last_affected, 'ECOSYSTEM' AS range_type FROM r WHERE o_orderkey % 3 <> 2
UNION ALL SELECT id, cve, eco, concat('pkg', o_custkey), distro, rel, variant, '1.0', concat('1.', o_orderkey), '', 'ECOSYSTEM' FROM r WHERE o_orderkey % 3 = 1
UNION ALL SELECT id, cve, eco, concat('pkg', o_custkey), distro, rel, variant, v, '', v, 'EXACT' FROM r, (SELECT unnest(['9.1', '9.2']) AS v) WHERE o_orderkey % 3 = 2""")
def osv_ranges(bed: Bed):
    return advisory_feeds.osv_ranges(_osv(bed)).select("advisory_id", "cve_id", "ecosystem", "package", "distro", "distro_release", "distro_variant", "introduced", "fixed", "last_affected", "range_type")


@query("osv_notaffected", f"WITH {_OSV} SELECT id AS advisory_id, eco AS ecosystem, concat('pkg', o_custkey) AS package, 'ignored' AS status FROM osv WHERE o_orderstatus = 'P'")
def osv_notaffected(bed: Bed):
    return advisory_feeds.osv_notaffected(_osv(bed)).select("advisory_id", "ecosystem", "package", "status")


def _nvd(bed: Bed):
    k = F.col("p_partkey")
    ks = k.cast("string")
    metric = F.when(k % 4 == 0, '"cvssMetricV31":[{"cvssData":{"vectorString":"V31","baseScore":9.1,"baseSeverity":"CRITICAL"}}],"cvssMetricV2":[{"baseSeverity":"LOW","cvssData":{"vectorString":"V2","baseScore":2}}]').when(
        k % 4 == 1, '"cvssMetricV2":[{"baseSeverity":"LOW","cvssData":{"vectorString":"V2","baseScore":2.0}}]').otherwise("")
    cpe = _text('cpe:2.3:a:Ven', ks, ':', F.when(k % 5 == 0, "*").otherwise("Prod"), ':', F.when(k % 3 == 0, _text("1.", ks)).otherwise("*"), ':*:*:*:*:node.js:*:*')
    bound = F.when(k % 3 == 1, ',"versionStartIncluding":"1.0","versionEndExcluding":"2.0"').otherwise("")
    one = _text('{"vulnerable":', F.when(k % 7 == 0, "false").otherwise("true"), ',"criteria":"', cpe, '"', bound, '}')
    doc = _text('{"cve":{"id":"CVE-2023-', ks, '","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":"Text ', ks, '"}],"metrics":{', metric, '},"weaknesses":[{"description":[{"value":"CWE-', (k % 9).cast("string"),
                '"},{"value":"NVD-x"},{"value":"cwe-', (k % 9).cast("string"), '"}]}],"configurations":[{"nodes":[{"cpeMatch":[', one, ',', one, ']}]}]}}')
    return bed.b_part.select(F.from_json(doc, advisory_feeds.NVD_SCHEMA).alias("d")).select("d.*")


@query("nvd_advisories", """SELECT concat('CVE-2023-', p_partkey) AS cve_id, concat('Text ', p_partkey) AS title, CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE '' END AS severity, CASE p_partkey % 4 WHEN 0 THEN 9.1::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS cvss_score,
  CASE p_partkey % 4 WHEN 0 THEN 'V31' WHEN 1 THEN 'V2' ELSE '' END AS cvss_vector, concat('CWE-', p_partkey % 9) AS cwes FROM b_part""")
def nvd_advisories(bed: Bed):
    out = advisory_feeds.nvd_advisories(_nvd(bed))
    return out.select("cve_id", "title", "severity", "cvss_score", "cvss_vector", F.array_join("cwes", ",").alias("cwes"))


@query("nvd_ranges", """SELECT concat('CVE-2023-', p_partkey) AS cve_id, concat('ven', p_partkey, ':prod') AS package, CASE WHEN p_partkey % 3 = 0 THEN concat('1.', p_partkey) ELSE '1.0' END AS introduced, CASE WHEN p_partkey % 3 = 1 THEN '2.0' ELSE '' END AS fixed,
  CASE WHEN p_partkey % 3 = 0 THEN concat('1.', p_partkey) ELSE '' END AS last_affected, 'node.js' AS target_sw FROM b_part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 2""")
def nvd_ranges(bed: Bed):
    return advisory_feeds.nvd_ranges(_nvd(bed)).select("cve_id", "package", "introduced", "fixed", "last_affected", "target_sw")


def _kev(bed: Bed):
    k = F.col("s_suppkey").cast("string")
    doc = _text('{"vulnerabilities":[{"cveID":"cve-2022-', k, '","dateAdded":"old"},{"cveID":"CVE-2022-', k, '","dateAdded":"2022-01-01","dueDate":"2022-02-01","knownRansomwareCampaignUse":"Known","vendorProject":" Acme ","product":"P', k, '"},{"cveID":""}]}')
    return bed.b_supplier.select(F.from_json(doc, advisory_feeds.KEV_SCHEMA).alias("d")).select("d.*")


@query("kev_catalogue", "SELECT concat('CVE-2022-', s_suppkey) AS cve_id, '2022-01-01' AS kev_added, concat('Acme P', s_suppkey) AS kev_name, 'Known' AS kev_ransomware FROM b_supplier")
def kev_catalogue(bed: Bed):
    return advisory_feeds.kev(_kev(bed)).select("cve_id", "kev_added", "kev_name", "kev_ransomware")


@query("epss_scores", "SELECT concat('CVE-2022-', s_suppkey) AS cve_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_suppkey % 100 / 100.0, 2)::DOUBLE END AS epss FROM b_supplier")
def epss_scores(bed: Bed):
    k = F.col("s_suppkey")
    rows = bed.b_supplier.select(F.concat(S("cve-2022-"), k).alias("cve"), F.when(k % 3 == 0, "n/a").otherwise(F.round(k % 100 / 100.0, 2).cast("string")).alias("epss"), S("0.5").alias("percentile"))
    return advisory_feeds.epss(rows).select("cve_id", "epss")


@query("cvelist_rows", """SELECT concat('CVE-2021-', c_custkey) AS cve_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('Desc ', c_custkey) END AS description, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('Acme Tool', chr(10), 'Acme One') END AS products, 'CWE-79' AS cwes, '2021-03-04' AS published
FROM b_customer WHERE c_custkey % 5 <> 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 4 = 0)""")
def cvelist_rows(bed: Bed):
    k = F.col("c_custkey")
    affected = F.when(k % 4 == 0, '{"vendor":"Acme","product":"n/a"}').otherwise('{"vendor":"Acme","product":"Tool"},{"vendor":"acme","product":"Acme One"},{"vendor":"Acme","product":"Tool"}')
    doc = _text('{"cveMetadata":{"cveId":"cve-2021-', k.cast("string"), '","state":"', F.when(k % 5 == 0, "rejected").otherwise("PUBLISHED"), '","assignerShortName":"x","datePublished":"2021-03-04T05:06:07"},"containers":{"cna":{"descriptions":[{"lang":"fr","value":"f"}',
                F.when(k % 3 == 0, "").otherwise(_text(',{"lang":"en-US","value":"Desc ', k.cast("string"), '"}')), '],"affected":[', affected, '],"problemTypes":[{"descriptions":[{"cweId":"CWE-79"},{"cweId":"CWE-79"},{"cweId":""}]}]}}}')
    out = advisory_feeds.cvelist(bed.b_customer.select(F.from_json(doc, advisory_feeds.CVELIST_SCHEMA).alias("d")).select("d.*"))
    return out.select("cve_id", "description", "products", "cwes", "published")


@query("advisory_overlay", """WITH a AS (SELECT * FROM t_advisory QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY advisory_id) = 1), w AS (SELECT cve_id, min(cwe_a) AS c FROM t_advisory WHERE severity = 'high' GROUP BY cve_id),
k AS (SELECT cve_id, max(kev_added) AS kev_added FROM t_advisory WHERE kev_added <> '' GROUP BY cve_id)
SELECT a.cve_id, a.advisory_id, coalesce(CASE WHEN a.severity = 'low' THEN a.cwe_b END, w.c) AS cwe, a.epss, k.kev_added FROM a LEFT JOIN w ON w.cve_id = a.cve_id LEFT JOIN k ON k.cve_id = a.cve_id""")
def advisory_overlay(bed: Bed):
    # The CVE id stands in as the advisory id so that several sources collide on it.
    none = F.array().cast("array<string>")
    adv = bed.advisory.select(F.col("cve_id").alias("advisory_id"), "cve_id", F.col("advisory_id").alias("source_order"), S("osv").alias("feed_source"), S("").alias("modified"),
                              F.when(F.col("severity") == "low", F.array("cwe_b")).otherwise(none).alias("cwes"))
    nvd = bed.advisory.select("cve_id", F.when(F.col("severity") == "high", F.array("cwe_a")).otherwise(none).alias("cwes"))
    first = bed.advisory.groupBy("cve_id").agg(F.min_by(F.struct("epss"), "advisory_id").alias("e")).select("cve_id", "e.epss")
    kev = bed.advisory.filter("kev_added <> ''").groupBy("cve_id").agg(F.max("kev_added").alias("kev_added"))
    out = advisory_feeds.overlay(adv, nvd, kev, first)
    return out.select("cve_id", F.col("source_order").alias("advisory_id"), F.get("cwes", S(0)).alias("cwe"), "epss", "kev_added")


def _capec_csv(bed: Bed):
    k = F.col("p_partkey")
    taxonomy = _text('::TAXONOMY NAME:ATTACK:ENTRY ID:', (k % 40 + 1000).cast("string"), ':ENTRY NAME:Name ', (k % 80).cast("string"), '::TAXONOMY NAME:WASC:ENTRY ID:1:ENTRY NAME:Other::TAXONOMY NAME:ATTACK:ENTRY ID:T', (k % 7 + 2000).cast("string"), ':ENTRY NAME:Sub : x::')
    flow = _text('::STEP:1:PHASE:Explore:DESCRIPTION: [Find ', k.cast("string"), ']:TECHNIQUE:y::')
    return bed.b_part.select(_text("'", k.cast("string")).alias("'ID"), F.col("p_name").alias("Name"), S("Detailed").alias("Abstraction"), S("High").alias("Typical Severity"), S("Low").alias("Likelihood Of Attack"),
                             S("::One::Two::").alias("Prerequisites"), flow.alias("Execution Flow"), taxonomy.alias("Taxonomy Mappings"))


def _cwe_csv(bed: Bed):
    k = F.col("s_suppkey")
    links = _text('::NATURE:ChildOf:CWE ID:', F.floor(k / 3).cast("string"), ':VIEW ID:1000:ORDINAL:Primary::NATURE:PeerOf:CWE ID:1:VIEW ID:1000::')
    kind = F.when(k % 10 == 0, "Pillar").when(k % 10 < 4, "Class").otherwise("Base")
    patterns = F.when(k % 2 == 0, _text("::", (k + 1).cast("string"), "::", (k + 2).cast("string"), ":: x ::")).otherwise("")
    return bed.b_supplier.select(k.cast("string").alias("CWE-ID"), kind.alias("Weakness Abstraction"), links.alias("Related Weaknesses"), patterns.alias("Related Attack Patterns"))


_CHAIN = """cc AS (SELECT s_suppkey AS w, s_suppkey + d AS p FROM b_supplier, (SELECT unnest([1, 2]) AS d) WHERE s_suppkey % 2 = 0), ca AS (SELECT p_partkey AS p, concat('T', p_partkey % 40 + 1000) AS t FROM b_part UNION ALL SELECT p_partkey, concat('T', p_partkey % 7 + 2000) FROM b_part),
direct AS (SELECT concat('CWE-', cc.w) AS cwe, cc.w, ca.t AS technique, count(*) AS n FROM cc JOIN ca ON ca.p = cc.p GROUP BY ALL)"""


@query("cwe_capec_chain", f"WITH {_CHAIN} SELECT cwe, technique, n AS patterns, CASE WHEN technique LIKE 'T2%' THEN 'Sub: x' END AS usual_name FROM direct")
def cwe_capec_chain(bed: Bed):
    out = context_feeds.attack_rows(context_feeds.cwe_capec(_cwe_csv(bed)), context_feeds.capec_attack(_capec_csv(bed)), bed.spark.createDataFrame([], "technique string, name string, tactics array<string>, platforms array<string>"))
    return out.select("cwe", "technique", F.size("via_capec").cast("bigint").alias("patterns"), F.when(F.col("technique").startswith("T2"), F.col("technique_name")).alias("usual_name"))


@query("canonical_names", """WITH n AS (SELECT concat('T', p_partkey % 40 + 1000) AS technique, concat('Name ', p_partkey % 80) AS name FROM b_part UNION ALL SELECT concat('T', p_partkey % 7 + 2000), 'Sub: x' FROM b_part), c AS (SELECT technique, name, count(*) AS k FROM n GROUP BY ALL)
SELECT technique, arg_min(name, (-k, -length(name), name)) AS name FROM c GROUP BY technique""")
def canonical_names(bed: Bed):
    return context_feeds.canonical_names(context_feeds.capec_attack(_capec_csv(bed)))


@query("inherited_techniques", f"""WITH {_CHAIN}, kd AS (SELECT s_suppkey AS w, CASE WHEN s_suppkey % 10 = 0 THEN 'Pillar' WHEN s_suppkey % 10 < 4 THEN 'Class' ELSE 'Base' END AS a, CAST(floor(s_suppkey / 3) AS BIGINT) AS parent FROM b_supplier),
leaf AS (SELECT * FROM kd WHERE a <> 'Pillar' AND w NOT IN (SELECT w FROM direct)), f AS (SELECT l.w, l.parent AS d FROM leaf l JOIN kd k ON k.w = l.parent AND k.a <> 'Pillar'),
one AS (SELECT f.w, f.d, x.technique, 1 AS depth FROM f JOIN direct x ON x.w = f.d), g AS (SELECT f.w, k.parent AS d FROM f JOIN kd k ON k.w = f.d JOIN kd k2 ON k2.w = k.parent AND k2.a <> 'Pillar' WHERE f.w NOT IN (SELECT w FROM one)),
two AS (SELECT g.w, g.d, x.technique, 2 AS depth FROM g JOIN direct x ON x.w = g.d), u AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT concat('CWE-', w) AS cwe, technique, min(depth) AS inherit_depth, string_agg(DISTINCT concat('CWE-', d), ',' ORDER BY concat('CWE-', d)) AS inherited_from FROM u GROUP BY ALL""")
def inherited_techniques(bed: Bed):
    direct = context_feeds.attack_rows(context_feeds.cwe_capec(_cwe_csv(bed)), context_feeds.capec_attack(_capec_csv(bed)), bed.spark.createDataFrame([], "technique string, name string, tactics array<string>, platforms array<string>"))
    kinds, links = context_feeds.cwe_hierarchy(_cwe_csv(bed))
    return context_feeds.inherited_attack_rows(direct, kinds, links).select("cwe", "technique", "inherit_depth", "inherited_from")


@query("capec_prose", "SELECT concat(p_partkey) AS capec, p_name AS name, 'One Two' AS prerequisites, concat('[Find ', p_partkey, ']') AS first_step FROM b_part")
def capec_prose(bed: Bed):
    return context_feeds.capec_detail(_capec_csv(bed)).select("capec", "name", "prerequisites", "first_step")


def _stix(bed: Bed):
    """One bundle: every region a tactic, every part a technique, every supplier a mitigation."""
    ref = lambda x: _text('"external_references":[{"source_name":"other","external_id":"no"},{"source_name":"mitre-attack","external_id":"', x, '"}]')
    r, p, s = F.col("r_regionkey").cast("string"), F.col("p_partkey"), F.col("s_suppkey")
    tactics = bed.b_region.select(_text('{"type":"x-mitre-tactic","id":"ta', r, '","name":"Tactic ', r, '","x_mitre_shortname":"t', r, '"}').alias("o"))
    matrix = bed.b_region.filter("r_regionkey = 0").select(S('{"type":"x-mitre-matrix","id":"m","tactic_refs":["ta3","ta1","ta0","ta2","ta9"]}').alias("o"))
    ps = p.cast("string")
    tech = bed.b_part.select(_text('{"type":"attack-pattern","id":"ap', ps, '","name":"Tech ', ps, '","revoked":', F.when(p % 9 == 0, "true").otherwise("false"), ',', ref(_text("T", ps)),
                                   ',"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"t', (p % 4).cast("string"), '"},{"kill_chain_name":"mitre-attack","phase_name":"t3"},{"kill_chain_name":"z","phase_name":"q"}],"x_mitre_platforms":["Linux","Linux"]}').alias("o"))
    ss = s.cast("string")
    coa = bed.b_supplier.select(_text('{"type":"course-of-action","id":"ca', ss, '","name":"Fix ', ss, '",', ref(_text("M", ss)), '}').alias("o"))
    rel = bed.b_supplier.select(_text('{"type":"relationship","relationship_type":"', F.when(s % 3 == 0, "uses").otherwise("mitigates"), '","source_ref":"ca', ss, '","target_ref":"ap', (s * 2).cast("string"), '","description":" d', ss, ' "}').alias("o"))
    rows = tactics.union(matrix).union(tech).union(coa).union(rel)
    # One bundle per object keeps the document side parallel; the normaliser reads any number of bundles.
    docs = rows.select(F.from_json(_text('{"objects":[', F.col("o"), ']}'), context_feeds.STIX_SCHEMA).alias("d")).select("d.*")
    return context_feeds.stix_objects(docs)


@query("attack_tactics", "SELECT concat('t', r_regionkey) AS tactic, concat('Tactic ', r_regionkey) AS tactic_name, CASE r_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS tactic_order FROM b_region WHERE r_regionkey < 4")
def attack_tactics(bed: Bed):
    return context_feeds.attack_tactics(_stix(bed))


@query("attack_techniques", "SELECT concat('T', p_partkey) AS technique, concat('Tech ', p_partkey) AS name, CASE p_partkey % 4 WHEN 0 THEN 't3,t0' WHEN 1 THEN 't3,t1' WHEN 2 THEN 't3,t2' ELSE 't3' END AS tactics, 'Linux' AS platforms FROM b_part WHERE p_partkey % 9 <> 0")
def attack_techniques(bed: Bed):
    objects = _stix(bed)
    out = context_feeds.attack_techniques(objects, context_feeds.attack_tactics(objects))
    return out.select("technique", "name", F.array_join("tactics", ",").alias("tactics"), F.array_join("platforms", ",").alias("platforms"))


@query("attack_mitigations", "SELECT concat('T', s.s_suppkey * 2) AS technique, concat('M', s.s_suppkey) AS mitigation, concat('Fix ', s.s_suppkey) AS mitigation_name, concat('d', s.s_suppkey) AS description FROM b_supplier s JOIN b_part p ON p.p_partkey = s.s_suppkey * 2 WHERE s.s_suppkey % 3 <> 0")
def attack_mitigations(bed: Bed):
    return context_feeds.attack_mitigations(_stix(bed))


@query("kev_techniques", "SELECT concat('CVE-2020-', s_suppkey) AS cve_id, concat('T', s_suppkey) AS technique, 'primary_impact' AS mapping_type FROM b_supplier WHERE s_suppkey % 4 <> 0")
def kev_techniques(bed: Bed):
    k = F.col("s_suppkey")
    doc = _text('{"mapping_objects":[{"capability_id":"', F.when(k % 4 == 0, "x-").otherwise("cve-2020-"), k.cast("string"), '","attack_object_id":"T', k.cast("string"), '","mapping_type":"primary_impact"},{"capability_id":"CVE-1-1"}]}')
    out = context_feeds.kev_attack(bed.b_supplier.select(F.from_json(doc, context_feeds.KEV_ATTACK_SCHEMA).alias("d")).select("d.*"))
    return out.select("cve_id", "technique", "mapping_type")


@query("msrc_updates", """SELECT concat('KB', o_custkey) AS kb, '19045' AS branch, e AS edition, max(o_orderkey % 900) AS ubr, concat('10.0.19045.', max(o_orderkey % 900)) AS fixed_build, CASE e WHEN 'client' THEN 'Windows 10 Version 22H2' ELSE 'Windows Server 2022' END AS product, count(DISTINCT o_orderkey) AS n_cves
FROM b_orders, (SELECT unnest(['client', 'server']) AS e) WHERE o_orderkey % 5 <> 0 AND (e = 'client' OR o_orderkey % 2 = 0) GROUP BY o_custkey, e""")
def msrc_updates(bed: Bed):
    k = F.col("o_orderkey")
    doc = _text('{"released":"d","ProductTree":{"FullProductName":[{"ProductID":"1","Value":"Windows 10 Version 22H2 for x64-based Systems"},{"ProductID":"2","Value":"Windows Server 2022"},{"ProductID":"3","Value":"Microsoft Edge"}]},"Vulnerability":[{"CVE":"CVE-1-', k.cast("string"),
                '","Remediations":[{"Description":{"Value":"', F.col("o_custkey").cast("string"), '"},"FixedBuild":"', F.when(k % 5 == 0, "1.2").otherwise(_text("10.0.19045.", (k % 900).cast("string"))), '","Supercedence":"5","ProductID":["1"', F.when(k % 2 == 0, ',"2"').otherwise(""), ',"3"]}]}]}')
    out = context_feeds.msrc(bed.b_orders.select(F.from_json(doc, context_feeds.MSRC_SCHEMA).alias("d")).select("d.*"))
    return out.select("kb", "branch", "edition", "ubr", "fixed_build", "product", F.col("n_cves").cast("bigint").alias("n_cves"))


@query("eol_catalogue", "SELECT concat('slug', p_partkey) AS product, c AS cycle, CASE c WHEN '1' THEN '2020-01-01' ELSE '' END AS eol_from, CASE c WHEN '1' THEN 1 ELSE 0 END AS lts, concat('Label ', p_partkey) AS label FROM b_part, (SELECT unnest(['1', '2']) AS c)")
def eol_catalogue(bed: Bed):
    k = F.col("p_partkey").cast("string")
    doc = _text('{"result":[{"name":"slug', k, '","label":"Label ', k, '","category":"c","releases":[{"name":"1","eolFrom":"2020-01-01","isLts":true,"latest":{"name":"1.9"}},{"name":"2"},{"name":""}]},{"name":""}]}')
    out = context_feeds.eol(bed.b_part.select(F.from_json(doc, context_feeds.EOL_SCHEMA).alias("d")).select("d.*"))
    return out.select("product", "cycle", "eol_from", "lts", "label")
