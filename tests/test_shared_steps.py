"""Steps of the evidence, route and placement queries that are taken once, on rows built here."""

from pyspark.sql import functions as F

from vulnspark.functions.text import package_from_purl
from vulnspark.operators import attack, matching, network, priority, routes

FINDING = "hostname string, package string, cve_id string, severity string, status string, kev_added string"
ADVISORY = "cve_id string, cvss_vector string"
VERDICT = "cve_id string, priority_tier string, priority_score int, analysed_at bigint"
WIRE, FOOT = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:L/UI:R/S:U/C:H/I:L/A:N"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hops(spark):
    findings = spark.createDataFrame([
        ("h", "p", "C1", "high", "open", ""), ("h", "p", "C1", "high", "open", "x"), ("h", "p", "C2", "low", "open", ""),
        ("h", "p", None, "low", "open", ""), ("h", "q", "C3", "low", "open", ""), ("h", "p", "C9", "low", "removed", ""),
        (None, "p", "C1", "low", "open", ""), ("g", "p", "C1", "low", "open", "")], FINDING)
    ports = [("h", "p", 80), ("h", "p", 80), ("h", "p", 443), ("h", "p", None), ("h", "q", 80), ("h", None, 80), (None, "p", 80)]
    exposure = spark.createDataFrame(ports, "hostname string, package string, port bigint")
    advisories = spark.createDataFrame([("C1", WIRE), ("C1", ""), ("C2", FOOT)], ADVISORY)
    verdicts = spark.createDataFrame([("C2", "P0", 1, 1)], VERDICT)
    return routes.hop_class(findings, exposure, advisories, verdicts)


def test_findings_meet_their_ports_after_they_are_rolled_up(spark):
    out = hops(spark)
    assert "Expand" not in plan(out)
    got = {(r.port, r.package): (r.rk_rank, r.rk_open, r.rk_top, r.rk_kev, r.rk_n_wire, r.rk_n_foot, r.rk_wire_text, r.rk_foot_text) for r in out.collect()}
    p = (3, 2, "P0", 1, 1, 1, "C1", "C2")
    assert got == {("80", "p"): p, ("443", "p"): p, (None, "p"): p, ("80", "q"): (1, 1, "P4", 0, 0, 0, "", "")}


def test_best_of_a_port_needs_its_packages_once(spark):
    fields = "hostname string, port string, package string, rk_rank int, rk_wire_text string, rk_foot_text string"
    classes = spark.createDataFrame([("h", "80", "a", 3, "C2", ""), ("h", "80", "b", 3, "C1", ""), ("h", "80", "c", 2, "", "C7"),
                                     ("h", "81", "a", None, "C5", "")], fields)
    evidence = spark.createDataFrame([("h", p, "confirmed observed", "net", "tcp", 5, 9) for p in (80, 81)], (
        "hostname string, port bigint, observed_grade string, entry_text string, protocols_text string, sessions bigint, edge_last_seen bigint"))
    edges = spark.createDataFrame([], "src_ip string, dest_ip string, port bigint, protocol string, sessions bigint, edge_last_seen bigint")
    claims = spark.createDataFrame([], "hostname string, address string, claimants int")
    marked = classes.withColumn("package", F.concat("package", F.lit("-one-reading")))
    out = routes.route_edges(evidence, edges, claims, marked.filter("package <> ''"))
    assert plan(out).count("one-reading") <= 1
    got = {r.port: (r.rk_rank, r.wire_text, r.foot_text) for r in out.collect()}
    assert got == {"80": (3, "C1 / C2", ""), "81": (0, None, None)}


def test_cves_with_the_same_evidence_are_placed_as_one(spark, monkeypatch):
    kept = {}
    write = attack.written

    def spy(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(attack, "written", spy)
    findings = spark.createDataFrame([(f"h{i % 3}", "p", f"C{i}", "", "high") for i in range(12)] + [("h0", "p", None, "", "high")],
                                     "hostname string, package string, cve_id string, scope_id string, confidence string")
    reach = spark.createDataFrame([(f"h{i}", "p", "answers any address") for i in range(3)], "hostname string, rk_key string, reach_class string")
    cover = spark.createDataFrame([(f"h{i}", 1) for i in range(3)], "hostname string, assessed_at bigint")
    advisories = spark.createDataFrame([(f"C{i}", WIRE, ["W1", "W2"]) for i in range(12)], "cve_id string, cvss_vector string, cwes array<string>")
    table = spark.createDataFrame([(w, "T1", "One", "capec", "impact", "Linux") for w in ("W1", "W2")],
                                  "cwe string, technique string, technique_name string, map_source string, tactics string, platforms string")
    tactics = spark.createDataFrame([("impact", "Impact", 1), ("initial-access", "Access", 2)], "tactic string, tactic_name string, tactic_order int")
    out = attack.attack_placement(findings, reach, cover, advisories, table, tactics)
    got = {(r.technique, r.map_source): (r.cves, r.hosts, r.platforms) for r in out.collect()}
    assert got == {("T1", "capec"): (12, 24, "Linux"), ("T1", "any"): (12, 24, "Linux"), ("T1190", "cvss_vector"): (12, 12, ""),
                   ("T1190", "observed"): (12, 13, ""), ("T1190", "any"): (12, 25, "")}
    assert kept["profiles"].count() == 2


def test_scoring_joins_by_cve_before_it_joins_by_host(spark):
    findings = spark.createDataFrame([("h", "p", "C1", "", "high", "", 0.1, "t", "low")], (
        "hostname string, package string, cve_id string, scope_id string, confidence string, kev_added string, epss double, title string, severity string"))
    reach = spark.createDataFrame([("h", "p", "answers any address", 3)], "hostname string, rk_key string, reach_class string, reach_rank int")
    advisories = spark.createDataFrame([("C1", 5.0, "t")], "cve_id string, cvss_score double, title string")
    verdicts = spark.createDataFrame([("C1", "P1", 70, 1)], VERDICT)
    out = priority.score_findings(findings, verdicts, reach, advisories, 10)
    text = out._jdf.queryExecution().analyzed().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert ["rk_key" in line for line in joins] == [True, False, False]
    row = out.first()
    assert (row.scored, row.priority_score, row.reach_rank) == (1, 80, 3)


def test_package_of_a_purl_is_parsed_without_patterns_where_none_is_needed(spark):
    want = {
        None: None, "": "", "name@1": "name", "@scope/x": "", "pkg:deb/debian/a@1?x=/y": "a", "pkg:npm/ns/b@2": "ns/b", "pkg:deb": "deb",
        "pkg:rpm?x": "rpm", "pkg:npm/%40s/c+d@1": "@s/c+d", "pkg:apk/a/b/c": "c", "pkg:/x": "/x", "pkg:npm/%zz": None, "pkg:deb/a?b\nc": "a?b\nc"}
    rows = spark.createDataFrame([(k,) for k in want], "purl string").select("purl", package_from_purl("purl").alias("package"))
    assert plan(rows).count("regexp") <= 2
    assert {r.purl: r.package for r in rows.collect()} == want


def test_packages_are_counted_before_their_purls_are_parsed(spark, monkeypatch):
    purl = "pkg:deb/ubuntu/a?upstream=src"
    comps = [("h1", "DEB", "a", purl), ("h2", "deb", "a", purl), ("h3", "deb", "a", purl), ("h1", "deb", "a", ""), ("h1", "deb", "b", None),
             ("h1", "npm", "a", ""), ("h1", None, None, None), ("h2", "deb", "a", None)]
    ranges = spark.createDataFrame([("deb", "src"), ("deb", "src"), ("npm", "a"), ("npm", None)], "ecosystem string, package string")
    prepare, seen = matching.identity.prepare, []

    def spy(df):
        seen.append(df.count())
        return prepare(df)

    monkeypatch.setattr(matching.identity, "prepare", spy)
    out = matching.match_coverage(spark.createDataFrame(comps, "hostname string, type string, name string, purl string"), ranges)
    got = {r.type: (r.components, r.in_feed, r.no_identifier, r.comparator) for r in out.collect()}
    assert got == {"deb": (6, 3, 3, "dpkg"), "npm": (1, 1, 1, "semver"), "": (1, 0, 1, "none")}
    assert seen == [7]


JUMPS = "src string, dst string, kind string, port string, protocol string, sessions double, edge_last_seen double, rk_rank int, wire_text string, foot_text string"


def jumps(spark):
    ends = [("e1", "a", "entry", 3), ("e2", "b", "entry", 2), ("a", "b", "host", 3), ("b", "c", "host", 3), ("c", "e2", "host", 3), ("c", "d", "host", 0)]
    return spark.createDataFrame([(a, b, kind, "1", "tcp", 1.0, 1.0, rank, "", "") for a, b, kind, rank in ends], JUMPS)


def test_entries_that_walk_as_one_reach_what_each_of_them_does(spark):
    edges = routes.merge_edges(jumps(spark))
    starts = routes.entry_nodes(edges)
    each, one = routes._walk(edges, starts, 5).collect(), routes._walk(edges, starts, 5, apart=False).collect()
    nodes = {r.node for r in each}
    assert len(one) == len(nodes) < len(each)
    assert {r.node: (r.depth, r.on_cves) for r in one} == {
        n: (min(r.depth for r in each if r.node == n), any(r.on_cves for r in each if r.node == n)) for n in nodes}


def test_paths_and_entries_read_merged_edges_that_are_there(spark, monkeypatch):
    entries, plans = routes.entry_nodes, []

    def spy(edges):
        plans.append(plan(edges))
        return entries(edges)

    monkeypatch.setattr(routes, "entry_nodes", spy)
    got = {r.path_text for r in routes.all_paths(jumps(spark), 2, fanout=8).collect()}
    assert got == {" → ".join(p) for p in ("e1a", "e1ab", "e2b", "e2bc") for p in [[p[:2], *p[2:]]]}
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_edges_meet_their_entry_points_once(spark):
    fields = "src_ip string, dest_ip string, port bigint, protocol string, sessions bigint, edge_first_seen bigint, edge_last_seen bigint"
    edges = spark.createDataFrame([("10.0.0.1", "FD00::1", 80, "tcp", 2, 5, 9), ("10.0.0.1", "fd00::1", 80, "udp", 3, 4, 8), ("10.0.1.1", "fd00::1", 80, "tcp", 1, 1, 1),
                                   ("192.0.2.1", "fd00::1", 80, "tcp", 7, 0, 99), (None, "fd00::1", 80, "tcp", 7, 0, 99), ("192.0.2.1", "fd00::2", 80, "tcp", 7, 0, 99)], fields)
    entries = spark.createDataFrame([("10.0.0.0/24", "a", "Constant"), ("10.0.1.0/24", "b", None)], "cidr string, name string, pressure string")
    out = network.grouped_edges(edges.withColumn("dest_ip", F.concat("dest_ip", F.lit("-one-reading"))), entries)
    assert plan(out).count("one-reading") == 0
    got = {r.dest_ip[:7]: (r.sessions, r.edge_first_seen, r.edge_last_seen, sorted(r.entries), r.constant_edge, r.n_srcs, r.from_entry, r.n_entries, r.srcs_text)
           for r in out.collect()}
    assert got == {"fd00::1": (6, 1, 9, ["10.0.0.0/24", "10.0.1.0/24"], 1, 2, 1, 2, "10.0.0.1 10.0.1.1"), "fd00::2": (None, None, None, [], 0, 0, 0, 0, None)}
