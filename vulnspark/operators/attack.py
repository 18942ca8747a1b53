"""ATT&CK placement of open findings.

Findings are reduced to one row per CVE before any weakness or technique
expansion, so the multi-valued joins run on CVEs and not on findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.cvss import cvss_letters, preferred_vector
from vulnspark.functions.text import blank, present
from vulnspark.operators.evidence import reach_class_of, with_reach
from vulnspark.operators.generic import lookup, values, values_text
from vulnspark.sources.state import written

# The technique a CVSS vector alone implies.
VECTOR_TECHNIQUES = {
    "T1190": ("Exploit Public-Facing Application", "initial-access"),
    "T1203": ("Exploitation for Client Execution", "execution"),
    "T1210": ("Exploitation of Remote Services", "lateral-movement"),
    "T1068": ("Exploitation for Privilege Escalation", "privilege-escalation"),
}
RANSOM_TECHNIQUE = ("T1486", "Data Encrypted for Impact")
RANSOM_COMMENT = (
    "CISA's KEV entry flags this CVE as used in known ransomware campaigns. Encrypting data for impact is what those "
    "campaigns do. This is a campaign level flag, not a technique mapping for this CVE.")


def trimmed_list(c: Column | str) -> Column:
    """A comma list as a distinct, trimmed array without empties."""
    return F.array_distinct(F.filter(F.transform(F.split(blank(c), ","), lambda t: F.trim(t)), lambda x: x != ""))


def cve_cwes(advisories: DataFrame) -> DataFrame:
    """Distinct weaknesses per CVE over all its advisories."""
    return advisories.select("cve_id", F.explode("cwes").alias("cwe")).withColumn("cwe", F.trim("cwe")).filter(
        present("cwe")).distinct()


def finding_cwes(findings: DataFrame, advisories: DataFrame, per_cve: bool = True) -> DataFrame:
    """Findings, or CVEs with their counts, expanded to weaknesses.

    The per-CVE form carries counts and not host lists: a CVE may be on every
    host, and the list would be copied to each of its weaknesses.
    """
    rows = findings
    if per_cve:
        rows = findings.groupBy("cve_id").agg(
            F.count_distinct("hostname").alias("hosts"), F.count_distinct("package").alias("packages"),
            F.max("epss").alias("epss"), F.count(F.lit(1)).alias("findings"))
    return rows.join(cve_cwes(advisories), "cve_id")


def technique_surface(cwes: DataFrame, attack: DataFrame) -> DataFrame:
    return cwes.join(attack.filter(present("technique")), "cwe")


def technique_kinds(attack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Techniques that the same weaknesses lead to, as one: its weaknesses (cwe, technique, n) and its members.

    Weaknesses with many techniques in common then expand to few rows. The
    kind goes by one of its members, written as JSON.
    """
    each = attack.filter(present("technique") & F.col("cwe").isNotNull()).groupBy("technique", "technique_name", "cwe").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("technique", "technique_name").agg(F.array_sort(F.collect_list(F.struct("cwe", "n"))).alias("_w"))
    member = F.struct("technique", "technique_name")
    kinds = each.groupBy("_w").agg(F.to_json(F.min(member)).alias("kind"), F.collect_list(member).alias("_m"))
    kinds = written(kinds, "kinds")
    weak = kinds.select(F.col("kind").alias("technique"), F.explode("_w").alias("_x")).select("technique", "_x.*")
    return written(weak, "kinds"), written(kinds.select("kind", F.explode("_m").alias("_x")).select("kind", "_x.*"), "kinds")


def technique_counts(cwes: DataFrame, attack: DataFrame) -> DataFrame:
    """Rows and findings per host and technique of the surface: ``n`` and ``findings``."""
    weak, members = technique_kinds(attack)
    rows = technique_surface(cwes.select("hostname", "finding_key", "cwe"), weak)
    rows = rows.groupBy("hostname", F.col("technique").alias("kind"), "finding_key").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("hostname", "kind").agg(F.sum("n").alias("n"), F.count("finding_key").alias("findings"))
    return rows.join(members, "kind").select("hostname", "technique", "technique_name", "n", "findings")


def tactic_matrix(surface: DataFrame, tactics: DataFrame) -> DataFrame:
    rows = surface.withColumn("tactic", F.explode(trimmed_list("tactics")))
    return lookup(rows, tactics, ["tactic"], ["tactic_name", "tactic_order"])


def kev_bridge(triaged: DataFrame, kevmap: DataFrame, advisories: DataFrame) -> DataFrame:
    """Techniques recorded for exploited CVEs, plus the impact a ransomware flag implies."""
    ransom = advisories.filter(F.lower("kev_ransomware") == "known").select("cve_id").distinct()
    implied = ransom.select(
        "cve_id", F.lit(RANSOM_TECHNIQUE[0]).alias("technique"), F.lit(RANSOM_TECHNIQUE[1]).alias("technique_name"),
        F.lit("ransomware_implication").alias("mapping_type"), F.lit(RANSOM_COMMENT).alias("comment"))
    mapped = kevmap.groupBy("cve_id", "technique", "mapping_type").agg(
        F.min("technique_name").alias("technique_name"), F.min("comment").alias("comment"))
    rows = triaged.join(mapped.unionByName(implied), "cve_id")
    kind = F.col("mapping_type")
    rows = rows.withColumn("map_role", F.when(kind == "exploitation_technique", "exploitation").when(
        kind == "primary_impact", "impact").when(kind == "secondary_impact", "impact-secondary").when(
        kind == "ransomware_implication", "implied").otherwise("other"))
    return rows.withColumns({
        "map_source": F.when(F.col("map_role") == "implied", "CISA KEV ransomware flag").otherwise("CTID KEV mapping"),
        "map_strength": F.when(F.col("map_role") == "exploitation", "recorded").when(
            F.col("map_role") == "implied", "implied").otherwise("recorded-impact")})


def cve_vectors(advisories: DataFrame) -> DataFrame:
    """The vector chosen per CVE, v3 preferred, in sorted order."""
    return advisories.filter(present("cvss_vector")).groupBy("cve_id").agg(
        preferred_vector(values("cvss_vector")).alias("cvss_vector"))


def vector_technique(letters: dict[str, Column]) -> Column:
    av, pr, ui, s = letters["av"], letters["pr"], letters["ui"], letters["s"]
    harmless = (letters["c"] == "N") & (letters["i"] == "N") & (letters["a"] == "N")
    return (F.when((av == "N") & (pr == "N") & (ui == "N"), "T1190")
            .when((av == "N") & (ui == "R"), "T1203").when(av == "A", "T1210")
            .when((av == "L") & (pr == "L") & (s == "C") & ~harmless, "T1068"))


def _per_cve(findings: DataFrame, reach: DataFrame, coverage: DataFrame, advisories: DataFrame) -> DataFrame:
    rows = with_reach(findings, reach, coverage).groupBy("cve_id").agg(
        F.max("reach_rank").alias("peak_reach"), F.count_distinct("hostname").alias("n_hosts"),
        F.max((F.col("confidence") == "high").cast("int")).alias("_high"))
    rows = lookup(rows, cve_vectors(advisories), ["cve_id"], ["cvss_vector"])
    return rows.withColumns({
        "confidence": F.when(F.col("_high") == 1, "high").otherwise("low"),
        "reach_class": reach_class_of(F.col("peak_reach"), "not assessed")}).drop("_high")


def attack_placement(findings: DataFrame, reach: DataFrame, coverage: DataFrame, advisories: DataFrame,
                     attack: DataFrame, tactics: DataFrame) -> DataFrame:
    """CVEs and hosts per technique, tactic, evidence source, reach and confidence.

    Three kinds of evidence place a CVE: its weakness chain, its CVSS vector,
    and an exposed port. Each also counts once under the source "any".
    """
    cves = _per_cve(findings, reach, coverage, advisories)
    weak = cve_cwes(advisories).groupBy("cve_id").agg(values("cwe").alias("_cwes"))
    # CVEs that the same evidence places are one row with counts before they meet the techniques.
    cves = lookup(cves, weak, ["cve_id"], ["_cwes"]).withColumns({
        "_vector": vector_technique(cvss_letters(F.col("cvss_vector"))), "_observed": F.col("peak_reach") >= 2})
    cves = cves.groupBy("_cwes", "_vector", "_observed", "reach_class", "confidence").agg(
        F.count("cve_id").alias("n_cves"), F.sum("n_hosts").alias("n_hosts"))
    cves = written(cves.withColumn("_profile", F.monotonically_increasing_id()), "profiles")
    base = ["_profile", "n_cves", "n_hosts", "reach_class", "confidence"]
    chain = cves.select(*base, F.explode("_cwes").alias("cwe")).join(attack.filter(present("technique")), "cwe")
    chain = chain.withColumn("tactic", F.explode(trimmed_list("tactics"))).select(
        *base, "technique", "technique_name", "map_source", "platforms", "tactic")
    names = F.create_map(*[F.lit(x) for k, v in VECTOR_TECHNIQUES.items() for x in (k, v[0])])
    steps = F.create_map(*[F.lit(x) for k, v in VECTOR_TECHNIQUES.items() for x in (k, v[1])])
    implied = cves.select(*base, F.explode(F.array(
        F.struct(F.col("_vector").alias("technique"), F.lit("cvss_vector").alias("map_source")),
        F.struct(F.when(F.col("_observed"), "T1190").alias("technique"), F.lit("observed").alias("map_source")),
    )).alias("_i")).select(*base, "_i.*").filter("technique is not null")
    implied = implied.select(
        *base, "technique", F.element_at(names, F.col("technique")).alias("technique_name"), "map_source",
        F.lit("").alias("platforms"), F.element_at(steps, F.col("technique")).alias("tactic"))
    rows = lookup(chain.unionByName(implied), tactics, ["tactic"], ["tactic_name", "tactic_order"])
    rows = rows.withColumn("map_source", F.explode(F.array("map_source", F.lit("any"))))
    # A tactic the tactic table does not list has no place in the matrix.
    rows = rows.filter(F.col("tactic_name").isNotNull())
    place = ["technique", "technique_name", "tactic_name", "tactic_order", "map_source", "reach_class", "confidence"]
    once = rows.groupBy(*place, "_profile").agg(F.first("n_cves").alias("n_cves"), F.sum("n_hosts").alias("n_hosts"),
                                                F.collect_set(F.nullif("platforms", F.lit(""))).alias("_on"))
    on = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_on"))))
    return once.groupBy(*place).agg(F.sum("n_cves").alias("cves"), F.sum("n_hosts").alias("hosts"), F.array_join(on, ", ").alias("platforms"))


def attack_ledger(findings: DataFrame, reach: DataFrame, coverage: DataFrame, advisories: DataFrame,
                  attack: DataFrame) -> DataFrame:
    """Per confidence, how many open CVEs each source places and how many none does."""
    cves = _per_cve(findings, reach, coverage, advisories)
    letters = cvss_letters(F.col("cvss_vector"))
    by_vector = (letters["av"] == "A") | ((letters["av"] == "N") & ((letters["ui"] == "R") | (
        (letters["pr"] == "N") & (letters["ui"] == "N"))))
    weak = cve_cwes(advisories).join(attack.filter(present("technique")), "cwe", "left").groupBy("cve_id").agg(
        F.max((F.col("map_source") == "capec").cast("int")).alias("c"),
        F.max((F.col("map_source") == "cwe_parent").cast("int")).alias("i"), F.lit(1).alias("hc"))
    rows = lookup(cves, weak, ["cve_id"], ["c", "i", "hc"]).fillna(0, ["c", "i", "hc"])
    rows = rows.withColumns({"v": F.coalesce(by_vector, F.lit(False)).cast("int"),
                             "o": (F.col("peak_reach") >= 2).cast("int")})
    c, i, v, o = (F.col(x) == 1 for x in "civo")
    out = rows.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("total_open_cves"), F.count_if(c | i | v | o).alias("placed_any"),
        F.count_if(c).alias("via_chain"), F.count_if(~c & i).alias("only_inherited"),
        F.count_if(~c & ~i & v).alias("only_vector"), F.count_if(~c & ~i & ~v & o).alias("only_observed"),
        F.count_if(F.col("hc") == 0).alias("no_cwe_at_all"))
    return out.withColumn("unplaced", F.col("total_open_cves") - F.col("placed_any"))


def attack_patterns(surface: DataFrame, capec: DataFrame) -> DataFrame:
    rows = surface.withColumn("capec", F.explode(trimmed_list("via_capec")))
    return rows.join(capec.select("capec", F.col("name").alias("capec_name"), F.col("abstraction").alias("capec_abstraction"),
                                  F.col("severity").alias("capec_severity"), F.col("likelihood").alias("capec_likelihood"),
                                  "prerequisites", "first_step"), "capec")


def mitigation_rows(triaged: DataFrame, advisories: DataFrame, attack: DataFrame, mitigations: DataFrame) -> DataFrame:
    cves = triaged.groupBy("cve_id").agg(F.max("reach_rank").alias("peak_reach"))
    rows = technique_surface(cves.join(cve_cwes(advisories), "cve_id"), attack)
    rows = rows.join(mitigations, "technique")
    return rows.withColumn("reach_class", reach_class_of(F.col("peak_reach"), "not assessed"))


def mitigation_coverage(triaged: DataFrame, advisories: DataFrame, attack: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Techniques and CVEs each mitigation covers, by reach."""
    rows = mitigation_rows(triaged, advisories, attack, mitigations)
    return rows.groupBy("mitigation", "mitigation_name", "reach_class").agg(
        F.count_distinct("technique").alias("techniques"), F.count_distinct("cve_id").alias("cves"),
        values("description").alias("description"))


FACT_TEXT = ("severity", "cvss_vector", "kev_added", "kev_due", "kev_ransomware", "kev_name", "kev_title",
             "kev_description", "kev_action")


def cve_facts(advisories: DataFrame, cve: str | None = None) -> DataFrame:
    """One row per CVE over its advisories: the longest title, first of each text, extremes of each number."""
    rows = advisories if cve is None else advisories.filter(F.col("cve_id") == cve)
    texts = [c for c in FACT_TEXT if c in rows.columns]
    has_cwes = "cwes" in rows.columns
    rows = rows.withColumns({c: F.nullif(c, F.lit("")) for c in texts})
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.struct(
        (-F.length("title")).alias("l"), F.col("title").alias("t"))))
    return rows.groupBy("cve_id").agg(
        F.coalesce(title, F.lit("")).alias("best_title"), F.max("cvss_score").alias("cvss_score"),
        *[F.coalesce(F.min(c), F.lit("")).alias(c) for c in texts],
        F.max("epss").alias("epss"),
        *([F.max("epss_percentile").alias("epss_percentile")] if "epss_percentile" in rows.columns else []),
        *([F.array_sort(F.array_distinct(F.flatten(F.collect_set("cwes")))).alias("cwes")] if has_cwes else []),
        F.coalesce(F.min("published"), F.lit("")).alias("published"),
        *([F.coalesce(F.max("modified"), F.lit("")).alias("modified")] if "modified" in rows.columns else []))


def search_cves(cvedetail: DataFrame, advisories: DataFrame, q: str) -> DataFrame:
    """Encyclopaedia search over product, description and id: every hit, the worst first."""
    text = q.lower()
    hit = F.lit(False)
    for c in ("products", "description", "cve_id"):
        hit = hit | F.lower(F.col(c)).contains(text)
    rows = cvedetail.filter(F.coalesce(hit, F.lit(False)))
    rows = lookup(rows, cve_facts(advisories), ["cve_id"], ["severity", "cvss_score", "epss", "kev_added"])
    return rows.select(
        "cve_id", F.split_part("products", F.lit("\n"), F.lit(1)).alias("product"), blank("severity").alias("severity"),
        "cvss_score", F.round(F.col("epss") * 100, 1).alias("epss_pct"),
        F.when(present("kev_added"), "yes").otherwise("").alias("kev"),
    ).orderBy(F.col("cvss_score").desc_nulls_last(), "cve_id")


def cve_fixes(ranges: DataFrame, cve: str | None = None) -> DataFrame:
    """Where each package is fixed, per distribution."""
    rows = ranges if cve is None else ranges.filter(F.col("cve_id") == cve)
    fixed = F.when(present("fixed"), F.col("fixed")).when(
        present("last_affected"), F.concat(F.lit("no fix; last affected "), "last_affected")).otherwise("no fix published")
    return rows.groupBy("cve_id", "ecosystem", "package", F.trim(F.concat_ws(" ", blank("distro"), blank("distro_release"))).alias("distribution")).agg(
        values_text(fixed, "; ").alias("fixed"),
        values_text(F.when(present("introduced"), F.col("introduced")).otherwise("any earlier version"), "; ").alias("introduced"))


def fix_graph(ranges: DataFrame, cve: str | None = None) -> DataFrame:
    """CVE to package to fix, as counted edges."""
    rows = (ranges if cve is None else ranges.filter(F.col("cve_id") == cve)).filter(present("fixed"))
    safe = lambda c: F.regexp_replace(c, r"[|]", "_")
    package = safe(F.concat_ws(" ", "ecosystem", "package"))
    where = F.when(present("distro"), F.concat(F.lit(" ("), "distro", F.lit(")"))).otherwise("")
    fix = safe(F.concat("package", F.lit(" "), "fixed", where))
    pair = lambda a, ak, b, bk: F.struct(a.alias("source"), F.lit(ak).alias("source_kind"), b.alias("target"), F.lit(bk).alias("target_kind"))
    edges = rows.select(F.explode(F.array(pair(F.col("cve_id"), "cve", package, "pkg"), pair(package, "pkg", fix, "fix"))).alias("e"))
    return edges.groupBy("e.source", "e.source_kind", "e.target", "e.target_kind").agg(F.count(F.lit(1)).alias("cves"))
