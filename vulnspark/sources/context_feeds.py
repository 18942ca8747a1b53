"""Context feeds: weaknesses, attack patterns, techniques, Windows updates, support ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import blank, present
from vulnspark.operators.generic import first_per_key, lookup, values

DONORS = ("Class", "Base", "Variant", "Compound")
_REFS = "array<struct<source_name:string,external_id:string>>"
STIX_SCHEMA = (
    f"objects array<struct<type:string,id:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,"
    f"external_references:{_REFS},kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "x_mitre_platforms:array<string>,x_mitre_shortname:string,tactic_refs:array<string>,relationship_type:string,"
    "source_ref:string,target_ref:string>>")
KEV_ATTACK_SCHEMA = (
    "mapping_objects array<struct<capability_id:string,attack_object_id:string,attack_object_name:string,"
    "mapping_type:string,comments:string>>")
MSRC_SCHEMA = (
    "released string, ProductTree struct<FullProductName:array<struct<ProductID:string,Value:string>>>, "
    "Vulnerability array<struct<CVE:string,Remediations:array<struct<Description:struct<Value:string>,FixedBuild:string,"
    "SubType:string,Supercedence:string,ProductID:array<string>>>>>")
EOL_SCHEMA = (
    "result array<struct<name:string,label:string,category:string,releases:array<struct<name:string,codename:string,"
    "releaseDate:string,eolFrom:string,eoesFrom:string,isLts:boolean,isEol:boolean,isMaintained:boolean,latest:struct<name:string>>>>>")


def csv_column(df: DataFrame, *names: str) -> Column:
    """The first of several spellings of a CSV column."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def cwe_capec(df: DataFrame) -> DataFrame:
    """Weakness to attack pattern, from the ``::21::59::`` list."""
    parts = F.filter(F.transform(F.split(blank(csv_column(df, "Related Attack Patterns")), "::"), lambda t: F.trim(t)), lambda p: p.rlike(r"^\d+$"))
    return df.select(F.concat(F.lit("CWE-"), F.trim(csv_column(df, "CWE-ID"))).alias("cwe"), F.explode(parts).alias("capec"))


def capec_id(df: DataFrame) -> Column:
    return F.regexp_replace(F.trim(blank(csv_column(df, "'ID", "ID"))), "^'+", "")


def capec_attack(df: DataFrame) -> DataFrame:
    """Attack pattern to technique, from the taxonomy mapping text."""
    entry = r"(?is)TAXONOMY NAME:ATTACK:ENTRY ID:([^:]+):ENTRY NAME:(.*?)(?:::|$)"
    text = blank(csv_column(df, "Taxonomy Mappings"))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(entry), F.lit(1)).alias("i"), F.regexp_extract_all(text, F.lit(entry), F.lit(2)).alias("n"))
    rows = df.select(capec_id(df).alias("capec"), F.explode(pairs).alias("p"))
    tid = F.trim("p.i")
    return rows.filter((F.col("capec") != "") & (tid != "")).select(
        "capec", F.when(F.upper(tid).startswith("T"), tid).otherwise(F.concat(F.lit("T"), tid)).alias("technique"), F.trim("p.n").alias("name"))


def canonical_names(capec_techniques: DataFrame) -> DataFrame:
    """The most frequent name of each technique, then the longest, then the first."""
    rows = capec_techniques.withColumn("name", F.regexp_replace(F.trim("name"), r"\s*:\s*", ": ")).filter("name <> ''")
    counted = rows.groupBy("technique", "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("technique").agg(F.min_by("name", F.struct(
        (-F.col("n")).alias("n"), (-F.length("name")).alias("l"), F.col("name").alias("t"))).alias("name"))


def stix_objects(df: DataFrame) -> DataFrame:
    """Objects of STIX bundles, one row each, with their place in the bundle."""
    return df.select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")


def mitre_id() -> Column:
    return F.trim(blank(F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]))


def attack_tactics(objects: DataFrame) -> DataFrame:
    """Tactics in the order the first matrix lists them."""
    matrix = first_per_key(objects.filter("type = 'x-mitre-matrix'").withColumn("_k", F.lit(1)), ["_k"], F.col("pos"))
    refs = matrix.select(F.posexplode("tactic_refs").alias("tactic_order", "id"))
    named = objects.filter("type = 'x-mitre-tactic'").select("id", F.col("x_mitre_shortname").alias("tactic"), F.coalesce("name", "x_mitre_shortname").alias("tactic_name"))
    rows = refs.join(named, "id").filter(present("tactic"))
    return first_per_key(rows, ["tactic"], F.col("tactic_order")).select("tactic", "tactic_name", "tactic_order")


def attack_techniques(objects: DataFrame, tactics: DataFrame) -> DataFrame:
    """Live techniques with their tactics in matrix order and their platforms."""
    rows = objects.filter("type = 'attack-pattern' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)")
    rows = rows.withColumn("technique", mitre_id()).filter("technique <> ''")
    phases = rows.select("technique", F.posexplode("kill_chain_phases").alias("p", "k")).filter(
        "k.kill_chain_name = 'mitre-attack'").filter(present("k.phase_name")).select("technique", "p", F.col("k.phase_name").alias("tactic"))
    phases = lookup(phases, tactics, ["tactic"], ["tactic_order"]).groupBy("technique", "tactic").agg(
        F.min(F.struct(F.coalesce("tactic_order", F.lit(999)).alias("o"), F.col("p"))).alias("_o"))
    ordered = phases.groupBy("technique").agg(F.array_sort(F.collect_list(F.struct("_o", "tactic"))).alias("_t")).select(
        "technique", F.transform("_t", lambda t: t["tactic"]).alias("tactics"))
    platforms = F.array_distinct(F.filter(F.transform(F.coalesce("x_mitre_platforms", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda x: x != ""))
    out = rows.select("pos", "technique", F.trim(blank("name")).alias("name"), platforms.alias("platforms"))
    out = first_per_key(out, ["technique"], F.col("pos").desc()).drop("pos")
    return lookup(out, ordered, ["technique"], ["tactics"])


def attack_rows(weak: DataFrame, patterns: DataFrame, techniques: DataFrame) -> DataFrame:
    """Weakness to technique with the patterns that link them; the technique's own name wins."""
    rows = weak.join(patterns, "capec").groupBy("cwe", "technique").agg(values("capec").alias("via_capec"), F.min("name").alias("_entry"))
    rows = lookup(rows, canonical_names(patterns), ["technique"], {"name": "_usual"})
    rows = lookup(rows, techniques, ["technique"], {"name": "_own", "tactics": "_tactics", "platforms": "_platforms"})
    return rows.select(
        "cwe", "technique", F.coalesce(F.nullif("_own", F.lit("")), "_usual", "_entry").alias("technique_name"), F.lit("capec").alias("map_source"),
        F.lit("").alias("inherited_from"), F.lit(0).alias("inherit_depth"), blank(F.array_join("_tactics", ",")).alias("tactics"),
        blank(F.array_join("_platforms", ",")).alias("platforms"), "via_capec")


def cwe_hierarchy(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weakness and abstraction, weakness and parent) in the research view."""
    cwe = F.concat(F.lit("CWE-"), F.trim(csv_column(df, "CWE-ID")))
    kinds = df.filter(F.trim(blank(csv_column(df, "CWE-ID"))) != "").select(cwe.alias("cwe"), F.trim(blank(csv_column(df, "Weakness Abstraction"))).alias("abstraction"))
    ids = F.regexp_extract_all(blank(csv_column(df, "Related Weaknesses")), F.lit(r"NATURE:ChildOf:CWE ID:(\d+):VIEW ID:1000(?::|$)"), F.lit(1))
    links = df.select(cwe.alias("cwe"), F.explode(F.array_distinct(ids)).alias("p")).select("cwe", F.concat(F.lit("CWE-"), "p").alias("parent"))
    return kinds, links


def inherited_attack_rows(direct: DataFrame, kinds: DataFrame, links: DataFrame) -> DataFrame:
    """Techniques of the nearest mapped ancestors, at most two levels up.

    A pillar neither inherits nor gives. Ancestors at the second level are
    used only when none at the first level gives anything.
    """
    donors = kinds.filter(F.col("abstraction").isin(*DONORS)).select(F.col("cwe").alias("parent"))
    mapped = direct.select(F.col("cwe").alias("donor"), *[c for c in direct.columns if c not in ("cwe", "inherited_from", "inherit_depth", "map_source")])
    leaves = kinds.filter("abstraction <> 'Pillar'").join(direct.select("cwe").distinct(), "cwe", "left_anti").select("cwe")
    first = leaves.join(links, "cwe").join(donors, "parent")
    one = first.select("cwe", F.col("parent").alias("donor")).join(mapped, "donor").withColumn("depth", F.lit(1))
    up = first.join(one.select("cwe").distinct(), "cwe", "left_anti").select("cwe", F.col("parent").alias("middle"))
    second = up.join(links.select(F.col("cwe").alias("middle"), "parent"), "middle").join(donors, "parent")
    two = second.select("cwe", F.col("parent").alias("donor")).distinct().join(mapped, "donor").withColumn("depth", F.lit(2))
    rows = one.unionByName(two).groupBy("cwe", "technique").agg(
        F.min("technique_name").alias("technique_name"), F.array_join(values("donor"), ",").alias("inherited_from"),
        F.min("depth").alias("inherit_depth"), F.min("tactics").alias("tactics"), F.min("platforms").alias("platforms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("via_capec")))).alias("via_capec"))
    return rows.withColumn("map_source", F.lit("cwe_parent"))


def capec_detail(df: DataFrame) -> DataFrame:
    """Prose of each attack pattern: whole prerequisites and the first step."""
    step = F.regexp_extract(blank(csv_column(df, "Execution Flow")), r"(?s)DESCRIPTION:(.*?)(?::TECHNIQUE:|::STEP:|$)", 1)
    text = lambda *names: F.trim(blank(csv_column(df, *names)))
    return df.select(
        capec_id(df).alias("capec"), text("Name").alias("name"), text("Abstraction").alias("abstraction"), text("Typical Severity").alias("severity"),
        text("Likelihood Of Attack").alias("likelihood"),
        F.trim(F.regexp_replace(text("Prerequisites"), r"\s*::\s*", " ")).alias("prerequisites"),
        F.regexp_replace(F.trim(step), r"^[: ]+|[: ]+$", "").alias("first_step")).filter("capec <> ''")


def attack_mitigations(objects: DataFrame) -> DataFrame:
    actions = objects.filter("type = 'course-of-action'").select(F.col("id").alias("source_ref"), mitre_id().alias("mitigation"), F.trim(blank("name")).alias("mitigation_name"))
    targets = objects.filter("type = 'attack-pattern'").select(F.col("id").alias("target_ref"), mitre_id().alias("technique"))
    links = objects.filter("type = 'relationship' and relationship_type = 'mitigates'").select("source_ref", "target_ref", "description")
    rows = links.join(actions.filter("mitigation <> ''"), "source_ref").join(targets.filter("technique <> ''"), "target_ref")
    return rows.select("technique", "mitigation", "mitigation_name", F.trim(blank("description")).alias("description"))


def kev_attack(df: DataFrame) -> DataFrame:
    """Exploited CVE to technique."""
    rows = df.select(F.explode("mapping_objects").alias("m"))
    text = lambda c: F.trim(blank(f"m.{c}"))
    rows = rows.select(F.upper(text("capability_id")).alias("cve_id"), text("attack_object_id").alias("technique"), text("attack_object_name").alias("technique_name"),
                       text("mapping_type").alias("mapping_type"), text("comments").alias("comment"))
    return rows.filter(F.col("cve_id").startswith("CVE-") & (F.col("technique") != ""))


BASE_OS = r"(?i)^Windows (?:1[01](?: Version \S+)?|Server(?: \d{4}| Version \S+)?)\b"


def msrc(df: DataFrame) -> DataFrame:
    """One row per update, branch and edition: highest build, products and CVEs, base OS only."""
    rows = df.select("released", F.col("ProductTree.FullProductName").alias("names"), F.explode("Vulnerability").alias("v"))
    rows = rows.select("released", "names", F.trim(blank("v.CVE")).alias("cve"), F.explode("v.Remediations").alias("r"))
    rows = rows.withColumns({"kb": F.trim(blank("r.Description.Value")), "fixed_build": F.trim(blank("r.FixedBuild"))})
    build = r"^10\.0\.(\d+)\.(\d+)$"
    rows = rows.filter(F.col("kb").rlike(r"^\d+$") & F.col("fixed_build").rlike(build))
    listed = F.filter("names", lambda n: F.array_contains("r.ProductID", n["ProductID"]) & F.trim(n["Value"]).rlike(BASE_OS))
    rows = rows.withColumn("product_name", F.explode(F.transform(listed, lambda n: F.trim(n["Value"]))))
    supersedes = F.trim(blank("r.Supercedence"))
    rows = rows.select(
        F.concat(F.lit("KB"), "kb").alias("kb"), F.regexp_extract("fixed_build", build, 1).alias("branch"),
        F.when(F.lower("product_name").startswith("windows server"), "server").otherwise("client").alias("edition"),
        F.regexp_extract("fixed_build", build, 2).cast("bigint").alias("ubr"), "fixed_build", "released", "cve", "product_name",
        F.trim(blank("r.SubType")).alias("subtype"),
        F.when((supersedes == "") | F.upper(supersedes).startswith("KB"), supersedes).otherwise(F.concat(F.lit("KB"), supersedes)).alias("supersedes"))
    label = F.trim(F.regexp_replace("product_name", r"(?i)\s+for\s+\S+-based\s+Systems\s*$", ""))
    out = rows.groupBy("kb", "branch", "edition").agg(
        F.max("ubr").alias("ubr"), F.max_by("fixed_build", "ubr").alias("fixed_build"), F.min("released").alias("released"),
        F.min("subtype").alias("subtype"), F.min("supersedes").alias("supersedes"), F.min(label).alias("product"),
        values("product_name").alias("_p"), values(F.nullif("cve", F.lit(""))).alias("_c"))
    return out.withColumns({"products_text": F.array_join("_p", ";"), "n_products": F.size("_p"), "cves_text": F.array_join("_c", ","),
                            "n_cves": F.size("_c")}).drop("_p", "_c")


def eol(df: DataFrame) -> DataFrame:
    """One row per product release series of the end-of-life catalogue."""
    rows = df.select(F.explode("result").alias("p")).filter(present("p.name")).select("p", F.explode("p.releases").alias("r")).filter(present("r.name"))
    flag = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(False)).cast("int")
    slug, cycle = F.trim("p.name"), F.trim("r.name")
    return rows.select(
        slug.alias("product"), F.coalesce("p.label", slug).alias("label"), blank("p.category").alias("category"), cycle.alias("cycle"),
        blank("r.codename").alias("codename"), blank("r.releaseDate").alias("released"), blank("r.eolFrom").alias("eol_from"),
        blank("r.eoesFrom").alias("eoes_from"), flag("isLts").alias("lts"), blank("r.latest.name").alias("latest"),
        flag("isEol").alias("eol_at_build"), flag("isMaintained").alias("maintained_at_build"))
