"""Advisory feeds normalised into advisories, ranges and not-affected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.functions.text import blank, let, present, try_double
from vulnspark.operators.generic import first_per_key
from vulnspark.operators.matching import CPE_ECOSYSTEM, cpe_key, cpe_parts

# Feed ecosystem name to component type.
OSV_TYPE = {
    "debian": "deb", "ubuntu": "deb", "alpine": "apk", "red hat": "rpm", "rocky linux": "rpm", "almalinux": "rpm",
    "suse": "rpm", "opensuse": "rpm", "amazon linux": "rpm", "npm": "npm", "pypi": "python", "go": "go-module",
    "maven": "java-archive", "nuget": "nuget", "rubygems": "gem", "crates.io": "rust-crate", "packagist": "composer",
    "hex": "hex", "pub": "dart-pub", "conan": "conan", "swifturl": "swift",
}
# The feed ecosystems that are distributions.
OSV_DISTROS = ("debian", "ubuntu", "alpine", "red hat", "rocky linux", "almalinux", "suse", "opensuse", "amazon linux")
# Release words that are no variant.
RELEASE_NOISE = ("lts", "kernel")
# Statuses that clear a package.
NOT_AFFECTED = ("not-affected", "not affected", "notaffected", "unaffected", "wontfix", "will-not-fix", "won't fix",
                "ignored", "no-dsa", "unimportant", "out-of-support-scope")

OSV_SCHEMA = (
    "id string, aliases array<string>, summary string, published string, modified string, withdrawn string, "
    "severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>, "
    "database_specific struct<severity:string>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,"
    "versions:array<string>,ecosystem_specific:struct<status:string>,database_specific:struct<status:string>>>")

_METRIC = "array<struct<baseSeverity:string,cvssData:struct<vectorString:string,baseScore:double,baseSeverity:string>>>"
NVD_SCHEMA = (
    "cve struct<id:string,published:string,lastModified:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV40:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "weaknesses:array<struct<description:array<struct<value:string>>>>,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,"
    "versionStartIncluding:string,versionEndExcluding:string,versionEndIncluding:string,versionStartExcluding:string>>>>>>>")

CVELIST_SCHEMA = (
    "cveMetadata struct<cveId:string,state:string,assignerShortName:string,datePublished:string>, "
    "containers struct<cna:struct<descriptions:array<struct<lang:string,value:string>>,"
    "affected:array<struct<vendor:string,product:string>>,"
    "problemTypes:array<struct<descriptions:array<struct<cweId:string>>>>>>")

KEV_SCHEMA = (
    "vulnerabilities array<struct<cveID:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string,"
    "vendorProject:string,product:string,vulnerabilityName:string,shortDescription:string,requiredAction:string,notes:string>>")


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV records, one JSON document per file or line."""
    return spark.read.schema(OSV_SCHEMA).json(path)


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NVD_SCHEMA).json(path)


def extract_cve(own_id: Column, aliases: Column) -> Column:
    """The first CVE id among the aliases and then in the own id, upper case; empty when there is none."""
    text = F.concat_ws(" ", F.coalesce(aliases, F.array().cast("array<string>")), own_id)
    return F.upper(F.regexp_extract(text, r"(?i)CVE-\d{4}-\d{4,}", 0))


def split_ecosystem(c: Column) -> Column:
    """struct(type, distro, release, variant) of a feed ecosystem such as ``Ubuntu:Pro:22.04:LTS``."""
    types = F.create_map(*[F.lit(x) for kv in OSV_TYPE.items() for x in kv])
    base = F.lower(F.trim(F.split_part(F.trim(blank(c)), F.lit(":"), F.lit(1))))
    rest = F.when(c.contains(":"), F.regexp_replace(F.trim(c), r"^[^:]*:", "")).otherwise("")
    tokens = F.filter(F.transform(F.split(rest, ":"), lambda t: F.trim(t)), lambda t: t != "")

    def fields(ts: Column, name: Column) -> Column:
        is_release = lambda t: t.rlike(r"^v?\d+(?:\.\d+)*$")
        place = F.array_position(F.transform(ts, is_release), F.lit(True))
        release = F.when(place > 0, F.regexp_replace(F.get(ts, (place - 1).cast("int")), "^[vV]+", "")).otherwise("")
        words = F.filter(ts, lambda t, i: (i + 1 != place) & ~F.lower(t).isin(*RELEASE_NOISE))
        return F.struct(
            F.coalesce(F.try_element_at(types, name), name).alias("type"),
            F.when(name.isin(*OSV_DISTROS), name).otherwise("").alias("distro"), release.alias("release"),
            F.array_join(F.transform(words, F.lower), ":").alias("variant"))

    return let(tokens, lambda ts: let(base, lambda name: fields(ts, name)))


def osv_advisories(df: DataFrame, feed_source: str = "osv", withdrawn: bool = False) -> DataFrame:
    """One advisory row per record; withdrawn ones are left out unless asked for."""
    rows = df.filter(present("id"))
    rows = rows if withdrawn else rows.filter(~present("withdrawn"))
    cvss = F.get(F.filter("severity", lambda s: F.upper(s["type"]).startswith("CVSS")), F.lit(0))["score"]
    link = F.get(F.filter("references", lambda r: r["type"] == "ADVISORY"), F.lit(0))["url"]
    cve = extract_cve(F.col("id"), F.col("aliases"))
    return rows.select(
        F.col("id").alias("advisory_id"), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != "").alias("aliases"),
        F.when(cve != "", cve).otherwise(F.col("id")).alias("cve_id"), F.trim(blank("summary")).alias("title"),
        F.lower(blank("database_specific.severity")).alias("severity"), F.lit(None).cast("double").alias("cvss_score"),
        blank(cvss).alias("cvss_vector"), F.array().cast("array<string>").alias("cwes"), blank("published").alias("published"),
        blank("modified").alias("modified"), blank("withdrawn").alias("withdrawn"), F.lit(feed_source).alias("feed_source"),
        blank(link).alias("url"))


def _affected(df: DataFrame, feed_source: str, withdrawn: bool) -> DataFrame:
    rows = df.filter(present("id"))
    rows = rows if withdrawn else rows.filter(~present("withdrawn"))
    cve = extract_cve(F.col("id"), F.col("aliases"))
    rows = rows.select(F.col("id").alias("advisory_id"), F.when(cve != "", cve).otherwise(F.col("id")).alias("cve_id"),
                       F.posexplode("affected").alias("_pos", "a"))
    rows = rows.withColumns({"_name": F.trim(blank("a.package.name")), "_e": split_ecosystem(F.col("a.package.ecosystem")),
                             "status": F.lower(F.trim(F.coalesce("a.ecosystem_specific.status", "a.database_specific.status", F.lit(""))))})
    rows = rows.filter("_name <> ''")
    return rows.select(
        "advisory_id", "cve_id", "_pos", "a", "status", F.col("_e.type").alias("ecosystem"), F.lower("_name").alias("package"),
        F.col("_name").alias("package_display"), F.col("_e.distro").alias("distro"), F.col("_e.release").alias("distro_release"),
        F.col("_e.variant").alias("distro_variant"), F.when(F.col("_e.distro") != "", F.lower("_name")).otherwise("").alias("source_package"),
        F.lit(feed_source).alias("feed_source"))


def _last_event(events: Column, field: str) -> Column:
    """The last event that names a field, under the rule that one event means its first named field."""
    earlier = {"introduced": (), "fixed": ("introduced",), "last_affected": ("introduced", "fixed")}[field]

    def counts(e: Column) -> Column:
        test = e[field].isNotNull()
        for other in earlier:
            test = test & e[other].isNull()
        return test
    return blank(F.try_element_at(F.filter(events, counts), F.lit(-1))[field])


def _intervals(rng: Column) -> Column:
    """The range cut before every introduced event but the first: one struct of type and events for each interval.

    With at most one introduced event the order of events does not matter, so all of them are one interval.
    """
    def cut(events: Column, starts: Column) -> Column:
        first = F.transform(starts, lambda p, i: F.when(i == 0, 1).otherwise(p + 1))
        pieces = F.transform(starts, lambda p, i: F.slice(events, F.get(first, i), F.coalesce(F.get(first, i + 1), F.size(events) + 1) - F.get(first, i)))
        return F.transform(F.when(F.size(starts) > 1, pieces).otherwise(F.array(events)), lambda e: F.struct(rng["type"].alias("type"), e.alias("events")))

    events = F.coalesce(rng["events"], F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>"))
    places = F.filter(F.transform(events, lambda e, i: F.when(e["introduced"].isNotNull(), i)), lambda p: p.isNotNull())
    return let(places, lambda starts: cut(events, starts))


def _range_columns(rng: Column) -> Column:
    introduced = _last_event(rng["events"], "introduced")
    return F.struct(
        introduced.alias("raw"), F.when(introduced == "0", "").otherwise(introduced).alias("introduced"),
        _last_event(rng["events"], "fixed").alias("fixed"), _last_event(rng["events"], "last_affected").alias("last_affected"),
        F.upper(F.coalesce(rng["type"], F.lit("ECOSYSTEM"))).alias("range_type"))


def osv_ranges(df: DataFrame, feed_source: str = "osv", withdrawn: bool = False) -> DataFrame:
    """Range rows; a package without a usable range is listed version by version instead.

    Each introduced event opens an interval of its own, a row each. Introduced
    zero is no bound, and a range of commits without an end is dropped.
    """
    rows = _affected(df, feed_source, withdrawn).filter(~F.col("status").isin(*NOT_AFFECTED))
    ranges = F.flatten(F.transform(F.coalesce("a.ranges", F.array().cast(
        "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>")), _intervals))
    ranges = F.transform(ranges, _range_columns)
    usable = F.filter(ranges, lambda r: (
        ((r["raw"] != "") | (r["fixed"] != "") | (r["last_affected"] != ""))
        & ((r["range_type"] != "GIT") | (r["fixed"] != "") | (r["last_affected"] != ""))))
    exact = F.transform(F.coalesce("a.versions", F.array().cast("array<string>")), lambda v: F.struct(
        v.alias("raw"), v.alias("introduced"), F.lit("").alias("fixed"), v.alias("last_affected"), F.lit("EXACT").alias("range_type")))
    rows = rows.withColumn("_r", F.explode(let(usable, lambda u: F.when(F.size(u) > 0, u).otherwise(exact))))
    return rows.select(
        "ecosystem", "package", "package_display", "advisory_id", "cve_id", F.col("_r.introduced").alias("introduced"),
        F.lit("").alias("introduced_excluding"), F.col("_r.fixed").alias("fixed"), F.col("_r.last_affected").alias("last_affected"),
        "distro", "distro_release", "distro_variant", "source_package", "feed_source", F.col("_r.range_type").alias("range_type"),
        F.lit("affected").alias("status"))


def osv_exact(df: DataFrame, feed_source: str = "osv") -> DataFrame:
    return osv_ranges(df, feed_source).filter("range_type = 'EXACT'")


def osv_notaffected(df: DataFrame, feed_source: str = "osv", withdrawn: bool = False) -> DataFrame:
    rows = _affected(df, feed_source, withdrawn).filter(F.col("status").isin(*NOT_AFFECTED))
    return rows.select("ecosystem", "package", "advisory_id", "distro", "distro_release", "distro_variant", "status",
                       F.col("status").alias("reason"))


# Metric versions from the best to the worst.
METRICS = ("cvssMetricV31", "cvssMetricV40", "cvssMetricV30", "cvssMetricV2")


def nvd_advisories(df: DataFrame, feed_source: str = "nvd") -> DataFrame:
    """NVD records as advisories, from the best metric version present."""
    rows = df.select("cve.*").filter(present("id"))
    first = F.coalesce(*[F.get(f"metrics.{m}", F.lit(0)) for m in METRICS])
    title = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    cwes = F.flatten(F.transform(F.coalesce("weaknesses", F.array().cast("array<struct<description:array<struct<value:string>>>>")),
                                 lambda w: F.transform(w["description"], lambda d: F.upper(F.trim(d["value"])))))
    return rows.select(
        F.col("id").alias("advisory_id"), F.array().cast("array<string>").alias("aliases"), F.col("id").alias("cve_id"),
        F.trim(blank(title)).alias("title"),
        F.lower(F.coalesce(F.nullif(first["cvssData"]["baseSeverity"], F.lit("")), first["baseSeverity"], F.lit(""))).alias("severity"),
        first["cvssData"]["baseScore"].alias("cvss_score"), blank(first["cvssData"]["vectorString"]).alias("cvss_vector"),
        F.array_distinct(F.filter(cwes, lambda c: c.startswith("CWE-"))).alias("cwes"), blank("published").alias("published"),
        blank("lastModified").alias("modified"), F.lit("").alias("withdrawn"), F.lit(feed_source).alias("feed_source"),
        F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "id").alias("url"))


def nvd_ranges(df: DataFrame, feed_source: str = "nvd") -> DataFrame:
    """CPE ranges: explicit bounds, or one version when the CPE names it; unbounded ones are dropped."""
    rows = df.select(F.col("cve.id").alias("cve_id"), F.explode("cve.configurations").alias("c"))
    rows = rows.select("cve_id", F.explode("c.nodes").alias("n")).select("cve_id", F.explode("n.cpeMatch").alias("m"))
    rows = rows.filter("m.vulnerable").withColumns({"package": cpe_key(F.col("m.criteria")), "_p": cpe_parts(F.col("m.criteria"))})
    rows = rows.filter("package is not null")
    bounds = {"introduced": "versionStartIncluding", "fixed": "versionEndExcluding", "last_affected": "versionEndIncluding",
              "introduced_excluding": "versionStartExcluding"}
    rows = rows.withColumns({n: blank(f"m.{src}") for n, src in bounds.items()})
    rows = rows.withColumns({"_open": F.concat(*bounds) == "", "_exact": F.get("_p", F.lit(3))})
    rows = rows.filter(~F.col("_open") | ~F.col("_exact").isin("*", "-", ""))
    rows = rows.withColumns({c: F.when(F.col("_open"), F.col("_exact")).otherwise(F.col(c)) for c in ("introduced", "last_affected")})
    out = rows.select(
        F.lit(CPE_ECOSYSTEM).alias("ecosystem"), "package",
        F.concat(F.get("_p", F.lit(1)), F.lit(" "), F.get("_p", F.lit(2))).alias("package_display"), F.col("cve_id").alias("advisory_id"),
        "cve_id", *bounds, *[F.lit("").alias(c) for c in ("distro", "distro_release", "distro_variant", "source_package")],
        F.lit(feed_source).alias("feed_source"), F.lit("CPE").alias("range_type"), F.lit("affected").alias("status"),
        F.coalesce(F.get("_p", F.lit(8)), F.lit("*")).alias("target_sw"))
    return out.dropDuplicates(["cve_id", "package", *bounds])


def kev(df: DataFrame) -> DataFrame:
    """The exploited-vulnerability catalogue keyed by CVE, the last entry winning."""
    rows = df.select(F.posexplode("vulnerabilities").alias("pos", "v")).withColumn("cve_id", F.upper(blank("v.cveID"))).filter("cve_id <> ''")
    rows = first_per_key(rows, ["cve_id"], F.col("pos").desc())
    text = lambda c: F.trim(blank(f"v.{c}"))
    return rows.select(
        "cve_id", blank("v.dateAdded").alias("kev_added"), blank("v.dueDate").alias("kev_due"),
        blank("v.knownRansomwareCampaignUse").alias("kev_ransomware"), text("vendorProject").alias("kev_vendor"),
        text("product").alias("kev_product"), F.trim(F.concat(text("vendorProject"), F.lit(" "), text("product"))).alias("kev_name"),
        text("vulnerabilityName").alias("kev_title"), text("shortDescription").alias("kev_description"),
        text("requiredAction").alias("kev_action"), text("notes").alias("kev_notes"))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """The EPSS CSV: a comment line, then a header."""
    return spark.read.option("header", True).option("comment", "#").csv(path)


def epss(df: DataFrame) -> DataFrame:
    return df.filter(present("cve")).select(F.upper("cve").alias("cve_id"), try_double("epss").alias("epss"),
                                            try_double("percentile").alias("epss_percentile"))


def cvelist(df: DataFrame) -> DataFrame:
    """CVE-program records as encyclopaedia rows; rejected and empty ones are left out."""
    cna = "containers.cna"
    english = F.get(F.filter(f"{cna}.descriptions", lambda d: F.lower(d["lang"]).startswith("en")), F.lit(0))["value"]

    def product(a: Column) -> Column:
        name, vendor = F.trim(blank(a["product"])), F.trim(blank(a["vendor"]))
        prefixed = (vendor != "") & (vendor != "n/a") & ~F.startswith(F.lower(name), F.lower(vendor))
        return F.when(~name.isin("", "n/a"), F.when(prefixed, F.concat(vendor, F.lit(" "), name)).otherwise(name))

    none_a = F.array().cast("array<struct<vendor:string,product:string>>")
    products = F.array_distinct(F.filter(F.transform(F.coalesce(f"{cna}.affected", none_a), product), lambda x: x.isNotNull()))
    none_p = F.array().cast("array<struct<descriptions:array<struct<cweId:string>>>>")
    cwes = F.flatten(F.transform(F.coalesce(f"{cna}.problemTypes", none_p), lambda p: F.transform(p["descriptions"], lambda d: F.trim(blank(d["cweId"])))))
    rows = df.withColumns({"cve_id": F.upper(blank("cveMetadata.cveId")), "_products": products, "description": F.trim(blank(english))})
    rows = rows.filter((F.col("cve_id") != "") & (F.upper(blank("cveMetadata.state")) != "REJECTED"))
    rows = rows.filter((F.col("description") != "") | (F.size("_products") > 0))
    return rows.select(
        "cve_id", "description", F.array_join("_products", "\n").alias("products"),
        F.array_join(F.array_distinct(F.filter(cwes, lambda c: c != "")), ",").alias("cwes"),
        F.trim(blank("cveMetadata.assignerShortName")).alias("assigner"),
        F.substring(blank("cveMetadata.datePublished"), 1, 10).alias("published"))


def overlay(advisories: DataFrame, nvd: DataFrame, kev_rows: DataFrame, epss_rows: DataFrame, source_order: str = "source_order") -> DataFrame:
    """One row per advisory, the earlier source winning, with weaknesses, KEV and EPSS laid over by CVE."""
    order = [F.col(source_order)] if source_order in advisories.columns else []
    rows = first_per_key(advisories, ["advisory_id"], *order, F.col("feed_source"), F.col("modified").desc())
    weak = nvd.filter(F.size("cwes") > 0).groupBy("cve_id").agg(F.min("cwes").alias("_nvd_cwes"))
    rows = rows.join(weak, "cve_id", "left").join(kev_rows, "cve_id", "left").join(epss_rows, "cve_id", "left")
    return rows.withColumn("cwes", F.when(F.size(F.coalesce("cwes", F.array().cast("array<string>"))) > 0, F.col("cwes")).otherwise(
        F.col("_nvd_cwes"))).drop("_nvd_cwes")
