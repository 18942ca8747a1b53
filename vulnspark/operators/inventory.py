"""Host and inventory state: snapshots, digests, cadence, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnspark.functions.text import (
    age_days, blank, commas, duration_text, empty_to_null, extract, md5_prefix_number, percent, present, stamp_text,
    try_long, unescape_path,
)
from vulnspark.operators.generic import (
    carry_forward, drop_retired, first_per_key, latest, lookup, newest_rows, replace_reported,
    values, values_text, with_group,
)
from vulnspark.operators.identity import optional, primary_path, with_role
from vulnspark.operators.matching import component_hash
from vulnspark.params import DAY, Params

# Component types no advisory feed covers.
NO_FEED_TYPES = ("linux-kernel-module", "linux-kernel", "github-action", "github-action-workflow", "binary", "hotfix")

INVENTORY_FIELDS = ("role", "role_source", "role_evidence", "version", "purl", "locations", "cpes", "os_id",
                    "os_version_id", "vendor", "source_package", "owned_by")


def latest_inventory(components: DataFrame, role: bool = True) -> DataFrame:
    """The newest value of every field per component, for components of the host's newest scan."""
    rows = components.withColumn("path", primary_path(components)).withColumn("root", blank(optional(components, "root")))
    rows = with_role(rows) if role else rows
    key = ["hostname", "name", "type", "path", "root"]
    fields = [c for c in INVENTORY_FIELDS if c in rows.columns]
    grouped = rows.groupBy(*key).agg(*[latest(c, "scanned_at").alias(c) for c in fields],
                                     F.max("scanned_at").alias("scanned_at"))
    # The host's newest scan comes from two columns of the input, not from a second pass over the groups.
    newest = components.groupBy("hostname").agg(F.max("scanned_at").alias("_newest"))
    return grouped.join(newest, "hostname").filter(F.col("scanned_at") >= F.col("_newest")).drop("_newest")


def inventory_digest(latest_rows: DataFrame) -> DataFrame:
    """Order-insensitive digest and size of each host's inventory."""
    return latest_rows.groupBy("hostname").agg(
        F.sum(component_hash()).alias("digest"), F.count(F.lit(1)).alias("n_components"),
        F.max("scanned_at").alias("scanned_at"))


def host_heartbeat(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("hostname").agg(
        latest("digest", "scanned_at").alias("digest"), latest("n_components", "scanned_at").alias("n_components"),
        F.max("scanned_at").alias("scanned_at"))


def host_digest(heartbeats: DataFrame, latest_rows: DataFrame) -> DataFrame:
    """The heartbeat's digest when it is at least as new as the computed one."""
    hb = host_heartbeat(heartbeats).select("hostname", *[
        F.col(c).alias(f"hb_{c}") for c in ("digest", "n_components", "scanned_at")])
    calc = inventory_digest(latest_rows).select("hostname", *[
        F.col(c).alias(f"calc_{c}") for c in ("digest", "n_components", "scanned_at")])
    both = hb.join(calc, "hostname", "full")
    use = F.col("hb_digest").isNotNull() & (
        F.col("calc_scanned_at").isNull() | (F.col("hb_scanned_at") >= F.col("calc_scanned_at")))
    return both.select(
        "hostname",
        F.when(use, F.col("hb_digest")).otherwise(F.col("calc_digest")).alias("digest"),
        F.when(use, F.col("hb_n_components")).otherwise(F.col("calc_n_components")).alias("n_components"),
        F.greatest("hb_scanned_at", "calc_scanned_at").alias("scanned_at"),
        F.when(use, "heartbeat").otherwise("computed").alias("digest_source")).filter("digest is not null")


def rematch_floor(host: Column, now: int) -> Column:
    """The oldest acceptable match time: one day plus a fixed per-host spread of up to another."""
    return F.lit(now - DAY) - md5_prefix_number(host, 5) % DAY


def with_dirty_flag(digests: DataFrame, matchstate: DataFrame, feed_gen: str | None, now: int, p: Params) -> DataFrame:
    """Previous match facts and whether the host needs a match; missing values are compared, not lost."""
    out = lookup(digests, matchstate, ["hostname"], {
        "digest": "prev_digest", "feed_gen": "prev_gen", "matcher_version": "prev_mv", "matched_at": "prev_matched_at"})
    return out.withColumn("was_dirty", (
        ~F.col("prev_digest").eqNullSafe(F.col("digest"))
        | (F.coalesce("prev_gen", F.lit("none")) != F.coalesce(F.lit(feed_gen), F.lit("none")))
        | (F.coalesce("prev_mv", F.lit("none")) != p.matcher_version)
        | F.col("prev_matched_at").isNull()
        | F.coalesce(F.col("prev_matched_at") < rematch_floor(F.col("hostname"), now), F.lit(False))))


def dirty_hosts(digests: DataFrame, matchstate: DataFrame, feed_gen: str | None, now: int, p: Params = Params()) -> DataFrame:
    return with_dirty_flag(digests, matchstate, feed_gen, now, p).filter("was_dirty").select(
        "hostname", "digest", "n_components", "digest_source")


def inventory_state(findings: DataFrame, components: DataFrame, old: DataFrame, hoststate: DataFrame,
                    now: int, p: Params = Params()) -> DataFrame:
    """Current version at every path that carries a finding.

    A reporting host's rows are rebuilt. A row it no longer reports is held
    (``cat_ran`` 0) when the source that found it did not run, and dropped
    when the source ran and the package is gone. A silent host keeps all.
    """
    def path(df: DataFrame) -> Column:
        return unescape_path(primary_path(df))

    comps = components.withColumns({"package": F.col("name"), "path": path(components),
                                    "source": F.coalesce(*[empty_to_null(optional(components, c)) for c in ("source_key", "source")]),
                                    "found_by": optional(components, "found_by")})
    ran_key = F.coalesce("source", "found_by")
    last = with_group(comps, ["hostname"], F.max("scanned_at").alias("_last"))
    ran = last.filter(F.col("scanned_at") >= F.col("_last") - 300).groupBy("hostname").agg(values(ran_key).alias("ran"))
    paths = findings.select("hostname", "package", path(findings).alias("path")).distinct()
    fresh = comps.groupBy("hostname", "package", "path").agg(
        latest("version", "scanned_at").alias("current_version"), latest("found_by", "scanned_at").alias("found_by"),
        latest("source", "scanned_at").alias("source"), F.max("scanned_at").alias("inv_time"))
    fresh = fresh.filter("current_version is not null").join(paths, ["hostname", "package", "path"], "left_semi")
    reported = fresh.select("hostname").distinct().withColumn("_new", F.lit(True))
    held = old.join(fresh, ["hostname", "package", "path"], "left_anti").join(reported, "hostname", "left")
    held = held.join(ran, "hostname", "left")
    key = F.coalesce("source", "found_by", F.lit(""))
    did_run = F.col("_new").isNull() | (key == "") | F.coalesce(F.array_contains("ran", key), F.lit(False))
    held = held.withColumn("cat_ran", F.when(did_run, 1).otherwise(0)).filter("_new is null or cat_ran = 0")
    out = fresh.withColumn("cat_ran", F.lit(1)).unionByName(held.select(
        "hostname", "package", "path", "current_version", "found_by", "source", "inv_time", "cat_ran"))
    return drop_retired(out, hoststate, now, p.host_retire_days)


def host_state(records: DataFrame, old: DataFrame) -> DataFrame:
    """Last scan and OS facts per host; the newer of new and old wins."""
    fields = {"os_id": "os", "os_version_id": "release", "architecture": "arch", "machine_id": "machine_id",
              "digest": "heartbeat_digest"}
    new = records.groupBy("hostname").agg(
        F.max("scanned_at").alias("host_last_scan"),
        *[latest(c, "scanned_at").alias(n) for c, n in fields.items() if c in records.columns])
    both = new.withColumn("_side", F.lit(0)).unionByName(old.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, ["hostname"], F.col("host_last_scan").desc(), F.col("_side")).drop("_side")


SCAN_COUNTS = ("component", "exposure", "link", "container")


def source_tallies(sources: Column) -> dict[str, Column]:
    """Counts per status, failure text and the sorted source list of a source map."""
    entries = F.map_entries(sources)

    def with_status(status: str) -> Column:
        return F.filter(entries, lambda e: e["value"]["status"] == status)

    failed = F.array_sort(F.transform(with_status("failed"), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"]["reason"], F.lit("no reason given")))))
    return {
        "sources_ok": F.size(with_status("ok")), "sources_skipped": F.size(with_status("skipped")),
        "sources_failed": F.size(failed), "failed_text": F.array_join(failed, "; "),
        "sources_text": F.array_join(F.array_sort(F.map_keys(sources)), ","),
        "n_sources": F.cardinality(sources),
    }


def scan_manifest(heartbeats: DataFrame, components: DataFrame, old: DataFrame, hoststate: DataFrame,
                  now: int, p: Params = Params()) -> DataFrame:
    """What each collector said it found beside what arrived, and whether a source disappeared."""
    newest = newest_rows(heartbeats, ["hostname"], "scanned_at")
    newest = newest.withColumns({f"said_{c}": F.col(f"counts.{c}") for c in SCAN_COUNTS})
    newest = newest.withColumn("said_component", F.coalesce("said_component", optional(newest, "n_components", "bigint")))
    newest = newest.withColumns(source_tallies(F.coalesce("sources", F.create_map().cast(
        "map<string,struct<status:string,reason:string>>"))))
    newest = newest.withColumns({
        "full_scan": blank(F.col("scan_profile.full_scan")), "elf_scope": blank(F.col("scan_profile.elf_scope")),
        "config_scope": blank(F.col("scan_profile.config_scope")),
        "has_profile": F.col("scan_profile").isNotNull().cast("int")})
    arrived = components.groupBy("hostname", "scanned_at").agg(F.count(F.lit(1)).alias("arrived_components"))
    arrived = newest_rows(arrived, ["hostname"], "scanned_at").drop("scanned_at")
    newest = lookup(newest, arrived, ["hostname"], ["arrived_components"])
    newest = lookup(newest, old, ["hostname"], {"sources_text": "prev_sources_text", "n_sources": "prev_n_sources"})
    newest = newest.withColumn("sources_shrank", F.coalesce(F.col("n_sources") < F.col("prev_n_sources"), F.lit(False)).cast("int"))
    drop = [c for c in ("counts", "sources", "scan_profile", "record_type") if c in newest.columns]
    return carry_forward(newest.drop(*drop), old, "scanned_at", ["hostname"], hoststate, now, p.host_retire_days)


def cadence_columns(gaps: Column, last_contact: Column, now: int, p: Params = Params()) -> dict[str, Column]:
    """Rhythm learned from the last ten gaps.

    The 95th percentile of ten gaps is their maximum; the median is the
    lower one.
    """
    ordered = F.array_sort(gaps)
    n = F.size(gaps)
    p95 = F.when(n > 0, F.get(ordered, n - 1))
    learned = n >= 3
    age = F.lit(now) - last_contact
    return {
        "n_gaps": n,
        "median_gap": F.when(n > 0, F.get(ordered, F.floor((n - 1) / 2).cast("int"))),
        "p95_gap": p95,
        "learned": learned.cast("int"),
        "late": (learned & (age > F.greatest(2 * p95, F.lit(p.late_floor)))).cast("int"),
        "contact_age": age,
    }


def host_cadence(hoststate: DataFrame, old: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """One step of the cadence state: the newest contact adds a gap, the list keeps ten."""
    rows = lookup(hoststate.select("hostname", "host_last_scan"), old, ["hostname"], {
        "last_contact_at": "prev_contact", "gaps": "prev_gaps", "first_seen_at": "prev_first"})
    none = F.array().cast("array<bigint>")
    gap = F.col("host_last_scan") - F.col("prev_contact")
    gaps = F.concat(F.coalesce("prev_gaps", none), F.when(gap > 0, F.array(gap)).otherwise(none))
    rows = rows.withColumn("gaps", F.slice(gaps, F.greatest(F.size(gaps) - 9, F.lit(1)), F.lit(10)))
    return rows.select(
        "hostname", F.col("host_last_scan").alias("last_contact_at"),
        F.coalesce("prev_first", "host_last_scan").alias("first_seen_at"), "gaps",
        *[c.alias(n) for n, c in cadence_columns(F.col("gaps"), F.col("host_last_scan"), now, p).items()])


def cadence_from_contacts(contacts: DataFrame, now: int, host: str = "hostname", ts: str = "scanned_at",
                          p: Params = Params()) -> DataFrame:
    """The same rhythm rebuilt from the whole contact history.

    Only the last eleven distinct contacts of a host can matter, and the
    ranked filter keeps just those before the shuffle.
    """
    w = Window.partitionBy(host).orderBy(F.col(ts).desc())
    last = contacts.select(host, ts).distinct().withColumn("_rn", F.row_number().over(w)).filter("_rn <= 11")
    gap = F.col(ts) - F.lead(ts).over(w)
    gapped = last.withColumn("gap", gap)
    newest = gapped.groupBy(host).agg(
        F.max(ts).alias("last_contact_at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct(
            (-F.col("_rn")).alias("o"), F.col("gap").alias("g"))))), lambda s: s["g"]).alias("gaps"))
    return newest.select(host, "last_contact_at", "gaps", *[
        c.alias(n) for n, c in cadence_columns(F.col("gaps"), F.col("last_contact_at"), now, p).items()])


def windows_patch_level(hotfixes: DataFrame, scanstate: DataFrame, winpatch: DataFrame, old: DataFrame,
                        hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """Installed Windows build beside the newest build the feed knows for its branch and edition."""
    rows = newest_rows(hotfixes, ["hostname"], "scanned_at")
    cumulative = F.when(F.col("servicing_stream") == "cumulative", F.col("version"))
    hosts = rows.groupBy("hostname").agg(
        F.min(cumulative).alias("cum"), values_text("kb").alias("installed_kbs"),
        F.count_distinct("kb").alias("n_installed_kbs"), F.min("os_version_id").alias("os_version"),
        F.max("scanned_at").alias("scanned_at"))
    hosts = lookup(hosts, scanstate, ["hostname"], ["os_build", "os_display_version", "os_installation_type"])
    reported = present("os_build")
    build = F.when(reported, F.regexp_replace("os_build", r"^10\.0\.", "")).otherwise(F.col("cum"))
    hosts = hosts.withColumns({"branch": extract(build, r"^(\d+)\.\d+$"), "ubr": try_long(extract(build, r"^\d+\.(\d+)$")),
                               "release": empty_to_null("os_display_version")}).filter("branch is not null")
    kind = F.col("os_installation_type")
    hosts = hosts.withColumn("edition", F.when(kind == "Client", "client").when(
        kind.isin("Server", "Server Core"), "server").when(F.col("os_version").rlike(r"^\d{4}$"), "server").otherwise("client"))
    top = newest_rows(winpatch, ["branch", "edition"], "ubr").groupBy("branch", "edition").agg(
        values_text("kb").alias("latest_kb"), F.min("fixed_build").alias("latest_build"),
        F.min("released").alias("latest_released"), F.min("product").alias("feed_product"), F.max("ubr").alias("latest_ubr"))
    out = hosts.join(top, ["branch", "edition"], "left")
    named = F.concat(F.lit("Windows "), F.col("os_version"), F.lit(" Version "), F.col("release"))
    behind = F.col("latest_ubr") - F.col("ubr")
    out = out.select(
        "hostname",
        F.when(F.col("release").isNull(), F.col("feed_product")).when(
            F.contains("feed_product", "release"), F.col("feed_product")).otherwise(named).alias("product"),
        "release", "edition", "branch", "ubr",
        F.concat(F.lit("10.0."), "branch", F.lit("."), F.col("ubr").cast("string")).alias("current_build"),
        F.when(reported, "the collector reports it").otherwise(
            "derived from the cumulative update, which names the servicing branch").alias("build_source"),
        "latest_ubr", "latest_build", "latest_kb", "latest_released", behind.alias("behind_ubr"),
        F.when(F.col("latest_ubr").isNull(), "no update data for this build in the feed").when(
            behind <= 0, "current with the feed").otherwise("behind the feed").alias("status"),
        "installed_kbs", "n_installed_kbs", "scanned_at", F.lit(now).cast("bigint").alias("rolled_at"))
    return carry_forward(out, old, "rolled_at", ["hostname"], hoststate, now, p.host_retire_days)


CONFIG_KEY = ("hostname", "kind", "name", "path_key")


def config_surface(config: DataFrame, old: DataFrame, hoststate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """Newest configuration entries per host; any new entry replaces the host's old ones."""
    rows = newest_rows(config, ["hostname"], "scanned_at").withColumns({
        "path_key": F.coalesce("path", "executable", F.lit("")), "name": blank("name")})
    return replace_reported(rows, old, list(CONFIG_KEY), hoststate, now, p.host_retire_days)


def ecosystem_counts(latest_rows: DataFrame, old: DataFrame, hoststate: DataFrame, now: int,
                     p: Params = Params()) -> DataFrame:
    """Components by type per host with fleet rows recomputed after the carry-forward."""
    cpe = present("cpe_list") if "cpe_list" in latest_rows.columns else F.lit(False)
    ident = present("purl") | cpe
    new = latest_rows.groupBy("hostname", "type").agg(
        F.count_distinct("name").alias("components"), F.count(F.lit(1)).alias("instances"),
        F.count_if(ident).alias("with_identifier"), F.count_if(cpe).alias("cpe_ident"))
    new = new.withColumn("assessed_at", F.lit(now).cast("bigint"))
    kept = carry_forward(new, old, "assessed_at", ["hostname", "type"], hoststate, now, p.host_retire_days)
    counts = ("components", "instances", "with_identifier", "cpe_ident")
    fleet = kept.groupBy("type").agg(*[F.sum(c).alias(c) for c in counts]).withColumns(
        {"hostname": F.lit("__fleet__"), "assessed_at": F.lit(now).cast("bigint")})
    return kept.unionByName(fleet)


def vendors(latest_rows: DataFrame) -> DataFrame:
    return latest_rows.filter(present("vendor")).groupBy(F.col("name").alias("package")).agg(F.min("vendor").alias("vendor"))


def hosts_reporting(hoststate: DataFrame, now: int, days: int = 7) -> DataFrame:
    return hoststate.filter(F.col("host_last_scan") >= now - days * DAY).agg(F.count_distinct("hostname").alias("hosts"))


def feed_age(feedstate: DataFrame, now: int, stale_after: int | None = None) -> DataFrame:
    out = feedstate.filter("imported_at is not null").withColumn("age_days", age_days(F.col("imported_at"), now))
    return out if stale_after is None else out.filter(F.col("age_days") > stale_after)


def coverage(fleet_counts: DataFrame, feed_summary: DataFrame) -> DataFrame:
    """Whether each component type in the fleet can be matched, and why not."""
    fleet = fleet_counts.groupBy("type").agg(F.sum("instances").alias("components"), F.sum("cpe_ident").alias("cpe_ident"))
    feed = feed_summary.groupBy(F.col("ecosystem").alias("type")).agg(
        F.max("feed_packages").alias("feed_packages"), F.max("feed_ranges").alias("feed_ranges"))
    cpe_ranges = feed.agg(F.max(F.when(F.col("type") == "cpe", F.col("feed_ranges")))).scalar()
    rows = fleet.join(feed, "type", "left").withColumns({
        "feed_packages": F.coalesce("feed_packages", F.lit(0)), "feed_ranges": F.coalesce("feed_ranges", F.lit(0)),
        "cpe_ranges": cpe_ranges})
    through_cpe = (F.col("cpe_ident") > 0) & (F.col("cpe_ranges") > 0)
    return rows.select(
        "type", "components",
        F.when(F.col("feed_packages") < 0, "counted approximately").otherwise(commas(F.col("feed_packages"))).alias("feed_packages"),
        F.when(F.col("feed_ranges") > 0, commas(F.col("feed_ranges"))).when(
            through_cpe, F.concat(commas(F.col("cpe_ranges")), F.lit(" CPE ranges"))).otherwise("0").alias("reach"),
        F.when(F.col("feed_ranges") > 0, "covered").when(through_cpe, "covered through CPE").when(
            F.col("type").isin(*NO_FEED_TYPES), "no feed exists for this type").otherwise(
            "add this ecosystem to the bundle").alias("status"))


# Collector versions that lack a record family, newest floor last.
COLLECTOR_FLOORS = ((701, " (below the 0.7.1 floor)"), (800, " (no configuration surface)"),
                    (900, " (no Windows library loads or Windows autoruns)"), (902, " (no Windows build number)"))


def collector_label(version: Column) -> Column:
    number = (try_long(extract(version, r"(\d+)\.\d+\.\d+")) * 10000
              + try_long(extract(version, r"\d+\.(\d+)\.\d+")) * 100
              + try_long(extract(version, r"\d+\.\d+\.(\d+)")))
    expr = F.when(version.isNull(), "not reported").when(number.isNull(), version)
    for floor, note in COLLECTOR_FLOORS:
        expr = expr.when(number < floor, F.concat(version, F.lit(note)))
    return expr.otherwise(version)


def arrival_check(scanstate: DataFrame, links: DataFrame) -> DataFrame:
    """Per host, whether everything the collector found reached the tables."""
    scan = scanstate.groupBy("hostname").agg(
        F.max("said_component").alias("said_components"), F.max("said_link").alias("said_link"),
        F.max("arrived_components").alias("arrived"), F.max("sources_failed").alias("sources_failed"),
        values_text("failed_text", "; ").alias("failed_text"), F.max("collector_version").alias("collector_version"),
        F.max("scanned_at").alias("scanned_at"))
    link_rows = links.groupBy("hostname").agg(F.sum("link_rows").alias("links_arrived"))
    rows = scan.join(link_rows, "hostname", "full")
    short = F.col("said_components") - F.col("arrived")
    return rows.select(
        "hostname",
        F.when(F.col("said_components").isNull(), "collector does not report a manifest").when(
            F.col("arrived").isNull(), "last scan is older than the check window").when(
            F.col("sources_failed") > 0, "a source failed on the host").when(
            short > 0, "components went missing on the way in").otherwise("everything arrived").alias("verdict"),
        collector_label(F.col("collector_version")).alias("collector"), "said_components", "arrived",
        percent(F.col("arrived"), F.col("said_components")).alias("arrived_pct"), "said_link",
        F.coalesce("links_arrived", F.lit(0)).alias("links_arrived"), "failed_text",
        stamp_text(F.col("scanned_at")).alias("reported"))


def silent_for(hoststate: DataFrame, now: int) -> DataFrame:
    return hoststate.withColumn("quiet_for", F.coalesce(
        duration_text(F.lit(now) - F.col("host_last_scan")), F.lit("never reported")))


