"""Finding lifecycle: recompute, fold, acknowledge, close, checkpoint, archive.

Closing needs evidence. A finding is only closed when a receipt proves the
host was matched, the fold proves every finding arrived, the snapshots are
fresh and the source that found the package actually ran.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import age_days, blank, duration_text, present, stamp_text, unescape_path
from vulnspark.operators.generic import (
    count_when, earliest, latest, lookup, newest_rows, upsert,
)
from vulnspark.operators.identity import primary_path, with_role
from vulnspark.operators.inventory import with_dirty_flag
from vulnspark.params import DAY, Params

LATEST_FIELDS = ("cve_id", "hostname", "package", "ecosystem", "path", "scope", "scope_id", "fixed_version",
                 "confidence", "match_authority", "severity", "epss", "kev_added", "kev_due", "url", "title")
CARRIED = ("accepted", "exception_key", "exception_expires_at")


def finding_events(events: DataFrame) -> DataFrame:
    return events.filter("record_type <> 'match_receipt'") if "record_type" in events.columns else events


def summarise_events(events: DataFrame, seen: Column) -> DataFrame:
    """One row per finding over a set of events."""
    fields = [c for c in LATEST_FIELDS if c in events.columns]
    return finding_events(events).groupBy("finding_key").agg(
        F.min("scan_time").alias("first_seen"), F.max("scan_time").alias("last_seen"),
        F.min("match_run").alias("first_found"), F.max("match_run").alias("last_match_run"),
        earliest("installed_version", "scan_time").alias("first_version"),
        latest("installed_version", "scan_time").alias("last_version"),
        *[latest(c, "scan_time").alias(c) for c in fields], seen.alias("times_seen"))


def with_current_version(df: DataFrame, invstate: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    out = df.withColumn("_ipath", unescape_path("path"))
    return lookup(out, invstate, {"hostname": "hostname", "package": "package", "_ipath": "path"},
                  ["current_version", *extra]).drop("_ipath")


def version_change(status: Column) -> Column:
    return F.when(status == "mitigated", F.concat("last_version", F.lit(" -> "), "current_version"))


def lifecycle_full(events: DataFrame, hoststate: DataFrame, matchstate: DataFrame, invstate: DataFrame,
                   now: int, p: Params = Params()) -> DataFrame:
    """The finding table rebuilt from every event."""
    rows = summarise_events(events, F.count(F.lit(1)))
    rows = lookup(rows, hoststate, ["hostname"], ["host_last_scan"])
    rows = lookup(rows, matchstate, ["hostname"], {"matched_at": "host_last_matched"})
    rows = with_current_version(rows, invstate)
    current = F.col("host_last_matched").isNull() | (
        F.coalesce("last_match_run", "last_seen") >= F.col("host_last_matched") - p.run_tolerance)
    rows = rows.withColumn("is_current", current.cast("int"))
    rows = rows.withColumn("status", F.when(F.col("is_current") == 1, "open").when(
        F.col("host_last_scan").isNull(), "unknown").when(
        F.col("current_version") != F.col("last_version"), "mitigated").when(
        F.col("current_version").isNotNull(), "open").otherwise("removed"))
    return rows.withColumns({"mitigation": version_change(F.col("status")), "age_days": age_days(F.col("first_seen"), now)})


def fold(state: DataFrame, events: DataFrame, now: int, recount: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fold new events into the finding table: (touched rows, fold receipts per host).

    First sightings and acceptance are carried from the old row. A sighting
    counts only if its run is newer than the last one in the old row, so
    windows may overlap and a run may be folded again. With ``recount``
    false (a catch-up over events of any age) an existing count is kept.
    """
    if recount and "last_match_run" in state.columns:
        events = lookup(events, state, ["finding_key"], {"last_match_run": "_folded_run"})
        seen = count_when(F.col("_folded_run").isNull() | (F.col("match_run") > F.col("_folded_run")))
    else:
        seen = F.count(F.lit(1)) if recount else F.count_distinct("match_run")
    window = summarise_events(events, seen)
    carried = [c for c in CARRIED if c in state.columns]
    rows = lookup(window, state, ["finding_key"], {
        c: f"prev_{c}" for c in ("first_seen", "first_found", "first_version", "times_seen", *carried)})
    prev = F.col("prev_times_seen")
    rows = rows.withColumns({
        "first_found": F.coalesce("prev_first_found", "prev_first_seen", "first_found"),
        "first_seen": F.coalesce("prev_first_seen", "first_seen"),
        "first_version": F.coalesce("prev_first_version", "first_version"),
        "times_seen": F.coalesce(prev, F.lit(0)) + F.col("times_seen") if recount else F.coalesce(prev, F.col("times_seen")),
        "status": F.lit("open"),
        "accepted": F.coalesce("prev_accepted", F.lit("0")) if "accepted" in carried else F.lit("0"),
        **{c: F.col(f"prev_{c}") for c in carried if c != "accepted"}})
    rows = rows.withColumn("age_days", age_days(F.col("first_seen"), now))
    rows = rows.drop(*[c for c in rows.columns if c.startswith("prev_")])
    receipts = rows.groupBy("hostname").agg(F.count(F.lit(1)).alias("rows_at_run"), F.max("last_match_run").alias("state_run"))
    return rows, receipts.withColumn("folded_pass_at", F.lit(now).cast("bigint"))


def fold_catch_up(state: DataFrame, events: DataFrame, matchstate: DataFrame, now: int,
                  p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Fold again for every host whose last match was never folded."""
    behind = matchstate.filter(F.col("folded_run").isNull() | (F.col("folded_run") < F.col("matched_at") - p.run_tolerance))
    return fold(state, events.join(behind.select("hostname"), "hostname", "left_semi"), now, recount=False)


def fresh_snapshots(snapshot_meta: DataFrame, names: tuple[str, ...], now: int, p: Params) -> Column:
    """True when every named snapshot was built inside the allowed age; read as a scalar."""
    built = snapshot_meta.filter(F.col("name").isin(*names) & (F.col("built_at") > now - p.snapshot_max_age))
    return built.agg(F.count_distinct("name") == len(names)).scalar()


def acknowledge(receipts: DataFrame, foldstate: DataFrame, snapshot_meta: DataFrame, matchstate: DataFrame,
                now: int, p: Params = Params()) -> DataFrame:
    """Match state rows for hosts whose newest match is proven folded."""
    runs = newest_rows(receipts, ["hostname"], "match_run").groupBy("hostname").agg(
        F.sum("findings_produced").alias("findings_produced"), F.max("match_run").alias("match_run"))
    runs = lookup(runs, foldstate, ["hostname"], ["rows_at_run", "state_run"])
    folded = (F.abs(F.col("state_run") - F.col("match_run")) < p.run_tolerance) & (
        F.col("rows_at_run") >= F.col("findings_produced"))
    runs = runs.filter((F.col("findings_produced") == 0) | F.coalesce(folded, F.lit(False)))
    runs = runs.filter(fresh_snapshots(snapshot_meta, ("invstate", "hoststate"), now, p))
    runs = lookup(runs, matchstate, ["hostname"], ["digest", "feed_gen", "matcher_version", "matched_at", "n_components"])
    return runs.select("hostname", "digest", "feed_gen", "matcher_version", "matched_at", "n_components",
                       F.col("match_run").alias("folded_run"), F.lit(now).cast("bigint").alias("folded_at"),
                       F.col("findings_produced").alias("folded_findings"))


def close_unreported(state: DataFrame, matchstate: DataFrame, hoststate: DataFrame, invstate: DataFrame,
                     scanstate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    """Rows of open findings the matcher stopped reporting, closed with a reason."""
    rows = lookup(state.filter("status = 'open'"), matchstate, ["hostname"], {"folded_run": "host_folded_run"})
    rows = rows.filter(F.col("last_match_run") < F.col("host_folded_run") - p.run_tolerance)
    rows = lookup(rows, hoststate, ["hostname"], ["host_last_scan"])
    rows = with_current_version(rows, invstate, ("cat_ran",))
    rows = rows.filter(F.coalesce(F.col("cat_ran") != 0, F.lit(True)))
    rows = lookup(rows, scanstate, ["hostname"], ["sources_shrank", "has_profile"])
    rows = rows.filter(F.coalesce(F.col("has_profile") == 1, F.lit(False)) | F.coalesce(
        F.col("sources_shrank") != 1, F.lit(True)))
    gone = F.col("current_version").isNull()
    status = F.when(F.col("host_last_scan").isNull(), "unknown").when(
        F.col("current_version") != F.col("last_version"), "mitigated").otherwise("removed")
    return rows.withColumn("status", status).withColumns({
        "closure_reason": F.when(F.col("status") == "unknown", "host_silent").when(
            F.col("status") == "mitigated", "upgraded").when(gone, "uninstalled").otherwise("feed_retracted"),
        "mitigation": version_change(F.col("status")),
        "closed_at": F.lit(now).cast("bigint")})


def checkpoint(digests: DataFrame, matchstate: DataFrame, receipts: DataFrame, feed_gen: str | None, now: int,
               p: Params = Params()) -> DataFrame:
    """The match state after a run; a dirty host advances only when a receipt proves it was matched."""
    rows = with_dirty_flag(digests, matchstate, feed_gen, now, p)
    rows = lookup(rows, matchstate, ["hostname"], {
        "folded_run": "folded_run", "folded_at": "folded_at", "folded_findings": "folded_findings",
        "digest_changed_at": "prev_changed"})
    run = receipts.groupBy("hostname").agg(F.max("match_run").alias("receipt_run"),
                                           latest("match_feed_gen", "match_run").alias("receipt_gen"))
    rows = lookup(rows, run, ["hostname"], ["receipt_run", "receipt_gen"])
    matched = F.col("receipt_run").isNotNull() & (
        F.col("prev_matched_at").isNull() | (F.col("receipt_run") > F.col("prev_matched_at")))
    rows = rows.withColumns({"advanced": F.col("was_dirty") & matched, "held": F.col("was_dirty") & ~matched})
    changed = F.coalesce("prev_changed", F.lit(now).cast("bigint"))
    return rows.select(
        "hostname",
        F.when(F.col("held"), F.col("prev_digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("held"), F.col("prev_gen")).when(
            F.col("advanced") & F.col("receipt_gen").isNotNull(), F.nullif("receipt_gen", F.lit("none"))).otherwise(
            F.lit(feed_gen)).alias("feed_gen"),
        F.when(F.col("held"), F.col("prev_mv")).otherwise(F.lit(p.matcher_version)).alias("matcher_version"),
        F.when(F.col("advanced"), F.col("receipt_run")).otherwise(F.col("prev_matched_at")).alias("matched_at"),
        "n_components", "folded_run", "folded_at", "folded_findings",
        F.when(F.col("prev_digest") != F.col("digest"), F.lit(now).cast("bigint")).otherwise(changed).alias("digest_changed_at"))


def silent_days(now: int) -> Column:
    return age_days(F.col("host_last_scan"), now)


def mark_silent(state: DataFrame, hoststate: DataFrame, cadence: DataFrame, now: int) -> DataFrame:
    """Open findings of hosts that are late by their own learned rhythm become unknown."""
    rows = lookup(state.filter("status = 'open'"), hoststate, ["hostname"], ["host_last_scan"])
    rows = lookup(rows, cadence, ["hostname"], ["learned", "late"]).filter("learned = 1 and late = 1")
    return rows.withColumns({"silent_days": silent_days(now), "status": F.lit("unknown"),
                             "closure_reason": F.lit("host_silent"), "closed_at": F.lit(now).cast("bigint")})


def close_role_artifacts(state: DataFrame, components: DataFrame, now: int) -> DataFrame:
    """Open findings on files now known to be installers or launchers are removed."""
    rows = components.filter("type = 'binary'")
    rows = with_role(rows.withColumn("path", primary_path(rows)))
    roles = rows.groupBy("hostname", F.col("name").alias("package"), "path").agg(latest("role", "scanned_at").alias("role"))
    found = lookup(state.filter("status = 'open'").withColumn("_ipath", unescape_path("path")), roles.filter("role <> ''"),
                   {"hostname": "hostname", "package": "package", "_ipath": "path"}, ["role"], how="inner").drop("_ipath")
    return found.withColumns({
        "status": F.lit("removed"), "closure_reason": F.concat("role", F.lit("_artifact")),
        "closed_at": F.lit(now).cast("bigint")}).drop("role")


def archive_expired(state: DataFrame, hoststate: DataFrame, cadence: DataFrame, snapshot_meta: DataFrame, now: int,
                    p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, state without them).

    A host is retired only when its rhythm is learned, it is late, and it has
    been silent past the retirement age or four times its longest gap.
    """
    live = state.filter("archived is null")
    rows = lookup(live, hoststate, ["hostname"], ["host_last_scan"])
    rows = lookup(rows, cadence, ["hostname"], ["learned", "late", "p95_gap"])
    age = F.lit(now) - F.col("host_last_scan")
    retired = (F.col("learned") == 1) & (F.col("late") == 1) & (
        age > F.greatest(F.lit(p.host_retire_days * DAY), 4 * F.col("p95_gap")))
    aged = (F.col("status") != "open") & (age_days(F.col("closed_at"), now) > p.retain_closed_days)
    rows = rows.withColumns({
        "silent_days": silent_days(now), "closed_days": age_days(F.col("closed_at"), now),
        "expire_reason": F.when(retired, "host_retired").when(aged, "closed_aged_out")})
    rows = rows.filter("expire_reason is not null").filter(fresh_snapshots(snapshot_meta, ("hoststate",), now, p))
    rows = rows.withColumn("archived_at", F.lit(now).cast("bigint")).drop("archived", "learned", "late", "p95_gap")
    return rows, state.join(rows.select("finding_key"), "finding_key", "left_anti")


def mark_archived(state: DataFrame, archive: DataFrame, since: int) -> DataFrame:
    """State rows whose archive copy exists, stamped for deletion."""
    stamps = archive.filter(F.col("archived_at") >= since).groupBy("finding_key").agg(F.max("archived_at").alias("archived"))
    return state.drop("archived").join(stamps, "finding_key", "inner")


PROBLEM_UNFOLDED = "matched, but the findings of that match are not in the finding table; nothing is closed until they are"


def unfolded_receipts(receipts: DataFrame, matchstate: DataFrame, p: Params = Params()) -> DataFrame:
    runs = receipts.groupBy("hostname").agg(F.max("match_run").alias("match_run"),
                                            F.sum("findings_produced").alias("findings_produced"))
    runs = lookup(runs.filter("findings_produced > 0"), matchstate, ["hostname"], ["folded_run"])
    done = F.coalesce(F.abs(F.col("folded_run") - F.col("match_run")) < p.run_tolerance, F.lit(False))
    return runs.filter(~done)


def stalled(receipts: DataFrame, matchstate: DataFrame, feedstate: DataFrame, p: Params = Params()) -> DataFrame:
    """Hosts whose findings never arrived, and hosts credited with a feed they never saw."""
    never = unfolded_receipts(receipts, matchstate, p).withColumn("problem", F.lit(PROBLEM_UNFOLDED))
    live = feedstate.select(F.col("generation").alias("feed_gen"), F.col("imported_at").alias("_imported")).filter(
        "_imported is not null")
    wrong = matchstate.join(live, "feed_gen").filter(F.col("matched_at") < F.col("_imported") - p.run_tolerance)
    text = F.concat(
        F.lit("credited with feed generation "), "feed_gen",
        F.lit(", which was loaded after its last match; it waits for a change of its software or the daily rematch"))
    wrong = wrong.select("hostname", F.col("matched_at").alias("match_run"),
                         F.lit(0).cast("bigint").alias("findings_produced"), "folded_run", text.alias("problem"))
    return never.select("hostname", "match_run", "findings_produced", "folded_run", "problem").unionByName(wrong)


def kev_alert_rows(state: DataFrame) -> DataFrame:
    """Where each known-exploited CVE is open with high confidence: distinct host and package pairs."""
    rows = state.filter("status = 'open' and accepted <> '1' and confidence = 'high'").filter(present("kev_added"))
    return rows.select("cve_id", "kev_added", "kev_due", "hostname", "package").distinct()


def kev_alert(state: DataFrame) -> DataFrame:
    """One row per known-exploited CVE; the hosts stay in :func:`kev_alert_rows`, as a CVE may be on all of them."""
    return kev_alert_rows(state).groupBy("cve_id", "kev_added", "kev_due").agg(
        F.count_distinct("hostname").alias("hosts"), F.count_distinct("package").alias("packages"))


# --- views ------------------------------------------------------------------

def open_findings(state: DataFrame) -> DataFrame:
    return state.filter("status = 'open' and accepted <> '1'")


def open_findings_all(state: DataFrame) -> DataFrame:
    return state.filter("status = 'open'")


def accepted_findings(state: DataFrame) -> DataFrame:
    return state.filter("status = 'open' and accepted = '1'")


def live_findings(state: DataFrame) -> DataFrame:
    return state.filter("archived is null")


def mitigated_findings(state: DataFrame) -> DataFrame:
    return live_findings(state).filter("status = 'mitigated'")


def findings_for(state: DataFrame, host: str = "*", package: str = "*", cve: str = "*", confidence: str = "*",
                 accepted: bool = False) -> DataFrame:
    """Open findings by host, package, CVE and confidence; each may be a glob."""
    from vulnspark.functions.text import glob_match

    rows = open_findings_all(state) if accepted else open_findings(state)
    for column, pattern in (("hostname", host), ("package", package), ("cve_id", cve), ("confidence", confidence)):
        rows = rows.filter(glob_match(column, pattern))
    return rows


def root_label() -> Column:
    return F.when(blank("scope_id") != "", F.col("scope_id")).otherwise("host")


def remediation_mitigated(state: DataFrame) -> DataFrame:
    """Fixed findings with the version change and how long they were open."""
    return mitigated_findings(state).select(
        "cve_id", "package", "ecosystem", "mitigation", root_label().alias("root"), "hostname",
        unescape_path("path").alias("path"),
        F.round((F.col("last_seen") - F.col("first_seen")) / 86400.0, 1).alias("fixed_after_days"), "epss")


def remediation_gone(state: DataFrame) -> DataFrame:
    return live_findings(state).filter("status in ('removed', 'unknown')").select(
        "cve_id", "package", "last_version", "status", root_label().alias("root"), "hostname",
        unescape_path("path").alias("path"), stamp_text(F.col("last_seen")).alias("last_seen"))


def remediation_daily(state: DataFrame, now: int, days: int = 90) -> DataFrame:
    rows = live_findings(state).filter(F.col("first_seen") >= now - days * DAY)
    return rows.groupBy(stamp_text(F.col("first_seen"), "yyyy-MM-dd").alias("day"), "status").agg(
        F.count_distinct("finding_key").alias("findings"))


def remediation_tiles(state: DataFrame) -> DataFrame:
    """Distinct findings open, mitigated, removed and unknown."""
    live = F.col("archived").isNull()
    return state.agg(
        F.count_distinct(F.when((F.col("status") == "open") & (F.col("accepted") != "1"), F.col("finding_key"))).alias("open"),
        *[F.count_distinct(F.when(live & (F.col("status") == s), F.col("finding_key"))).alias(s)
          for s in ("mitigated", "removed", "unknown")])


def apply_rows(state: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("finding_key",)) -> DataFrame:
    """Write closed, folded or flagged rows back; columns the state lacks are left behind."""
    return upsert(state, rows.select(*[c for c in rows.columns if c in state.columns]), list(keys))


def stale_hosts(receipts: DataFrame, matchstate: DataFrame, now: int, p: Params = Params()) -> DataFrame:
    rows = unfolded_receipts(receipts, matchstate, p)
    return rows.select("hostname", stamp_text(F.col("match_run"), "yyyy-MM-dd HH:mm:ss").alias("matched"), "findings_produced",
                       F.coalesce(stamp_text(F.col("folded_run"), "yyyy-MM-dd HH:mm:ss"), F.lit("never")).alias("folded"),
                       duration_text(F.lit(now) - F.col("match_run")).alias("waiting"))
