"""Accepted risks: state, precedence, validation and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import blank, empty_to_null, present, stamp_text, try_double, try_long
from vulnspark.operators.generic import first_per_key, lookup, upsert
from vulnspark.params import DAY, Params

# Accepted choices and limits of a request.
SCOPE_KINDS = ("host_cve", "finding", "fleet_cve")
REASON_KINDS = ("compensating_control", "risk_accepted", "false_positive")
MAX_CONTROL = 2000
MAX_NOTES = 4000


def state_of(now: int) -> Column:
    expired = present("expires_at") & (try_double("expires_at") <= now)
    return F.when(present("revoked_at"), "revoked").when(expired, "expired").otherwise("active")


def exception_state(exceptions: DataFrame, now: int) -> DataFrame:
    """State and display labels of every decision."""
    return exceptions.withColumns({
        "exc_state": state_of(now),
        "expires_label": F.when(~present("expires_at"), "permanent").otherwise(
            stamp_text(try_long("expires_at"))),
        "created_label": stamp_text(try_long("created_at")),
        "scope_label": F.when(F.col("scope_kind") == "fleet_cve", "every host").when(
            F.col("scope_kind") == "finding", F.concat("hostname", F.lit(" (one exact finding)"))).otherwise(F.col("hostname")),
    })


def match_key(kind: Column) -> Column:
    return (F.when(kind == "finding", F.concat(F.lit("find|"), "finding_key"))
            .when(kind == "host_cve", F.concat_ws("|", F.lit("host"), "hostname", "cve_id"))
            .otherwise(F.concat(F.lit("fleet|"), "cve_id")))


def in_force(exceptions: DataFrame, now: int) -> DataFrame:
    """Active decisions, one per match key: the newest, then the smallest key."""
    active = exceptions.filter(state_of(now) == "active")
    return first_per_key(active, ["match_key"], F.col("created_at").desc(), F.col("exception_key"))


def with_acceptance(state: DataFrame, exceptions: DataFrame, now: int) -> DataFrame:
    """Open findings with the decision that covers them: exact finding, then host and CVE, then fleet."""
    rows = state.filter("status = 'open'").withColumns({
        "_k0": F.concat(F.lit("find|"), "finding_key"),
        "_k1": F.concat_ws("|", F.lit("host"), "hostname", "cve_id"),
        "_k2": F.concat(F.lit("fleet|"), "cve_id")})
    active = in_force(exceptions, now)
    for i in range(3):
        rows = lookup(rows, active, {f"_k{i}": "match_key"}, {"exception_key": f"_e{i}", "expires_at": f"_x{i}"})
    first = [F.col(f"_e{i}").isNotNull() for i in range(3)]
    expiry = F
    for i in range(3):
        expiry = expiry.when(first[i], F.col(f"_x{i}"))
    return rows.withColumns({
        "new_accepted": F.when(first[0] | first[1] | first[2], "1").otherwise("0"),
        "new_exception": F.coalesce("_e0", "_e1", "_e2", F.lit("")),
        "new_expires": F.coalesce(expiry.otherwise(None), F.lit("")),
    }).drop(*[f"_{a}{i}" for a in "kex" for i in range(3)])


def reconcile_acceptance(state: DataFrame, exceptions: DataFrame, now: int) -> DataFrame:
    """Only the open findings whose acceptance changes."""
    rows = with_acceptance(state, exceptions, now)
    changed = (F.col("new_accepted") != F.coalesce("accepted", F.lit("0"))) | (
        blank("exception_key") != F.col("new_exception"))
    return rows.filter(changed).withColumns({
        "accepted": F.col("new_accepted"), "exception_key": F.col("new_exception"),
        "exception_expires_at": F.col("new_expires")}).drop("new_accepted", "new_exception", "new_expires")


def reconcile_live_keys(exceptions: DataFrame, now: int) -> DataFrame:
    """Register rows whose live key disagrees with their state, corrected."""
    want = F.when(state_of(now) == "active", F.col("match_key")).otherwise("")
    rows = exceptions.withColumn("_want", want).filter(blank("active_match_key") != F.col("_want"))
    return rows.withColumn("active_match_key", F.col("_want")).drop("_want")


def expiry_events(exceptions: DataFrame, now: int, window: int = 90 * 60) -> DataFrame:
    """Audit rows for decisions that lapsed inside the window."""
    at = try_double("expires_at")
    rows = exceptions.filter(~present("revoked_at") & present("expires_at") & (at <= now) & (at > now - window))
    return rows.withColumns({"action": F.lit("expire"), "who": F.lit("scheduler"), "at": F.lit(now).cast("bigint")})


def request_problem() -> Column:
    """Why a request cannot become a decision, or null."""
    kind, cve = F.col("scope_kind"), F.upper(F.trim(blank("cve_id")))
    expires = blank("expires_at")
    bad_expiry = ~expires.isin("", "never") & try_double(expires).isNull()
    return (
        F.when(~present("scope_kind"), "scope_kind is required")
        .when(~kind.isin(*SCOPE_KINDS), "scope_kind is not known")
        .when(cve == "", "cve_id is required")
        .when(~cve.startswith("CVE-"), "cve_id must be a CVE identifier")
        .when(kind.isin("host_cve", "finding") & (F.trim(blank("hostname")) == ""), "hostname is required")
        .when((kind == "finding") & (F.trim(blank("finding_key")) == ""), "finding_key is required")
        .when(present("reason_kind") & ~F.col("reason_kind").isin(*REASON_KINDS), "reason_kind is not known")
        .when(F.trim(blank("control")) == "", "control is required")
        .when(F.length(F.trim(F.col("control"))) > MAX_CONTROL, "control is too long")
        .when(F.length(F.trim(blank("notes"))) > MAX_NOTES, "notes are too long")
        .when(bad_expiry, "expires_at must be an epoch time, or never"))


def apply_exceptions(exceptions: DataFrame, requests: DataFrame, now: int,
                     p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(register, audit rows, rejected requests).

    A valid request becomes an active decision, and older rows of the same
    scope that are no longer in force give up their live key at once. A null
    expiry takes the default; empty or ``never`` is permanent.
    """
    checked = requests.withColumn("problem", request_problem())
    fleet = F.col("scope_kind") == "fleet_cve"
    default = F.lit(str(now + p.exception_expiry_days * DAY))
    expires = blank("expires_at")
    good = checked.filter("problem is null").withColumns({
        "cve_id": F.upper(F.trim("cve_id")),
        "hostname": F.when(fleet, "").otherwise(F.trim(blank("hostname"))),
        "finding_key": F.when(fleet, "").otherwise(F.trim(blank("finding_key"))),
        "reason_kind": F.coalesce(empty_to_null("reason_kind"), F.lit("compensating_control")),
        "control": F.trim("control"), "notes": F.trim(blank("notes")),
        "expires_at": F.when(F.col("expires_at").isNull(), default).when(expires.isin("", "never"), "").otherwise(
            try_double(expires).cast("bigint").cast("string")),
        "created_at": F.lit(now).cast("bigint"), "revoked_at": F.lit("")})
    good = good.withColumn("match_key", match_key(F.col("scope_kind"))).withColumn("active_match_key", F.col("match_key"))
    good = good.drop("problem")
    scopes = good.select("match_key").distinct().withColumn("_again", F.lit(True))
    stale = F.col("_again").isNotNull() & (state_of(now) != "active")
    old = exceptions.join(scopes, "match_key", "left").withColumn(
        "active_match_key", F.when(stale, "").otherwise(F.col("active_match_key"))).drop("_again")
    register = upsert(old, good, ["exception_key"])
    audit = good.select("exception_key", "cve_id", "hostname", "scope_kind", "control", F.lit("create").alias("action"),
                        F.lit(now).cast("bigint").alias("at"))
    return register, audit, checked.filter("problem is not null")


def preview_scope(state: DataFrame, requests: DataFrame) -> DataFrame:
    """How many open findings each scope of a request would cover."""
    open_rows = state.filter("status = 'open'")
    by_host = open_rows.groupBy("cve_id", "hostname").agg(F.count(F.lit(1)).alias("host_cve"))
    by_fleet = open_rows.groupBy("cve_id").agg(F.count(F.lit(1)).alias("fleet_cve"),
                                               F.count_distinct("hostname").alias("fleet_hosts"))
    rows = requests.withColumn("cve_id", F.upper("cve_id"))
    rows = rows.join(by_host, ["cve_id", "hostname"], "left").join(by_fleet, "cve_id", "left")
    return rows.fillna(0, ["host_cve", "fleet_cve", "fleet_hosts"])


def suppress(findings: DataFrame, suppressions: DataFrame, now: int) -> DataFrame:
    """Findings no live suppression covers; an empty suppression field matches anything.

    Each wildcard pattern is one equi anti join on the fields it names, so a
    large suppression list never becomes a pairwise comparison.
    """
    fields = ("advisory_id", "package", "hostname")
    expires = try_double("expires_at")
    live = suppressions.filter(expires.isNull() | (expires == 0) | (expires >= now))
    shape = F.concat(*[F.when(present(c), "1").otherwise("0") for c in fields])
    out = findings
    for mask in range(8):
        bits = format(mask, "03b")
        named = [c for c, b in zip(fields, bits) if b == "1"]
        rules = live.filter(shape == bits)
        if named:
            out = out.join(rules.select(*named).distinct(), named, "left_anti")
        else:
            out = out.filter(rules.agg(F.count(F.lit(1)) == 0).scalar())
    return out


def exception_counts(state: DataFrame, now: int) -> DataFrame:
    rows = state.filter("accepted = '1'").filter(present("exception_key"))
    return rows.groupBy("exception_key").agg(
        F.count(F.lit(1)).alias("findings_covered"), F.count_distinct("hostname").alias("hosts_covered")
    ).withColumn("rolled_at", F.lit(now).cast("bigint"))


def register_with_counts(exceptions: DataFrame, counts: DataFrame, now: int) -> DataFrame:
    rows = lookup(exception_state(exceptions, now), counts, ["exception_key"], ["findings_covered", "hosts_covered"])
    return rows.fillna(0, ["findings_covered", "hosts_covered"])


def tiles(exceptions: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """Active, expired, expiring within 14 days, and accepted findings."""
    soon = present("expires_at") & (try_double("expires_at") < now + 14 * DAY)
    kind = F.col("exc_state")
    counts = exception_state(exceptions, now).agg(
        F.count_if(kind == "active").alias("active"), F.count_if(kind == "expired").alias("expired"),
        F.count_if((kind == "active") & soon).alias("expiring"))
    accepted = state.filter("status = 'open' and accepted = '1'").agg(F.count_distinct("finding_key")).scalar()
    return counts.withColumn("accepted_findings", accepted)


def ended(exceptions: DataFrame, now: int) -> DataFrame:
    rows = exception_state(exceptions, now).filter("exc_state <> 'active'")
    return rows.withColumn("ended", F.when(
        F.col("exc_state") == "revoked", stamp_text(try_long("revoked_at"))).otherwise(F.col("expires_label")))
