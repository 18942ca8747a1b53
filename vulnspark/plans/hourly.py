"""The hourly job graph: the operators in order over a state store.

Every step reads written tables and writes new versions of others, so a lost
executor repeats a task and a stopped run goes on at its step. A step may be
repeated with the same ``now``, wherever it stopped: its events take the
place of their batch, rows of state are replaced by key, and a run that a
finding has already counted is not counted again.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import stamp_text
from vulnspark.operators import evidence, exceptions, inventory, lifecycle, matching, network, priority, routes
from vulnspark.operators.generic import first_per_key
from vulnspark.params import DAY, RETENTION_DAYS, Params
from vulnspark.plans import rollup_state, snapshot_state, version_state
from vulnspark.plans.job_graph import Step, check, forget, run_steps
from vulnspark.schemas import ENTRY, EVENTS, FLEET_COUNTS, FLOW, LINK_COVERAGE, LOADED, NETWORK_BEFORE, STATE, VERDICT
from vulnspark.sources.flows import permitted_edges
from vulnspark.sources.inventory import record_schema, split_records
from vulnspark.sources.state import StateStore

FINDING_EVENT = ("finding_key", "hostname", "package", "ecosystem", "path", "scope", "scope_id", "cve_id", "advisory_id", "installed_version",
                 "fixed_version", "confidence", "match_authority", "severity", "epss", "kev_added", "kev_due", "url", "title")


def _state(store: StateStore, name: str) -> DataFrame:
    return store.read_state(name, STATE[name])


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """The columns a state table declares, absent ones null."""
    out = df
    for field in STATE[name].split(", "):
        column, kind = field.split(" ", 1)
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast(kind))
    return out.select(*[F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]) for f in STATE[name].split(", ")])


def _built(store: StateStore, name: str, now: int) -> None:
    meta = store.spark.createDataFrame([(name, now)], STATE["snapshot_meta"])
    store.upsert_state(meta, "snapshot_meta", ["name"])


def _day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("day", stamp_text(F.col(column), "yyyy-MM-dd"))


def ingest(store: StateStore, records: DataFrame, batch: str) -> None:
    """Add a batch of scan records to the event tables, by kind and day; a repeated batch changes nothing."""
    for kind, rows in split_records(records).items():
        store.append_events(_day(rows.drop("_corrupt"), "scanned_at"), f"scan_{kind}", batch)
    for kind, update in (("component", snapshot_state.update_components), ("heartbeat", snapshot_state.update_heartbeats)):
        own = store.read_events(f"scan_{kind}", record_schema(store.spark)).filter(F.col("batch") == batch)
        update(store, own, f"batch-{batch}")


def _scans(store: StateStore, kind: str, now: int) -> DataFrame:
    """Scan records of a kind that retention still holds; days before that are not read."""
    return store.read_events(f"scan_{kind}", record_schema(store.spark), _day_text(now - RETENTION_DAYS["inventory"] * DAY))


def _day_text(t: int) -> str:
    return datetime.datetime.fromtimestamp(t, datetime.timezone.utc).strftime("%Y-%m-%d")


def _run(now: int) -> str:
    return f"run-{now}"


def snapshot_hosts(store: StateStore, now: int, p: Params) -> None:
    comps, beats = _scans(store, "component", now), _scans(store, "heartbeat", now)
    seen = comps.select("hostname", "scanned_at", "os_id", "os_version_id").unionByName(
        beats.select("hostname", "scanned_at", "os_id", "os_version_id", "architecture", "machine_id", "digest"), allowMissingColumns=True)
    store.replace_state(_shaped(inventory.host_state(seen, _state(store, "hoststate")), "hoststate"), "hoststate")
    _built(store, "hoststate", now)
    hosts = _state(store, "hoststate")
    manifest = inventory.scan_manifest(beats, comps, _state(store, "scanstate"), hosts, now, p)
    store.replace_state(_shaped(manifest, "scanstate"), "scanstate")
    ports = evidence.listening_ports(_scans(store, "exposure", now), _state(store, "exposure"), hosts, now, p)
    store.replace_state(_shaped(ports, "exposure"), "exposure")
    boxes = evidence.containers(_scans(store, "container", now), _state(store, "containers"), hosts, now, p)
    store.replace_state(_shaped(boxes, "containers"), "containers")
    store.replace_state(_shaped(inventory.host_cadence(hosts, _state(store, "hostcadence"), now, p), "hostcadence"), "hostcadence")


def match_dirty(store: StateStore, now: int, p: Params) -> None:
    """Match what changed and append findings and receipts."""
    feed_gen = str(store.live_generation())
    since = now - RETENTION_DAYS["inventory"] * DAY
    latest = snapshot_state.current_components(store, since)
    digests = inventory.host_digest(snapshot_state.current_heartbeats(store, since), latest)
    store.replace_state(digests, "digests")
    dirty = inventory.dirty_hosts(store.read_state("digests"), _state(store, "matchstate"), feed_gen, now, p)
    todo = matching.dirty_inventory(latest, dirty, _state(store, "containers"))
    store.replace_state(todo, "match_input")
    todo = store.read_state("match_input")
    found = version_state.match(store, todo, _run(now))
    events = found.select(*[c for c in FINDING_EVENT if c in found.columns], F.col("scanned_at").alias("scan_time"),
                          F.lit(now).cast("bigint").alias("match_run"), F.lit(now).cast("bigint").alias("ingested_at"))
    store.append_events(_day(events, "ingested_at"), "findings", _run(now))
    run = store.read_events("findings", EVENTS["findings"], _day_text(now)).filter(F.col("match_run") == now)
    proof = matching.receipts(todo, run, now, feed_gen).withColumn("ingested_at", F.lit(now).cast("bigint"))
    store.append_events(_day(proof, "ingested_at"), "receipts", _run(now))


def maintain_findings(store: StateStore, now: int, p: Params) -> None:
    """Fold, acknowledge, close, checkpoint, reconcile and archive, in that order.

    What the steps do to a table is one commit at the end. Findings are
    committed before the fold and match states that vouch for them, so a run
    that stops in between is done again and nothing is taken for folded.
    """
    week = _day_text(now - p.ack_window)
    events, receipts = store.read_events("findings", EVENTS["findings"], week), store.read_events("receipts", EVENTS["receipts"], week)
    inv = inventory.inventory_state(events, _scans(store, "component", now), _state(store, "invstate"), _state(store, "hoststate"), now, p)
    store.replace_state(_shaped(inv, "invstate"), "invstate")
    _built(store, "invstate", now)
    findings, folds, matches = (store.changes(name, keys, _run(now), STATE[name]) for name, keys in (
        ("findings_state", ["finding_key"]), ("foldstate", ["hostname"]), ("matchstate", ["hostname"])))
    # Runs that a host's last fold has not seen.
    done = folds.rows().select("hostname", "state_run")
    fresh = events.join(done, "hostname", "left").filter(
        F.col("state_run").isNull() | (F.col("match_run") > F.col("state_run")) | (F.col("match_run") == now)).drop("state_run")
    rows, folded = lifecycle.fold(findings.rows(), fresh, now)
    findings.upsert(_shaped(rows, "findings_state"))
    folds.upsert(_shaped(folded, "foldstate"))
    recent = receipts.filter(F.col("ingested_at") > now - p.ack_window)
    matches.upsert(_shaped(lifecycle.acknowledge(recent, folds.rows(), _state(store, "snapshot_meta"), matches.rows(), now, p), "matchstate"))
    closed = lifecycle.close_unreported(findings.rows(), matches.rows(), _state(store, "hoststate"),
                                        _state(store, "invstate"), _state(store, "scanstate"), now, p)
    findings.upsert(_shaped(closed, "findings_state"))
    marks = lifecycle.checkpoint(store.read_state("digests"), matches.rows(), recent, str(store.live_generation()), now, p)
    matches.replace(_shaped(marks, "matchstate"))
    findings.upsert(_shaped(exceptions.reconcile_acceptance(findings.rows(), _state(store, "exceptions"), now), "findings_state"))
    findings.upsert(_shaped(lifecycle.mark_silent(findings.rows(), _state(store, "hoststate"), _state(store, "hostcadence"), now), "findings_state"))
    expired, _ = lifecycle.archive_expired(findings.rows(), _state(store, "hoststate"), _state(store, "hostcadence"),
                                           _state(store, "snapshot_meta"), now, p)
    store.append_events(_day(expired, "archived_at"), "findings_archive", _run(now))
    # The copies are safe; only what has one leaves the table.
    archived = store.read_events("findings_archive", expired.schema, _day_text(now)).filter(F.col("batch") == _run(now))
    findings.delete(archived)
    for changes in (findings, folds, matches):
        changes.commit()


def _old(store: StateStore, name: str, like: DataFrame) -> DataFrame:
    """A table as the run before left it, or an empty one of the given rows' kind."""
    return store.read_state(name, like.schema)


def _table(store: StateStore, name: str, schema: str) -> DataFrame:
    """A table that a user or an importer keeps; empty where there is none."""
    return store.read_state(name, schema)


def _advisories(store: StateStore) -> DataFrame:
    """The live advisories; what a feed does not tell is null."""
    df = store.read_feed("advisories").drop("gen")
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in (("cvss_vector", "string"), ("cvss_score", "double"), ("title", "string")) if c not in df.columns})


def _open(store: StateStore) -> DataFrame:
    return lifecycle.open_findings(_state(store, "findings_state"))


def catch_up(store: StateStore, now: int, p: Params) -> None:
    """Fold whatever retention holds for hosts whose last match was never folded, however long the fold was held up."""
    matches = _state(store, "matchstate").filter(F.col("matched_at") <= now - p.ack_window)
    behind = matches.filter(F.col("folded_run").isNull() | (F.col("folded_run") < F.col("matched_at") - p.run_tolerance))
    if behind.isEmpty():
        return
    events = store.read_events("findings", EVENTS["findings"], _day_text(now - RETENTION_DAYS["findings"] * DAY))
    findings, folds = store.changes("findings_state", ["finding_key"], f"catch-up-{now}", STATE["findings_state"]), store.changes("foldstate", ["hostname"], f"catch-up-{now}", STATE["foldstate"])
    rows, folded = lifecycle.fold_catch_up(findings.rows(), events, behind, now, p)
    findings.upsert(_shaped(rows, "findings_state"))
    folds.upsert(_shaped(folded, "foldstate"))
    findings.commit()
    folds.commit()


def close_artifacts(store: StateStore, now: int, p: Params) -> None:
    """Findings on files that turned out to be installers or launchers are closed."""
    closed = lifecycle.close_role_artifacts(_state(store, "findings_state"), _scans(store, "component", now), now)
    store.upsert_state(_shaped(closed, "findings_state"), "findings_state", ["finding_key"])


def roll_up(store: StateStore, now: int, p: Params = Params()) -> None:
    rollup_state.roll_up(store, now)


def describe_fleet(store: StateStore, now: int, p: Params) -> None:
    """Counts per ecosystem, vendors, loaded libraries, configuration and how far the evidence reaches."""
    hosts = _state(store, "hoststate")
    latest = snapshot_state.current_components(store, now - RETENTION_DAYS["inventory"] * DAY)
    counts = _table(store, "fleet_counts", FLEET_COUNTS).filter("hostname <> '__fleet__'")
    store.replace_state(inventory.ecosystem_counts(latest, counts, hosts, now, p), "fleet_counts")
    store.replace_state(inventory.vendors(latest), "vendors")
    links, config = _scans(store, "link", now), _scans(store, "config", now)
    store.replace_state(evidence.loaded_libraries(links, _table(store, "loaded", LOADED), hosts, now, p), "loaded")
    store.replace_state(evidence.link_coverage(links, _table(store, "link_coverage", LINK_COVERAGE), hosts, now, p), "link_coverage")
    store.replace_state(inventory.config_surface(config, _old(store, "config", config), hosts, now, p), "config")
    exposure = _state(store, "exposure")
    store.replace_state(evidence.exposure_coverage(exposure), "exposure_coverage")
    store.replace_state(evidence.reach(exposure, now), "reach")


def observe_network(store: StateStore, now: int, p: Params) -> None:
    """Permitted edges, who claims which address, and what was observed of each listening port."""
    flows = store.read_events("flows", FLOW, _day_text(now - p.flow_absence_days * DAY))
    store.replace_state(permitted_edges(flows), "edges")
    claims = network.host_addresses(_scans(store, "exposure", now))
    store.replace_state(network.address_claims(claims, _old(store, "claims", claims), _state(store, "hoststate"), now, p), "claims")
    edges, held = store.read_state("edges"), store.read_state("claims")
    seen = network.assess_observed(edges, _table(store, "entries", ENTRY), held, _state(store, "exposure"), _state(store, "findings_state"),
                                   _table(store, "netevidence", NETWORK_BEFORE), now, p)
    store.replace_state(seen, "netevidence")


def walk_routes(store: StateStore, now: int, p: Params) -> None:
    """What a route may use, the walk from every entry with its time, the paths and what listens along them."""
    exposure, verdicts = _state(store, "exposure"), _table(store, "verdicts", VERDICT)
    advisories = _advisories(store)
    store.replace_state(routes.hop_class(_state(store, "findings_state"), exposure, advisories, verdicts), "hop_class")
    hops = store.read_state("hop_class")
    store.replace_state(routes.route_edges(store.read_state("netevidence"), store.read_state("edges"), store.read_state("claims"), hops), "route_edges")
    edges = store.read_state("route_edges")
    store.replace_state(routes.grade_edges(edges, p.max_hops).withColumn("walked_at", F.lit(now).cast("bigint")), "walk")
    store.replace_state(routes.enumerate_paths(edges, p), "paths")
    store.replace_state(routes.route_listeners(hops, exposure, edges), "route_listeners")


def queue_priorities(store: StateStore, now: int, p: Params) -> None:
    """CVEs that wait for a verdict, and hosts whose findings never arrived."""
    advisories, verdicts = _advisories(store), _table(store, "verdicts", VERDICT)
    queue = priority.candidate_queue(_open(store), store.read_state("reach"), advisories, store.read_state("vendors"), verdicts, p)
    store.replace_state(queue, "candidates")
    receipts = store.read_events("receipts", EVENTS["receipts"], _day_text(now - p.stuck_window)).filter(F.col("ingested_at") > now - p.stuck_window)
    store.replace_state(lifecycle.stalled(receipts, _state(store, "matchstate"), store.read_state("feedstate").withColumn("generation", F.col("generation").cast("string")), p), "stalled")


def renew_exceptions(store: StateStore, now: int, p: Params) -> None:
    """Which exceptions are in force, and an audit row for each that ran out."""
    known = _state(store, "exceptions")
    expired = exceptions.expiry_events(known, now)
    store.append_events(expired.withColumn("day", F.lit(_day_text(now))), "audit", _run(now))
    store.upsert_state(_shaped(exceptions.reconcile_live_keys(known, now), "exceptions"), "exceptions", ["exception_key"])


#: What other jobs bring: scans, flows, feeds and what users keep.
GIVEN = ("scan_component", "scan_heartbeat", "scan_exposure", "scan_container", "scan_link", "scan_config", "component_facts", "heartbeat_facts",
         "flows", "feed", "entries", "verdicts")

STEPS = [
    Step("hosts", snapshot_hosts, ("scan_component", "scan_heartbeat", "scan_exposure", "scan_container"),
         ("hoststate", "scanstate", "exposure", "containers", "hostcadence")),
    Step("match", lambda store, now, p: match_dirty(store, now, p), ("component_facts", "heartbeat_facts", "containers", "feed"),
         ("digests", "findings", "receipts", "version_keys")),
    Step("exceptions", renew_exceptions, (), ("exceptions", "audit")),
    Step("catch-up", catch_up, ("findings",), ("findings_state", "foldstate")),
    Step("findings", maintain_findings, ("findings", "receipts", "digests", "hoststate", "scanstate", "hostcadence", "exceptions"),
         ("findings_state", "foldstate", "matchstate", "invstate", "findings_archive")),
    Step("artifacts", close_artifacts, ("findings_state", "scan_component"), ("findings_state",)),
    Step("roll-ups", roll_up, ("findings_state",), ("openstate_host", "openstate_dim", "openstate_host_dim", "openstate_cve")),
    Step("fleet", describe_fleet, ("component_facts", "hoststate", "scan_link", "scan_config", "exposure"),
         ("fleet_counts", "vendors", "loaded", "link_coverage", "config", "exposure_coverage", "reach")),
    Step("network", observe_network, ("flows", "scan_exposure", "hoststate", "exposure", "findings_state", "entries"), ("edges", "claims", "netevidence")),
    Step("routes", walk_routes, ("findings_state", "exposure", "netevidence", "edges", "claims", "feed", "verdicts"),
         ("hop_class", "route_edges", "walk", "paths", "route_listeners")),
    Step("priorities", queue_priorities, ("findings_state", "reach", "vendors", "matchstate", "receipts", "feed", "verdicts"), ("candidates", "stalled")),
]
check(STEPS, GIVEN)


def hourly(store: StateStore, now: int, p: Params = Params()) -> list[str]:
    """One run over everything ingested so far; goes on where an earlier one of the same ``now`` stopped."""
    ran = run_steps(store, STEPS, now, p)
    expire(store, now)
    forget(store, now - DAY)
    return ran


def ingest_flows(store: StateStore, flows: DataFrame, batch: str) -> None:
    """Add a batch of flow records, by the day of their time; a repeated batch changes nothing."""
    store.append_events(_day(flows, "time"), "flows", batch)


def expire(store: StateStore, now: int) -> None:
    """Drop event days older than their retention."""
    for kind in ("component", "heartbeat", "exposure", "container", "link", "config"):
        store.expire_partitions(f"scan_{kind}", RETENTION_DAYS["inventory"], now)
    snapshot_state.expire_snapshots(store, now - RETENTION_DAYS["inventory"] * DAY)
    for name, kept in (("findings", "findings"), ("receipts", "findings"), ("findings_archive", "findings_archive")):
        store.expire_partitions(name, RETENTION_DAYS[kept], now)


def newest_batch(progress: DataFrame, stream: str) -> DataFrame:
    return first_per_key(progress.filter(F.col("stream") == stream), ["stream"], F.col("batch_id").desc())
