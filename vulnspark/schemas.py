"""Explicit schemas of raw records and state tables, as DDL."""

from __future__ import annotations

ATTRIBUTES = "map<string,string>"

COMPONENT = (
    "hostname string, name string, type string, version string, purl string, cpes array<string>, locations array<string>, "
    "root string, vendor string, os_id string, os_version_id string, found_by string, source_key string, source string, "
    "owned_by string, source_package string")
HEARTBEAT = (
    "digest bigint, n_components bigint, scan_id string, collector_version string, schema_version string, "
    "counts struct<component:bigint,exposure:bigint,link:bigint,container:bigint>, "
    "sources map<string,struct<status:string,reason:string>>, "
    "scan_profile struct<full_scan:string,elf_scope:string,config_scope:string>, duration_ms bigint, os_build string, "
    "os_display_version string, os_edition string, os_installation_type string, machine_id string, architecture string")
EXPOSURE = (
    "port bigint, protocol string, address string, family string, bind_scope string, executable string, unit string, "
    "user string, container_id string, container_name string, confidence string, os_component string")
CONTAINER = (
    "runtime string, state string, image_ref string, image_digest string, endpoints array<string>, "
    "declared_endpoints array<string>")
LINK = "executable_purl string, path string, soname string, listening string"
CONFIG = (
    "kind string, attack string, schedule string, mode string, setuid string, setgid string, world_writable string, "
    "n_evidence bigint")

#: Every record type in one schema: a record fills only its own fields.
INVENTORY_RECORD = (
    f"record_type string, scanned_at string, attributes {ATTRIBUTES}, {COMPONENT}, {HEARTBEAT}, {EXPOSURE}, {CONTAINER}, "
    f"{LINK}, {CONFIG}, _corrupt string")

RANGE = (
    "ecosystem string, package string, package_display string, advisory_id string, cve_id string, introduced string, "
    "introduced_excluding string, fixed string, last_affected string, distro string, distro_release string, "
    "distro_variant string, source_package string, feed_source string, range_type string, status string")
NOT_AFFECTED = (
    "ecosystem string, package string, advisory_id string, distro string, distro_release string, distro_variant string, "
    "status string, reason string")
EDGE = ("src_ip string, dest_ip string, port bigint, protocol string, sessions bigint, edge_first_seen bigint, "
        "edge_last_seen bigint")
ENTRY = "cidr string, name string, pressure string"
#: A flow record as the default mapping of a flow log names its columns.
FLOW = "src_ip string, dest_ip string, dest_port bigint, transport string, time bigint, action string"
#: What an assessment of observed traffic needs of the one before.
NETWORK_BEFORE = "hostname string, port string, observed_grade string, grade_changed_at bigint, reappeared_at bigint"
VERDICT = "cve_id string, sig string, priority_tier string, priority_score int, confidence double, analysed_at bigint"
FLEET_COUNTS = "hostname string, type string, components bigint, instances bigint, with_identifier bigint, cpe_ident bigint, assessed_at bigint"
LOADED = ("hostname string, scope_key string, package string, load_class string, load_rank int, loaders string, loader_count bigint, "
          "loaded_listening int, scanned_at bigint")
LINK_COVERAGE = ("hostname string, link_rows bigint, linked_packages bigint, listening_loaders bigint, unowned_libraries bigint, "
                 "assessed_at bigint")

#: State tables of the hourly run, used when a table does not exist yet.
STATE = {
    "hoststate": "hostname string, host_last_scan bigint, os string, release string, arch string, machine_id string, heartbeat_digest bigint",
    "matchstate": (
        "hostname string, digest bigint, feed_gen string, matcher_version string, matched_at bigint, n_components bigint, "
        "folded_run bigint, folded_at bigint, folded_findings bigint, digest_changed_at bigint"),
    "foldstate": "hostname string, rows_at_run bigint, state_run bigint, folded_pass_at bigint",
    "invstate": (
        "hostname string, package string, path string, current_version string, found_by string, source string, "
        "inv_time bigint, cat_ran int"),
    "scanstate": "hostname string, scanned_at bigint, sources_text string, n_sources int, sources_shrank int, has_profile int",
    "hostcadence": (
        "hostname string, last_contact_at bigint, first_seen_at bigint, gaps array<bigint>, n_gaps int, median_gap bigint, "
        "p95_gap bigint, learned int, late int, contact_age bigint"),
    "exposure": (
        "hostname string, port bigint, protocol string, address string, bind_scope string, executable string, unit string, "
        "package string, package_key string, purl string, container_id string, container_name string, confidence string, "
        "held_by_os int, scanned_at bigint"),
    "containers": (
        "hostname string, container_id string, container_short string, container_name string, runtime string, state string, "
        "image_ref string, image_digest string, os_id string, os_version_id string, endpoints_text string, declared_text string, "
        "n_endpoints int, n_public_endpoints int, scanned_at bigint"),
    "findings_state": (
        "finding_key string, first_seen bigint, last_seen bigint, first_found bigint, last_match_run bigint, first_version string, "
        "last_version string, current_version string, cve_id string, hostname string, package string, ecosystem string, path string, "
        "scope string, scope_id string, fixed_version string, confidence string, match_authority string, severity string, epss double, "
        "kev_added string, kev_due string, url string, title string, times_seen bigint, age_days double, status string, "
        "closure_reason string, mitigation string, closed_at bigint, accepted string, exception_key string, "
        "exception_expires_at string, archived bigint"),
    "exceptions": (
        "exception_key string, scope_kind string, cve_id string, hostname string, finding_key string, created_at bigint, "
        "expires_at string, revoked_at string, match_key string, active_match_key string, control string"),
    "snapshot_meta": "name string, built_at bigint",
    "stream_progress": "stream string, batch_id bigint",
    "stream_runs": "stream string, batch_id bigint, now bigint",
}

#: Event tables of the hourly run, used when one has no events yet; scan tables follow from the record split.
EVENTS = {
    "findings": (
        "finding_key string, hostname string, package string, ecosystem string, path string, scope string, scope_id string, "
        "cve_id string, advisory_id string, installed_version string, fixed_version string, confidence string, "
        "match_authority string, severity string, epss double, kev_added string, kev_due string, url string, title string, "
        "scan_time bigint, match_run bigint, ingested_at bigint"),
    "receipts": (
        "hostname string, components_matched bigint, findings_produced bigint, match_run bigint, match_feed_gen string, "
        "ingested_at bigint"),
}
