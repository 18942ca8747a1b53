"""The whole run from scans, flows and feeds to priorities and routes, stopped and gone on with."""

from __future__ import annotations

import json

import pytest
from test_pipeline import T0, stamp

from vulnspark.plans import hourly, version_state
from vulnspark.plans.job_graph import Step, check, done, run_steps
from vulnspark.schemas import ENTRY, FLOW, NOT_AFFECTED, RANGE
from vulnspark.sources.inventory import read_inventory
from vulnspark.sources.state import StateStore

ADVISORY = ("advisory_id string, cve_id string, title string, severity string, epss double, kev_added string, kev_due string, url string, "
            "cvss_vector string, cvss_score double")


def scans(folder):
    rows = []
    for host, address in (("web", "10.0.0.1"), ("db", "10.0.0.2")):
        base = {"hostname": host, "scanned_at": stamp(T0)}
        rows += [{**base, "name": "openssl", "type": "deb", "version": "3.0.13-0ubuntu3.4", "os_id": "ubuntu", "os_version_id": "24.04", "vendor": "OpenSSL",
                  "locations": ["/var/lib/dpkg/status.d/openssl"], "source_key": "dpkg", "purl": "pkg:deb/ubuntu/openssl@3?distro=ubuntu-24.04"},
                 {**base, "record_type": "heartbeat", "n_components": 1, "sources": {"dpkg": {"status": "ok"}}, "counts": {"component": 1},
                  "scan_profile": {"full_scan": "yes"}, "os_id": "ubuntu", "os_version_id": "24.04"},
                 {**base, "record_type": "exposure", "port": 443, "protocol": "tcp", "address": address, "family": "ipv4", "bind_scope": "specific",
                  "executable": "/usr/sbin/nginx", "purl": "pkg:deb/ubuntu/openssl@3"},
                 {**base, "record_type": "link", "executable": "/usr/sbin/nginx", "purl": "pkg:deb/ubuntu/openssl@3", "path": "/lib/ssl.so", "soname": "ssl", "listening": "true"},
                 {**base, "record_type": "config", "kind": "sudoers", "path": "/etc/sudoers"}]
    (folder / "s.ndjson").write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def prepared(spark, tmp_path):
    scans(tmp_path)
    store = StateStore(spark, str(tmp_path / "state"))
    text = ("deb", "openssl", "openssl", "USN-1", "CVE-2026-1", "", "", "3.0.13-0ubuntu3.5", "", "ubuntu", "24.04", "", "openssl", "osv", "ECOSYSTEM", "affected")
    version_state.load_feed(store, {
        "ranges": spark.createDataFrame([text], RANGE), "notaffected": spark.createDataFrame([], NOT_AFFECTED),
        "advisories": spark.createDataFrame([("USN-1", "CVE-2026-1", "Flaw", "high", 0.2, "", "", "u", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8)], ADVISORY)}, T0 - 4000)
    hourly.ingest(store, read_inventory(spark, str(tmp_path / "s.ndjson")), "1")
    flows = [("203.0.113.9", "10.0.0.1", 443, "TCP", T0, "allowed"), ("10.0.0.1", "10.0.0.2", 443, "TCP", T0, "allowed"), ("10.0.0.1", "10.0.0.2", 22, "TCP", T0, "denied")]
    hourly.ingest_flows(store, spark.createDataFrame(flows, FLOW), "1")
    store.replace_state(spark.createDataFrame([("203.0.113.0/24", "internet", "constant")], ENTRY), "entries")
    return store


def test_run_goes_on_at_the_step_where_it_stopped(spark, tmp_path, monkeypatch):
    store = prepared(spark, tmp_path)
    names = [s.name for s in hourly.STEPS]

    def stop(*_):
        raise RuntimeError

    broken = [Step(s.name, stop, s.reads, s.writes) if s.name == "network" else s for s in hourly.STEPS]
    with pytest.raises(RuntimeError):
        run_steps(store, broken, T0 + 600)
    at = names.index("network")
    assert done(store, f"run-{T0 + 600}") == sorted(names[:at])
    assert hourly.hourly(store, T0 + 600) == names[at:]
    assert hourly.hourly(store, T0 + 600) == []
    found = store.read_state("findings_state").collect()
    assert sorted((r.hostname, r.cve_id, r.status, r.times_seen) for r in found) == [("db", "CVE-2026-1", "open", 1), ("web", "CVE-2026-1", "open", 1)]
    seen = {(r.hostname, r.port): r.observed_grade for r in store.read_state("netevidence").collect()}
    assert seen[("web", "443")] == "confirmed observed"
    edges = {(r.src, r.dst, r.kind) for r in store.read_state("route_edges").collect()}
    assert ("web", "db", "host") in edges and any(dst == "web" and kind == "entry" for _, dst, kind in edges)
    walk = {(r.src, r.dst): (r.hop, r.walked_at) for r in store.read_state("walk").collect()}
    assert walk[("web", "db")] == (2, T0 + 600)
    assert any(r.path_text.endswith("web → db") for r in store.read_state("paths").collect())
    assert {r.hostname for r in store.read_state("route_listeners").collect()} == {"web", "db"}
    (waiting,) = store.read_state("candidates").collect()
    assert (waiting.cve_id, waiting.vendor) == ("CVE-2026-1", "OpenSSL")
    assert {(r.hostname, r.type, r.components) for r in store.read_state("fleet_counts").collect()} >= {("__fleet__", "deb", 2)}
    assert store.read_state("loaded").count() == 2 and store.read_state("config").count() == 2 and store.read_state("stalled").count() == 0


def test_a_fold_held_up_for_weeks_is_caught_up(spark, tmp_path):
    store = prepared(spark, tmp_path)
    late = T0 + 20 * 86400
    for step in hourly.STEPS[:2]:
        step.run(store, T0 + 600, hourly.Params())
    store.upsert_state(spark.createDataFrame([("web", T0 + 600), ("db", T0 + 600)], "hostname string, matched_at bigint").selectExpr(
        "hostname", "CAST(NULL AS BIGINT) AS digest", "CAST(NULL AS STRING) AS feed_gen", "CAST(NULL AS STRING) AS matcher_version", "matched_at",
        "CAST(1 AS BIGINT) AS n_components", "CAST(NULL AS BIGINT) AS folded_run", "CAST(NULL AS BIGINT) AS folded_at", "CAST(NULL AS BIGINT) AS folded_findings",
        "CAST(NULL AS BIGINT) AS digest_changed_at"), "matchstate", ["hostname"])
    hourly.catch_up(store, late, hourly.Params())
    assert sorted((r.hostname, r.times_seen) for r in store.read_state("findings_state").collect()) == [("db", 1), ("web", 1)]
    hourly.catch_up(store, late, hourly.Params())
    assert sorted((r.hostname, r.times_seen) for r in store.read_state("findings_state").collect()) == [("db", 1), ("web", 1)]


def test_steps_declare_what_they_read():
    def nothing(*_):
        pass

    check([Step("a", nothing, ("x",), ("y",)), Step("b", nothing, ("y",))], ("x",))
    with pytest.raises(ValueError):
        check([Step("b", nothing, ("y",)), Step("a", nothing, (), ("y",))], ())
    with pytest.raises(ValueError):
        check([Step("a", nothing), Step("a", nothing)], ())
