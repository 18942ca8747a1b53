"""State tables, feed generations and the hourly run end to end."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vulnspark.plans.hourly import hourly, ingest
from vulnspark.schemas import NOT_AFFECTED, RANGE
from vulnspark.sources.inventory import read_inventory, read_scan_document, split_records
from vulnspark.sources.state import StateStore
from vulnspark.streaming.incremental import daily_counts, run_stream

T0 = 1767225600  # 2026-01-01
ADVISORY = "advisory_id string, cve_id string, title string, severity string, epss double, kev_added string, kev_due string, url string"


def stamp(t):
    import datetime
    return datetime.datetime.fromtimestamp(t, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def scan(folder, name, host, t, version):
    base = {"hostname": host, "scanned_at": stamp(t)}
    rows = [
        {**base, "name": "openssl", "type": "deb", "version": version, "os_id": "ubuntu", "os_version_id": "24.04", "locations": ["/var/lib/dpkg/status.d/openssl"],
         "source_key": "dpkg", "purl": f"pkg:deb/ubuntu/openssl@{version}?distro=ubuntu-24.04"},
        {**base, "name": "zlib", "type": "deb", "version": "1.3", "os_id": "ubuntu", "os_version_id": "24.04", "locations": ["/var/lib/dpkg/status.d/zlib"], "source_key": "dpkg"},
        {**base, "record_type": "heartbeat", "n_components": 2, "sources": {"dpkg": {"status": "ok"}}, "counts": {"component": 2}, "scan_profile": {"full_scan": "yes"},
         "os_id": "ubuntu", "os_version_id": "24.04"},
        {**base, "record_type": "exposure", "port": 443, "protocol": "tcp", "address": "10.0.0.1", "bind_scope": "wildcard", "purl": "pkg:deb/ubuntu/openssl@1"},
        {**base, "record_type": "container", "container_id": "abcdef0123456789", "state": "running", "endpoints": ["0.0.0.0:80"], "declared_endpoints": []}]
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def load(store, spark, now, fixed="3.0.13-0ubuntu3.5"):
    ranges = [("deb", "openssl", "openssl", "USN-1", "CVE-2026-1", "", "", fixed, "", "ubuntu", "24.04", "", "openssl", "osv", "ECOSYSTEM", "affected")]
    store.load_feed({
        "ranges": spark.createDataFrame(ranges, RANGE), "notaffected": spark.createDataFrame([], NOT_AFFECTED),
        "advisories": spark.createDataFrame([("USN-1", "CVE-2026-1", "Flaw", "high", 0.5, "2026-01-01", "", "u")], ADVISORY)}, now)


def test_upgrade_is_found_and_then_closed(spark, tmp_path):
    scans = tmp_path / "scans"
    scans.mkdir()
    store = StateStore(spark, str(tmp_path / "state"))
    load(store, spark, T0 - 4000)
    scan(scans, "a-1.ndjson", "a", T0, "3.0.13-0ubuntu3.4")
    scan(scans, "b-1.ndjson", "b", T0, "3.0.13-0ubuntu3.9")
    ingest(store, read_inventory(spark, str(scans / "*-1.ndjson")), "1")
    hourly(store, T0 + 600)
    rows = store.read_state("findings_state").collect()
    assert [(r.hostname, r.cve_id, r.status, r.confidence, r.times_seen) for r in rows] == [("a", "CVE-2026-1", "open", "high", 1)]
    receipts = {r.hostname: r.findings_produced for r in store.read_events("receipts").collect()}
    assert receipts == {"a": 1, "b": 0}
    assert store.read_state("openstate_host").first().findings == 1
    # The upgraded host is matched again, reports nothing, and the finding closes as upgraded.
    scan(scans, "a-2.ndjson", "a", T0 + 7200, "3.0.13-0ubuntu3.5")
    ingest(store, read_inventory(spark, str(scans / "a-2.ndjson")), "2")
    hourly(store, T0 + 7800)
    (row,) = store.read_state("findings_state").collect()
    assert (row.status, row.closure_reason, row.mitigation) == ("mitigated", "upgraded", "3.0.13-0ubuntu3.4 -> 3.0.13-0ubuntu3.5")


def test_stream_takes_each_file_once(spark, tmp_path):
    scans = tmp_path / "scans"
    scans.mkdir()
    store = StateStore(spark, str(tmp_path / "state"))
    load(store, spark, T0 - 4000)
    scan(scans, "a-1.ndjson", "a", T0, "3.0.13-0ubuntu3.4")
    scan(scans, "a-latest.ndjson", "a", T0, "3.0.13-0ubuntu3.4")
    for _ in range(2):
        run_stream(spark, str(scans), store, str(tmp_path / "ckpt"), lambda: T0 + 600).awaitTermination()
    assert store.read_events("scan_component").count() == 2
    assert store.read_state("findings_state").first().times_seen == 1
    assert store.read_state("stream_progress").first().batch_id == 0


class Stop(Exception):
    pass


def stop_after(store, writes):
    """Make the store fail after so many writes."""
    left = [writes]
    for name in ("replace_state", "append_events", "commit_changes"):
        def step(*a, _f=getattr(StateStore, name).__get__(store), **k):
            if left[0] == 0:
                raise Stop
            left[0] -= 1
            return _f(*a, **k)
        setattr(store, name, step)


def outcome(store):
    rows = sorted((r.finding_key, r.times_seen, r.status, r.last_match_run) for r in store.read_state("findings_state").collect())
    return rows, store.read_events("scan_component").count(), store.read_events("findings").count(), sorted(map(tuple, store.read_state("foldstate").collect()))


def test_a_run_stopped_anywhere_and_repeated_gives_the_same_state(spark, tmp_path):
    scans = tmp_path / "scans"
    scans.mkdir()
    scan(scans, "a-1.ndjson", "a", T0, "3.0.13-0ubuntu3.4")
    records = read_inventory(spark, str(scans / "a-1.ndjson"))

    def fresh(name):
        store = StateStore(spark, str(tmp_path / name))
        load(store, spark, T0 - 4000)
        return store

    whole = fresh("whole")
    ingest(whole, records, "1")
    hourly(whole, T0 + 600)
    for writes in (12, 19):
        store = fresh(f"stopped-{writes}")
        with pytest.raises(Stop):
            stop_after(store, writes)
            ingest(store, records, "1")
            hourly(store, T0 + 600)
        store = StateStore(spark, str(tmp_path / f"stopped-{writes}"))
        ingest(store, records, "1")
        hourly(store, T0 + 600)
        assert outcome(store) == outcome(whole), writes
    # A second run inside the fold window finds nothing new and counts nothing again.
    before = outcome(whole)[0]
    hourly(whole, T0 + 700)
    assert outcome(whole)[0] == before and before[0][1] == 1


def test_fleet_without_containers_ports_or_heartbeats(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    load(store, spark, T0 - 4000)
    (tmp_path / "c.ndjson").write_text(json.dumps({"hostname": "a", "scanned_at": stamp(T0), "name": "openssl", "type": "deb", "version": "3.0.13-0ubuntu3.4", "os_id": "ubuntu",
                                                   "os_version_id": "24.04", "locations": ["/var/lib/dpkg/status.d/openssl"], "purl": "pkg:deb/ubuntu/openssl@1?distro=ubuntu-24.04"}) + "\n")
    ingest(store, read_inventory(spark, str(tmp_path / "c.ndjson")), "1")
    hourly(store, T0 + 600)
    assert [r.status for r in store.read_state("findings_state").collect()] == ["open"]


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    for i in range(4):
        store.replace_state(spark.createDataFrame([(i,)], "v int"), "t")
        if i == 0:
            reader = store.read_state("t")
    assert [r.v for r in reader.collect()] == [0] and [r.v for r in store.read_state("t").collect()] == [3]
    store.replace_state(spark.createDataFrame([(9,)], "v int"), "t", grace=-1)
    assert len(store.versions("t")) == 1


def test_feed_flip_refuses_an_empty_table(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    load(store, spark, T0)
    with pytest.raises(ValueError):
        store.load_feed({"ranges": spark.createDataFrame([], RANGE), "advisories": spark.createDataFrame([], ADVISORY)}, T0)
    assert store.live_generation() == 1 and store.read_feed("ranges").count() == 1
    load(store, spark, T0, fixed="9")
    assert store.live_generation() == 2 and store.read_feed("ranges").first().fixed == "9"


def test_unfinished_version_is_not_read(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    store.replace_state(spark.createDataFrame([("a", 1)], "k string, v int"), "t")
    spark.createDataFrame([("b", 2)], "k string, v int").write.parquet(str(tmp_path / "t" / "v=000000000002"))
    (tmp_path / "t" / "v=000000000002" / "_SUCCESS").unlink()
    assert [r.k for r in store.read_state("t").collect()] == ["a"]
    store.upsert_state(spark.createDataFrame([("a", 5), ("c", 6)], "k string, v int"), "t", ["k"])
    assert sorted((r.k, r.v) for r in store.read_state("t").collect()) == [("a", 5), ("c", 6)]


def test_retention_drops_old_days(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    store.append_events(spark.createDataFrame([("2026-01-01", 1), ("2026-02-01", 2)], "day string, v int"), "x", "1")
    assert store.expire_partitions("x", 10, T0 + 35 * 86400) == ["day=2026-01-01"]
    assert [r.v for r in store.read_events("x").collect()] == [2]


def test_scan_documents_and_bad_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"host": {"hostname": "h", "os_id": "ubuntu", "scanned_at": stamp(T0)}, "components": [{"name": "x", "version": "1"}, {"name": "y", "os_id": "alpine"}]}))
    rows = {r.name: r for r in read_scan_document(spark, str(tmp_path / "doc.json")).collect()}
    assert rows["x"].os_id == "ubuntu" and rows["y"].os_id == "alpine" and rows["x"].scanned_at == T0
    (tmp_path / "bad.ndjson").write_text('{"hostname":"a","name":"x"}\nnot json\n')
    raw = read_inventory(spark, str(tmp_path / "bad.ndjson")).cache()
    assert raw.filter(F.col("_corrupt").isNotNull()).count() == 1
    assert split_records(raw)["component"].count() == 1


def test_daily_counts_stream_with_a_watermark(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01 01:00:00", "a"), ("2026-01-01 02:00:00", "a"), ("2026-01-02 01:00:00", "b")], "ts string, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.day, r.event_type, r.n) for r in spark.table("days").collect()) == [("2026-01-01", "a", 2), ("2026-01-02", "b", 1)]
