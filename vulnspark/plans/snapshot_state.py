"""Snapshots of the newest records per host, kept in the store and updated by each batch.

They take the place of reading every scan that retention holds: a batch
rewrites the buckets of the hosts it has, and a run reads one row for each
component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import blank
from vulnspark.operators.identity import optional, primary_path, with_role
from vulnspark.operators.inventory import INVENTORY_FIELDS
from vulnspark.operators.snapshots import facts, merged, read_facts
from vulnspark.sources.buckets import KeyedTable
from vulnspark.sources.state import StateStore

COMPONENT = ["hostname", "name", "type", "path", "root"]
HEARTBEAT_FIELDS = ["digest", "n_components"]
#: Buckets the components of one host may spread over.
PARTS = 8


def _merge(store: StateStore, new: DataFrame, name: str, keys: list[str], run: str, by: list[str] | None = None) -> DataFrame:
    """Merge a batch's facts into a table; the batch's facts as a written table."""
    path = f"{store.root}/{name}/batch/{run}"
    new.write.mode("overwrite").parquet(path)
    new = store.spark.read.schema(new.schema).parquet(path)
    KeyedTable(store, name).merge(new, keys, lambda old, rows: _facts_of_both(old, rows, keys), by=by)
    return new


def _facts_of_both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merged facts; a key with a null part equals no other, so those rows stay as they are."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    out = merged(old.filter(whole), new.filter(whole), keys)
    return out.unionByName(old.filter(~whole)).unionByName(new.filter(~whole))


def update_components(store: StateStore, components: DataFrame, run: str) -> None:
    """Take a batch of component records into the snapshot; a repeated batch changes nothing."""
    rows = components.withColumn("path", primary_path(components)).withColumn("root", blank(optional(components, "root")))
    rows = with_role(rows)
    fields = [c for c in INVENTORY_FIELDS if c in rows.columns]
    new = facts(rows, COMPONENT, fields)
    key = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c), F.lit("\u0000")) for c in COMPONENT]))
    new = new.withColumn("component_key", key).withColumn("part", F.pmod(F.xxhash64("component_key"), F.lit(PARTS)).cast("int"))
    new = _merge(store, new, "component_facts", ["component_key", *COMPONENT, "part"], run, by=["hostname", "part"])
    hosts = facts(new, ["hostname"], [])
    store._remove(f"{store.root}/host_newest/batch")
    _merge(store, hosts, "host_newest", ["hostname"], run)
    store._remove(f"{store.root}/component_facts/batch")


def current_components(store: StateStore, since: int | None = None) -> DataFrame:
    """Components of each host's newest scan with the newest value of every field, as :func:`inventory.latest_inventory` gives them."""
    rows, hosts = store.read_state("component_facts"), store.read_state("host_newest")
    rows = rows.join(hosts.select("hostname", F.col("scanned_at").alias("_newest")), "hostname").filter(F.col("scanned_at") >= F.col("_newest"))
    rows = rows if since is None else rows.filter(F.col("scanned_at") >= since)
    fields = [c for c in INVENTORY_FIELDS if c in rows.columns]
    return read_facts(rows, fields, since).select(*COMPONENT, *fields, "scanned_at")


def update_heartbeats(store: StateStore, heartbeats: DataFrame, run: str) -> None:
    _merge(store, facts(heartbeats, ["hostname"], HEARTBEAT_FIELDS), "heartbeat_facts", ["hostname"], run)
    store._remove(f"{store.root}/heartbeat_facts/batch")


def current_heartbeats(store: StateStore, since: int | None = None) -> DataFrame:
    """One row per host: the newest digest and component count its heartbeats gave."""
    rows = store.read_state("heartbeat_facts")
    rows = rows if since is None else rows.filter(F.col("scanned_at") >= since)
    return read_facts(rows, HEARTBEAT_FIELDS, since).select("hostname", *HEARTBEAT_FIELDS, "scanned_at")


def expire_snapshots(store: StateStore, limit: int) -> None:
    """Drop what was last seen before ``limit``."""
    for name in ("component_facts", "host_newest", "heartbeat_facts"):
        table = KeyedTable(store, name)
        m = table.manifest()
        if m is not None:
            changes = store.changes(name, m.keys, f"expire-{limit}")
            changes.delete(table.read(m).filter(F.col("scanned_at") < limit))
            table.commit(changes.newest(), m.keys)
            store._remove(changes.folder)
