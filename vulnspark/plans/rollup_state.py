"""Roll-up tables that follow the versions of the finding table.

Each table notes the version of the findings it was made from. A run takes
the difference between that version and the newest, which reads only the
buckets that were rewritten in between; where the old version is gone, the
roll-ups are counted anew. A run that stops half-way leaves the notes behind,
and the next one takes the difference from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vulnspark.operators import rollup_changes as rc
from vulnspark.operators import rollups
from vulnspark.sources.buckets import KeyedTable, Manifest
from vulnspark.sources.state import StateStore

#: Roll-up table: its key, its rows (of some groups only, if given) and the groups a delta changes.
TABLES = {
    "openstate_host": (["hostname"], rc.host_rows, rc.changed_hosts),
    "openstate_dim": (["dim", "value"], lambda state, now, only: rollups.rollup_dim(state, only), rc.changed_dims),
    "openstate_host_dim": (["hostname", "dim", "value"], lambda state, now, only: rollups.rollup_host_dim(state, only), rc.changed_host_dims),
    "openstate_cve": (["cve_id"], lambda state, now, only: rc.cve_rows(state, only), rc.changed_cves),
}


def _written(store: StateStore, rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def _noted(table: KeyedTable, findings: KeyedTable) -> int | None:
    """The findings' version a roll-up was made from; none if it has to be made anew."""
    m = table.manifest()
    since = m.note.get("findings") if m else None
    return since if since in findings.versions() else None


def roll_up(store: StateStore, now: int, findings: str = "findings_state") -> None:
    """Bring the roll-ups to the newest version of the findings."""
    source = KeyedTable(store, findings)
    new = source.manifest()
    if new is None:
        return
    note, deltas, folder = {"findings": new.version}, {}, f"{store.root}/openstate_delta"

    def delta(since: int) -> DataFrame:
        if since not in deltas:
            rows = rc.signed_facts(*source.difference(source.manifest(since), new))
            deltas[since] = _written(store, rows, f"{folder}/{now}-{since}-{new.version}")
        return deltas[since]

    for name, (key, rows_of, changed) in TABLES.items():
        table = KeyedTable(store, name)
        since = _noted(table, source)
        if since == new.version:
            continue
        state = source.read(new)
        if since is None:
            table.replace(_written(store, rows_of(state, now, None), f"{folder}/{name}"), key, note=note)
            continue
        changes = store.changes(name, key, f"rollup-{now}")
        touched = _written(store, changed(delta(since)), f"{folder}/{name}")
        changes.upsert(rows_of(state, now, touched))
        changes.delete(touched.join(changes.staged[-1].select(*key), key, "left_anti"))
        table.commit(changes.newest(), key, note=note)
        store._remove(changes.folder)
    store._remove(folder)
