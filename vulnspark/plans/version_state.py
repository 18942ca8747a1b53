"""Version keys and claims that outlive a run.

The key of a version text never changes, so the store keeps one row for each
text it has met, in feeds or on hosts, and only new ones are worked out. A
feed generation keeps its claims with all keys in place; a run that matches
a few hosts against it reads them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vulnspark.functions.versions import key_dictionary
from vulnspark.operators import matching
from vulnspark.sources.buckets import KeyedTable
from vulnspark.sources.state import StateStore

KEY = ["family", "text"]


def known_keys(store: StateStore, texts: DataFrame, run: str) -> DataFrame:
    """The dictionary with all of these texts in it."""
    table = KeyedTable(store, "version_keys")
    if table.manifest() is not None:
        texts = texts.join(table.read().select(*KEY), KEY, "left_anti")
    changes = store.changes("version_keys", KEY, run)
    changes.upsert(key_dictionary(texts))
    table.commit(changes.newest(), KEY)
    store._remove(changes.folder)
    return table.read()


def load_feed(store: StateStore, tables: dict[str, DataFrame], now: int, required: tuple[str, ...] = ("advisories", "ranges")) -> dict[str, int]:
    """A new feed generation together with its claims, keys in place."""
    keys = known_keys(store, matching.bound_texts(tables["ranges"]), f"feed-{now}")
    claims = matching.claims_table(tables["ranges"], tables["notaffected"], keys)
    return store.load_feed({**tables, "claims": claims}, now, required)


def match(store: StateStore, inventory: DataFrame, run: str) -> DataFrame:
    """Findings of an inventory against the live generation, without working out a key that was met before."""
    feed = {n: store.read_feed(n).drop("gen") for n in ("ranges", "notaffected", "advisories")}
    if not store.has_feed("claims"):
        return matching.match(inventory, feed["ranges"], feed["notaffected"], feed["advisories"])
    keys = known_keys(store, matching.installed_texts(inventory), run)
    return matching.match(inventory, feed["ranges"], feed["notaffected"], feed["advisories"], claims=store.read_feed("claims").drop("gen"), dictionary=keys)
