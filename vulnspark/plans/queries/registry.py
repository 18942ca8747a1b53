"""Registration of queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vulnspark.plans.testbed import Bed, oracle_text

#: Hosts that are not retired: their last scan is younger than 180 days.
GONE = "hostname NOT IN (SELECT hostname FROM t_host WHERE 1005000000 - host_last_scan > 15552000)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(bed)`` under a name, with the SQL that must give the same rows."""
    def wrap(fn: Callable[[Bed], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Bed(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn
    return wrap
