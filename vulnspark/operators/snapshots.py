"""Newest value of every field per key, in a form that batches can be merged into.

A field is kept with the time it was seen, so merging two parts is a maximum
and one partial aggregate does it, in whatever order batches arrive and
however often one is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts(rows: DataFrame, keys: list[str], fields: list[str], ts: str = "scanned_at") -> DataFrame:
    """Per key: each field as its newest non-null value with its time, and the newest time of all."""
    def newest(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))))

    return rows.groupBy(*keys).agg(*[newest(c).alias(c) for c in fields], F.max(ts).alias(ts))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of two parts as one."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def read_facts(df: DataFrame, fields: list[str], since: int | None = None) -> DataFrame:
    """Plain values; one seen last before ``since`` reads as null."""
    def value(c: str) -> Column:
        return F.col(c)["v"] if since is None else F.when(F.col(c)["t"] >= since, F.col(c)["v"])

    return df.withColumns({c: value(c).alias(c) for c in fields})
