"""State, event and feed tables as Parquet folders.

A state table that is made anew by every run is a series of complete
versions, and the newest folder with a ``_SUCCESS`` marker is the table; a
lost job leaves an unmarked folder that no reader sees. A version goes only
when the one after it has been complete for longer than READER_GRACE, so a
running reader keeps its files. A state table that is changed by key is kept
in buckets (:mod:`vulnspark.sources.buckets`) from its first change on.
Event tables are partitioned by day and batch, and a batch written again
replaces itself. Feed tables are partitioned by generation, so reading the
live generation prunes the rest.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vulnspark.operators.generic import count_requests
from vulnspark.params import DAY
from vulnspark.sources.buckets import READER_GRACE, Changes, KeyedTable


class StateStore:
    """Versioned state tables and append-only event tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # File system calls go through Hadoop, so any shared store works.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _children(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _remove(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        found = [int(c[2:]) for c in self._children(f"{self.root}/{name}") if re.fullmatch(r"v=\d+", c)]
        return sorted(v for v in found if self._exists(f"{self.root}/{name}/v={v:012d}/_SUCCESS"))

    def read_state(self, name: str, schema: str | None = None, predicate: Column | str | None = None) -> DataFrame:
        """The current table; an absent one is empty with the given schema. The predicate reaches the scan."""
        keyed = KeyedTable(self, name).manifest()
        if keyed is not None:
            df = KeyedTable(self, name).read(keyed)
            return df if predicate is None else df.filter(predicate)
        versions = self.versions(name)
        if not versions:
            if schema is None:
                raise FileNotFoundError(f"no state table {name}")
            return empty(self.spark, schema)
        df = self.spark.read.parquet(f"{self.root}/{name}/v={versions[-1]:012d}")
        return df if predicate is None else df.filter(predicate)

    def _completed(self, name: str, version: int) -> int:
        """When a version was complete, in the file system's milliseconds."""
        fs, target = self._fs(f"{self.root}/{name}/v={version:012d}/_SUCCESS")
        return fs.getFileStatus(target).getModificationTime()

    def replace_state(self, df: DataFrame, name: str, grace: int = READER_GRACE, partition_by: list[str] = ()) -> int:
        """Write a new complete version and drop those superseded for longer than ``grace`` seconds."""
        keyed = KeyedTable(self, name).manifest()
        if keyed is not None:
            return KeyedTable(self, name).replace(df, keyed.keys, grace).version
        number = max(self.versions(name), default=0) + 1
        path = f"{self.root}/{name}/v={number:012d}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        written = self._completed(name, number)
        versions = self.versions(name)
        for old, after in zip(versions, versions[1:], strict=False):
            if written - self._completed(name, after) > grace * 1000:
                self._remove(f"{self.root}/{name}/v={old:012d}")
        return number

    def changes(self, name: str, keys: list[str], run: str, schema: str | None = None) -> Changes:
        """A run's changes to a table, to be gathered and committed together."""
        return Changes(self, name, keys, run, schema)

    def commit_changes(self, changes: DataFrame, name: str, keys: list[str], grace: int = READER_GRACE) -> int:
        table = KeyedTable(self, name)
        if table.manifest() is None and self.versions(name):
            table.replace(self.read_state(name), keys, grace)
        return table.commit(changes, keys, grace).version

    def upsert_state(self, new: DataFrame, name: str, keys: list[str]) -> int:
        """Whole rows put in place by key, in one commit."""
        changes = self.changes(name, keys, "upsert")
        changes.upsert(new)
        return changes.commit()

    def delete_state(self, requests: DataFrame, name: str, key: str) -> DataFrame:
        """Delete rows by key in one commit; how many were requested, deleted and skipped."""
        changes = self.changes(name, [key], "delete")
        counted = count_requests(self.read_state(name), requests, key)
        changes.delete(requests.filter(F.col(key).isNotNull() & (F.col(key) != "")))
        changes.commit()
        return counted

    def append_events(self, df: DataFrame, name: str, batch: str, day: str = "day") -> None:
        """Add a batch of events; the same batch written again takes its own place."""
        rows = df.withColumn("batch", F.lit(batch))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch")
         .parquet(f"{self.root}/events/{name}"))

    def read_events(self, name: str, schema=None, since: str | None = None, day: str = "day") -> DataFrame:
        """Events of a table, from the day ``since`` on; one without events is empty with the given schema."""
        path = f"{self.root}/events/{name}"
        if not any(c.startswith(f"{day}=") for c in self._children(path)):
            if schema is None:
                raise FileNotFoundError(f"no events {name}")
            return empty(self.spark, schema).withColumns({day: F.lit(""), "batch": F.lit("")})
        df = self.spark.read.option("basePath", path).parquet(path).withColumn(day, F.col(day).cast("string"))
        return df if since is None else df.filter(F.col(day) >= since)

    def expire_partitions(self, name: str, days: int, now: int, day: str = "day") -> list[str]:
        """Drop the day partitions of an event table that are older than its retention."""
        import datetime

        limit = datetime.datetime.fromtimestamp(now - days * DAY, datetime.timezone.utc).strftime("%Y-%m-%d")
        base = f"{self.root}/events/{name}"
        old = [c for c in self._children(base) if c.startswith(f"{day}=") and c.split("=", 1)[1] < limit]
        for c in old:
            self._remove(f"{base}/{c}")
        return sorted(old)

    # --- feed generations ---------------------------------------------------

    def live_generation(self) -> int | None:
        if not self.versions("feedstate"):
            return None
        row = self.read_state("feedstate").first()
        return None if row is None else row["generation"]

    def read_feed(self, name: str) -> DataFrame:
        """A feed table at the live generation."""
        return self.spark.read.parquet(f"{self.root}/feed/{name}").filter(F.col("gen") == self.live_generation())

    def has_feed(self, name: str) -> bool:
        """Whether the live generation has a table."""
        return self._exists(f"{self.root}/feed/{name}/gen={self.live_generation()}")

    def load_feed(self, tables: dict[str, DataFrame], now: int, required: tuple[str, ...] = ("advisories", "ranges")) -> dict[str, int]:
        """Write a new generation, refuse an empty required table, flip to it, sweep the old ones."""
        live = self.live_generation() or 0
        gen = live + 1
        counts = {}
        for name, df in tables.items():
            path = f"{self.root}/feed/{name}/gen={gen}"
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
            counts[name] = seen.get["n"]
        empty_tables = [n for n in required if not counts.get(n)]
        if empty_tables:
            for name in tables:
                self._remove(f"{self.root}/feed/{name}/gen={gen}")
            raise ValueError(f"refusing a feed with empty {empty_tables}; generation {live} stays live")
        state = self.spark.createDataFrame(
            [(gen, now, counts.get("advisories", 0), counts.get("ranges", 0))],
            "generation int, imported_at bigint, advisory_count bigint, range_count bigint")
        self.replace_state(state, "feedstate")
        for name in tables:
            for child in self._children(f"{self.root}/feed/{name}"):
                # The generation before stays for readers that began under it.
                if re.fullmatch(r"gen=\d+", child) and int(child[4:]) < live:
                    self._remove(f"{self.root}/feed/{name}/{child}")
        return counts


def scratch_store(spark: SparkSession, name: str) -> StateStore:
    """A store of its own in the folder all executors share; a temporary one only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vulnspark-")
    return StateStore(spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own in the shared folder: made once, and their plan ends there."""
    path = f"{scratch_store(df.sparkSession, name).root}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def feed_summary(ranges: DataFrame) -> DataFrame:
    """Distinct packages and ranges per generation and ecosystem."""
    keys = [c for c in ("gen", "ecosystem") if c in ranges.columns]
    return ranges.groupBy(*keys).agg(F.count_distinct("package").alias("feed_packages"), F.count(F.lit(1)).alias("feed_ranges"))


def backfill_summary(summary: DataFrame, ranges: DataFrame) -> DataFrame:
    """The stored summary, computed from the ranges only when there is none."""
    return feed_summary(ranges) if summary.isEmpty() else summary


def feed_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per member and whether it is missing."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("member", F.lit(n)) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("warning", F.when(F.col("rows") == 0, F.concat(F.lit("no rows in "), "member")))
