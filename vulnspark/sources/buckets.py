"""Keyed state tables in buckets.

A table is cut into buckets by a hash of its key. A version is a manifest
that names the files of every bucket; a commit rewrites the buckets that its
changes touch and takes the other files over, so an hour costs what it
changed and not the size of the table. The manifest is renamed into place
last: a commit that did not finish is never read, and repeating it takes its
place. A reader keeps the files of the manifest it began with for as long as
READER_GRACE after that one was superseded.

:class:`Changes` gathers what the steps of a run do to a table. Each step
sees the changes before it, and all of them are one commit.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How long a superseded version stays readable, in seconds.
READER_GRACE = 6 * 3600
#: Rows a bucket should hold; a table doubles its buckets when they hold twice as many.
ROWS_PER_BUCKET = 250_000


@dataclass
class Manifest:
    version: int
    keys: list[str]
    by: list[str]
    buckets: int
    schema: dict
    files: dict[int, list[str]] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(self.schema)


def _nullable(node):
    """A schema's JSON with nulls allowed everywhere, as files are read."""
    if isinstance(node, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v) for k, v in node.items()}
    return [_nullable(v) for v in node] if isinstance(node, list) else node


class KeyedTable:
    """One table under ``<root>/<name>``; a single writer, any number of readers."""

    def __init__(self, store, name: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.store, self.spark, self.path, self.target = store, store.spark, f"{store.root}/{name}", rows_per_bucket

    # --- versions -----------------------------------------------------------

    def versions(self) -> list[int]:
        found = [re.fullmatch(r"v=(\d+)\.json", c) for c in self.store._children(f"{self.path}/manifest")]
        return sorted(int(m[1]) for m in found if m)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest/v={version:012d}.json"

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or the one of a version."""
        if version is None:
            versions = self.versions()
            if not versions:
                return None
            version = versions[-1]
        fs, target = self.store._fs(self._manifest_path(version))
        stream = fs.open(target)
        try:
            raw = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        by_bucket = {k: {int(b): v for b, v in raw[k].items()} for k in ("files", "rows")}
        return Manifest(version, raw["keys"], raw["by"], raw["buckets"], raw["schema"], **by_bucket, note=raw["note"])

    def _publish(self, m: Manifest) -> None:
        fs, waiting = self.store._fs(f"{self._manifest_path(m.version)}.waiting")
        out = fs.create(waiting, True)
        out.write(bytearray(json.dumps({c: getattr(m, c) for c in ("keys", "by", "buckets", "schema", "files", "rows", "note")}).encode()))
        out.close()
        fs.rename(waiting, self.store._fs(self._manifest_path(m.version))[1])

    # --- reading ------------------------------------------------------------

    def read(self, m: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it, as the manifest names it."""
        m = m or self.manifest()
        if m is None:
            raise FileNotFoundError(f"no keyed table {self.path}")
        files = [f"{self.path}/{f}" for b, names in sorted(m.files.items()) if buckets is None or b in buckets for f in names]
        if not files:
            return self.spark.createDataFrame([], m.struct)
        return self.spark.read.schema(m.struct).parquet(*files).select(*m.struct.names)

    # --- writing ------------------------------------------------------------

    def difference(self, old: Manifest | None, new: Manifest) -> tuple[DataFrame, DataFrame]:
        """Rows before and after, of the buckets whose files differ between two versions."""
        if old is None or (old.buckets, old.by) != (new.buckets, new.by):
            return self.read(old) if old else self.spark.createDataFrame([], new.struct), self.read(new)
        changed = [b for b in {*old.files, *new.files} if old.files.get(b) != new.files.get(b)]
        return self.read(old, changed), self.read(new, changed)

    def touched(self, rows: DataFrame, m: Manifest) -> list[int]:
        """The buckets that the rows belong to."""
        found = rows.select(self.bucket(m.by, m.buckets).alias("b")).groupBy("b").count()
        return sorted(r["b"] for r in found.collect())

    def bucket(self, by: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")

    def _buckets_for(self, rows: int) -> int:
        return 1 << max(0, -(-rows // self.target) - 1).bit_length()

    def _write(self, rows: DataFrame, m: Manifest, grace: int) -> Manifest:
        """Files of the given rows under a new version; ``m`` brings what stays as it is."""
        folder = f"data/c={m.version:012d}"
        dealt = rows.withColumn("_bucket", self.bucket(m.by, m.buckets)).repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        for child in self.store._children(f"{self.path}/{folder}"):
            if child.startswith("_bucket="):
                names = [f for f in self.store._children(f"{self.path}/{folder}/{child}") if f.endswith(".parquet")]
                m.files[int(child[8:])] = [f"{folder}/{child}/{f}" for f in sorted(names)]
        if any(f.startswith(folder) for names in m.files.values() for f in names):
            written = self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
            m.rows.update({r["_bucket"]: r["count"] for r in written.groupBy("_bucket").count().collect()})
        self._publish(m)
        self.sweep(grace)
        return m

    def replace(self, rows: DataFrame, keys: list[str], grace: int = READER_GRACE, by: list[str] | None = None, note: dict | None = None) -> Manifest:
        """A version with these rows and no others; ``by`` are the key columns that choose the bucket, all if not given."""
        before = self.manifest()
        buckets = max(self._buckets_for(rows.count()), before.buckets if before else 1)
        by = by or (before.by if before else keys)
        return self._write(rows, Manifest(before.version + 1 if before else 1, keys, by, buckets, _nullable(rows.schema.jsonValue()), note=note or {}), grace)

    def commit(self, changes: DataFrame, keys: list[str], grace: int = READER_GRACE, by: list[str] | None = None, note: dict | None = None) -> Manifest:
        """A version with whole rows put in place by key, and those with ``_gone`` taken out.

        ``changes`` has one row for each key and should be a written table. Columns a new row lacks become null.
        ``note`` is kept with the version.
        """
        before = self.manifest()
        fresh = changes.filter("NOT _gone").drop("_gone")
        if before is None:
            return self.replace(fresh, keys, grace, by, note)
        if before.keys != keys:
            raise ValueError(f"{self.path} is kept by {before.keys}, not by {keys}")
        rewritten, buckets, changed = self._rewritten(before, changes)
        if rewritten is None:
            if note is None or note == before.note:
                return before
            m = Manifest(before.version + 1, keys, before.by, buckets, before.schema, before.files, before.rows, note)
            self._publish(m)
            return m
        kinds = {f.name: f.dataType for f in before.struct}
        typed = fresh.select(*[F.col(c) if c not in kinds or kind == kinds[c].simpleString() else F.col(c).cast(kinds[c]).alias(c) for c, kind in fresh.dtypes])
        old = self.read(before, rewritten)
        # Whole rows that stay are looked for only where the keys, which are much less to move, do not show that there are none.
        stays = old.select(*keys).join(changes.select(*keys), keys, "left_anti")
        none = changed >= sum(before.rows.get(b, 0) for b in rewritten) and stays.isEmpty()
        kept = self.spark.createDataFrame([], before.struct) if none else old.join(changes.select(*keys), keys, "left_anti")
        rows = kept.unionByName(typed, allowMissingColumns=True)
        return self._write(rows, self._after(before, rows, rewritten, buckets, note), grace)

    def merge(self, new: DataFrame, keys: list[str], combine, grace: int = READER_GRACE, by: list[str] | None = None) -> Manifest:
        """A version whose buckets that ``new`` belongs to hold ``combine(old, new)``, whole rows with one for each key.

        ``new`` has one row for each key and should be a written table. Unlike a commit, nothing is matched first.
        """
        before = self.manifest()
        if before is None:
            return self.replace(new, keys, grace, by)
        if before.keys != keys:
            raise ValueError(f"{self.path} is kept by {before.keys}, not by {keys}")
        rewritten, buckets, _ = self._rewritten(before, new)
        if rewritten is None:
            return before
        rows = combine(self.read(before, rewritten), new)
        return self._write(rows, self._after(before, rows, rewritten, buckets, None), grace)

    def _rewritten(self, before: Manifest, changes: DataFrame) -> tuple[list[int] | None, int, int]:
        """The buckets to write anew, none without changes, how many the table then has, and the rows of the changes."""
        touched = changes.select(self.bucket(before.by, before.buckets).alias("b")).groupBy("b").count().collect()
        changed = sum(r["count"] for r in touched)
        size, buckets = sum(before.rows.values()) + changed, before.buckets
        while size > 2 * self.target * buckets:
            buckets *= 2
        if not touched and buckets == before.buckets:
            return None, buckets, changed
        return (sorted(before.files) if buckets > before.buckets else sorted(r["b"] for r in touched)), buckets, changed

    def _after(self, before: Manifest, rows: DataFrame, rewritten: list[int], buckets: int, note: dict | None) -> Manifest:
        """The manifest of the next version, with the files that stay."""
        stays = {} if buckets > before.buckets else {b: f for b, f in before.files.items() if b not in rewritten}
        return Manifest(before.version + 1, before.keys, before.by, buckets, _nullable(rows.schema.jsonValue()), stays,
                        {b: n for b, n in before.rows.items() if b in stays}, note or {})

    def sweep(self, grace: int = READER_GRACE) -> list[str]:
        """Drop manifests superseded for longer than ``grace`` seconds, and the files that none left names."""
        def written(version: int) -> int:
            fs, target = self.store._fs(self._manifest_path(version))
            return fs.getFileStatus(target).getModificationTime()

        versions = self.versions()
        now = written(versions[-1])
        old = [v for v, after in zip(versions, versions[1:], strict=False) if now - written(after) > grace * 1000]
        for v in old:
            self.store._remove(self._manifest_path(v))
        if not old:
            return []
        named = {f for v in versions if v not in old for names in self.manifest(v).files.values() for f in names}
        gone = []
        for commit in self.store._children(f"{self.path}/data"):
            if int(commit[2:]) > versions[-1]:
                continue
            for child in self.store._children(f"{self.path}/data/{commit}"):
                for f in self.store._children(f"{self.path}/data/{commit}/{child}") if child.startswith("_bucket=") else []:
                    name = f"data/{commit}/{child}/{f}"
                    if f.endswith(".parquet") and name not in named:
                        self.store._remove(f"{self.path}/{name}")
                        gone.append(name)
            if not any(f.startswith(f"data/{commit}/") for f in named):
                self.store._remove(f"{self.path}/data/{commit}")
        return gone


class Changes:
    """What one run does to a keyed table: each change is written once, later steps see it, and all are one commit."""

    def __init__(self, store, name: str, keys: list[str], run: str, schema: str | None = None):
        self.store, self.name, self.keys, self.run, self.schema = store, name, list(keys), run, schema
        self.folder, self.staged, self.written = f"{store.root}/{name}/staged/{run}", [], 0

    def _stage(self, rows: DataFrame) -> None:
        path = f"{self.folder}/{self.written:04d}"
        rows.write.mode("overwrite").parquet(path)
        self.staged.append(self.store.spark.read.schema(rows.schema).parquet(path))
        self.written += 1

    def upsert(self, rows: DataFrame) -> None:
        """Whole rows in place of those with their key; a key given twice keeps one."""
        self._stage(rows.withColumn("_gone", F.lit(False)))
        given = self.staged[-1]
        # Keys say whether any came twice, so whole rows are moved for those alone.
        twice = given.groupBy(*self.keys).count().filter("count > 1").select(*[F.col(k).alias(f"_twice_{i}") for i, k in enumerate(self.keys)])
        if not twice.isEmpty():
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_twice_{i}")) for i, k in enumerate(self.keys)])
            once = given.join(twice, same, "left_anti").unionByName(given.join(twice, same, "left_semi").dropDuplicates(self.keys))
            self._stage(once)
            self.staged.pop(-2)

    def delete(self, rows: DataFrame) -> None:
        """Rows with these keys go."""
        self._stage(rows.select(*self.keys).distinct().withColumn("_gone", F.lit(True)))

    def replace(self, rows: DataFrame) -> None:
        """These rows and no others."""
        self.upsert(rows)
        self.delete(self.rows().join(self.staged[-1].select(*self.keys), self.keys, "left_anti"))

    def newest(self) -> DataFrame | None:
        """The last change of every key; null if there is no change."""
        if len(self.staged) < 2:
            return self.staged[0] if self.staged else None
        each = [df.withColumn("_no", F.lit(i)) for i, df in enumerate(self.staged)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        rest = [c for c in every.columns if c not in self.keys and c != "_no"]
        if every.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            return every.select(*self.keys, *rest)
        return every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_no").alias("_r")).select(*self.keys, "_r.*")

    def before(self) -> DataFrame:
        """The table without the changes."""
        return self.store.read_state(self.name, self.schema)

    def rows(self) -> DataFrame:
        """The table with the changes so far."""
        newest, base = self.newest(), self.before()
        if newest is None:
            return base
        kept = base.join(newest.select(*self.keys), self.keys, "left_anti")
        return kept.unionByName(newest.filter("NOT _gone").drop("_gone"), allowMissingColumns=True)

    def commit(self) -> int | None:
        """Write the changes as one version; the number of it, or none without changes."""
        newest = self.newest()
        if newest is None:
            return None
        version = self.store.commit_changes(newest, self.name, self.keys)
        self.store._remove(self.folder)
        self.staged, self.written = [], 0
        return version
