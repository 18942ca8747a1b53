"""Inventory scans from newline-delimited JSON and whole-document JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.schemas import COMPONENT, INVENTORY_RECORD

META_TYPES = ("heartbeat", "exposure", "container", "link", "config")


def _normalised(df: DataFrame) -> DataFrame:
    """Epoch seconds for the scan time, and the attributes the operators read as columns."""
    def attribute(name: str) -> Column:
        return F.try_element_at("attributes", F.lit(name))

    return df.withColumns({
        "scanned_at": F.unix_timestamp(F.try_to_timestamp("scanned_at")).cast("bigint"),
        "role_sent": attribute("role"), "role_evidence_sent": attribute("role_evidence"),
        "file_description": attribute("file_description"), "original_filename": attribute("original_filename"),
        "kb": attribute("kb"), "servicing_stream": attribute("servicing_stream")}).drop("attributes")


def _record_schema(version_field: str) -> str:
    return INVENTORY_RECORD.replace("collector_version", version_field)


def read_inventory(spark: SparkSession, path: str, version_field: str = "collector_version") -> DataFrame:
    """Every record of NDJSON scans; malformed lines keep their text in ``_corrupt``.

    ``version_field`` is the name a collector gives its own version in a heartbeat.
    """
    raw = spark.read.schema(_record_schema(version_field)).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _normalised(raw.withColumnRenamed(version_field, "collector_version"))


def stream_inventory(spark: SparkSession, folder: str, max_files: int = 1000,
                     version_field: str = "collector_version") -> DataFrame:
    """The same records as a stream of new files; the checkpoint takes each file once.

    The ``-latest.ndjson`` copies of a scan are left out.
    """
    raw = (spark.readStream.schema(_record_schema(version_field)).option("columnNameOfCorruptRecord", "_corrupt")
           .option("pathGlobFilter", "*.ndjson").option("maxFilesPerTrigger", max_files).json(folder))
    kept = raw.filter(~F.col("_metadata.file_name").endswith("-latest.ndjson"))
    return _normalised(kept.withColumnRenamed(version_field, "collector_version"))


def record_schema(spark: SparkSession):
    """The schema of parsed records."""
    return _normalised(spark.createDataFrame([], INVENTORY_RECORD)).drop("_corrupt").schema


def split_records(df: DataFrame) -> dict[str, DataFrame]:
    """Records by kind: components carry no record type."""
    out = {"component": df.filter(F.col("record_type").isNull() & F.col("_corrupt").isNull())}
    out.update({t: df.filter(F.col("record_type") == t) for t in META_TYPES})
    return out


def read_scan_document(spark: SparkSession, path: str) -> DataFrame:
    """Components of ``{host, components[]}`` documents with the host's identity on each."""
    fields = COMPONENT.replace("hostname string, ", "")
    schema = (f"host struct<hostname:string,os_id:string,os_version_id:string,scanned_at:string>, "
              f"components array<struct<{_struct_body(fields)}>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = docs.select("host", F.explode("components").alias("c"))
    names = [f.split(":")[0] for f in _struct_fields(fields)]
    inherited = {"os_id", "os_version_id"}
    return rows.select(
        F.col("host.hostname").alias("hostname"),
        F.unix_timestamp(F.try_to_timestamp("host.scanned_at")).alias("scanned_at"),
        *[F.coalesce(f"c.{n}", f"host.{n}").alias(n) if n in inherited else F.col(f"c.{n}").alias(n) for n in names])


def _struct_fields(ddl: str) -> list[str]:
    return [":".join(f.strip().split(" ", 1)) for f in ddl.split(", ")]


def _struct_body(ddl: str) -> str:
    return ",".join(_struct_fields(ddl))
