"""Permitted flows reduced to edges, and declared entry points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.functions.address import cidr_struct, is_v4_key, key_text
from vulnspark.functions.text import empty_to_null, stamp_text, try_long
from vulnspark.schemas import EDGE, ENTRY
from vulnspark.sources.state import empty


@dataclass(frozen=True)
class FlowMapping:
    """Column names of a flow log."""

    src: str = "src_ip"
    dest: str = "dest_ip"
    port: str = "dest_port"
    protocol: str = "transport"
    time: str = "time"
    action: str | None = "action"
    allowed: str = "allowed"
    sessions: str = "sessions"


def no_edges(spark: SparkSession) -> DataFrame:
    return empty(spark, EDGE)


def no_entry_points(spark: SparkSession) -> DataFrame:
    return empty(spark, ENTRY)


def _mapped(flows: DataFrame, m: FlowMapping) -> DataFrame:
    rows = flows.filter(F.col(m.action) == m.allowed) if m.action else flows
    return rows.withColumns({
        "src_ip": F.lower(m.src), "dest_ip": F.lower(m.dest), "port": try_long(F.col(m.port).cast("string")),
        "protocol": F.lower(F.coalesce(F.col(m.protocol), F.lit("tcp")))}).filter(
        F.col("src_ip").isNotNull() & F.col("dest_ip").isNotNull() & F.col("port").isNotNull())


EDGE_KEY = ("src_ip", "dest_ip", "port", "protocol")


def permitted_edges(flows: DataFrame, mapping: FlowMapping = FlowMapping()) -> DataFrame:
    """One edge per source, destination, port and protocol; a denied flow is no path."""
    rows = _mapped(flows, mapping)
    return rows.groupBy(*EDGE_KEY).agg(
        F.count(F.lit(1)).alias("sessions"), F.min(mapping.time).alias("edge_first_seen"), F.max(mapping.time).alias("edge_last_seen"))


def permitted_edges_from_summary(summary: DataFrame, mapping: FlowMapping = FlowMapping()) -> DataFrame:
    """The same from rows that already carry a session count and first and last times."""
    rows = _mapped(summary, mapping)
    return rows.groupBy(*EDGE_KEY).agg(
        F.sum(mapping.sessions).alias("sessions"), F.min("edge_first_seen").alias("edge_first_seen"),
        F.max("edge_last_seen").alias("edge_last_seen"))


def entry_points(rows: DataFrame) -> DataFrame:
    """Declared ``cidr | name | pressure`` lines as rows; the weaker pressure is the default.

    A bare address becomes one host and host bits are cleared. A line that
    names no network, or an unknown pressure, keeps its problem in words.
    """
    parts = F.split("line", r"\|")
    rows = rows.filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    rows = rows.select(
        "line", F.trim(F.get(parts, F.lit(0))).alias("raw"), empty_to_null(F.trim(F.get(parts, F.lit(1)))).alias("name"),
        F.lower(F.coalesce(empty_to_null(F.trim(F.get(parts, F.lit(2)))), F.lit("occasional"))).alias("pressure"))
    rows = rows.withColumn("_n", cidr_struct(F.col("raw")))
    bits = F.when(is_v4_key(F.col("_n.low")), F.col("_n.bits") - 96).otherwise(F.col("_n.bits"))
    return rows.select(
        F.concat(key_text(F.col("_n.low")), F.lit("/"), bits.cast("string")).alias("cidr"),
        F.coalesce("name", "raw").alias("name"), "pressure",
        F.when(F.col("_n").isNull(), "not an address or CIDR").when(
            ~F.col("pressure").isin("constant", "occasional"), "pressure must be constant or occasional").alias("problem"))


def edge_preview(edges: DataFrame, n: int = 100) -> DataFrame:
    """The busiest edges, to read before trusting a mapping."""
    return edges.orderBy(F.col("sessions").desc(), *EDGE_KEY).limit(n).select(
        *EDGE_KEY, "sessions", stamp_text(F.col("edge_first_seen")).alias("first_seen"),
        stamp_text(F.col("edge_last_seen")).alias("last_seen"))


def edge_test(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src_ip").alias("sources"),
                     F.count_distinct("dest_ip").alias("destinations"), F.max("edge_last_seen").alias("newest_edge"))
