"""Helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator that counts words: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share; a temporary one only in a local session without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = getattr(spark, "_llm_scratch", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = spark._llm_scratch = tempfile.mkdtemp(prefix="llm-shared-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows as a written table in the shared folder: evaluated once, and not lost with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() parts at exactly the ASCII white space that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``size`` bytes of text."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
