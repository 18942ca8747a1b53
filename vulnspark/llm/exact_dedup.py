"""Exact dedup by skew-safe combining, in DataFrame operations only.

Copies are combined in three stages, each grouping by digest and by the full
text, so two texts that share a digest are never taken for equal:

1. locally: each task keeps one partial row for every text it reads;
2. by digest, text and a salt that is the reading task's number modulo
   ``salts``, so a text found by every task is merged by many tasks;
3. by digest and text, over at most ``salts`` rows for each text.

A group's size is therefore never the size of anything one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored, text_or_empty

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(docs: DataFrame, salts: int = SALTS, digest=sha256, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each different text: ``_digest``, ``_text``, ``keep_id`` (largest id), ``group_size`` and ``carry``.

    A null text counts as empty, a null id is below every other. ``carry`` maps a column name to its
    maximum over the group.
    """
    carry = {"keep_id": F.col("doc_id"), **(carry or {})}
    rows = docs.select(text_or_empty().alias("_text"), *[c.alias(name) for name, c in carry.items()])
    rows = rows.withColumns({"_digest": digest(F.col("_text")), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    best = [F.max(name).alias(name) for name in carry]
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.count(F.lit(1)).alias("group_size"), *best)
    return salted.groupBy("_digest", "_text").agg(F.sum("group_size").alias("group_size"), *best)


def verdicts(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents find their group by digest. Documents whose digest stands for more than one text are joined
    on the full text instead; with SHA-256 there are none. Rows repeated with id and text share one
    verdict; an empty table gives an empty table.
    """
    by_digest = stored(combine(docs, salts, digest).groupBy("_digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")), "digests")
    shared = by_digest.filter("_texts > 1").select("_digest")
    text = text_or_empty()
    rows = docs.select("doc_id", digest(text).alias("_digest"), F.sha2(text, 256).alias("text_sha256"))
    both = rows.join(by_digest.filter("_texts = 1"), "_digest")
    if not shared.isEmpty():
        members = combine(docs, salts, digest).join(shared, "_digest", "left_semi")
        rows = docs.select("doc_id", text.alias("_text"), digest(text).alias("_digest"), F.sha2(text, 256).alias("text_sha256"))
        settled = rows.join(shared, "_digest", "left_semi").join(members, ["_digest", "_text"])
        both = both.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(
            settled.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """The documents that stay, with every column: of equal texts the row with the largest doc_id.

    Of rows that repeat the id as well, the one with the largest other values stays, so reruns agree.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("doc_id"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.col("text").isNotNull().alias("_has"))
    kept = combine(docs, salts, digest, {"_row": row})
    return kept.select(*[F.col("_row.doc_id") if c == "doc_id"
                         else F.when(F.col("_row._has"), F.col("_text")).alias("text") if c == "text"
                         else F.col(f"_row._{others.index(c)}").alias(c) for c in docs.columns])
