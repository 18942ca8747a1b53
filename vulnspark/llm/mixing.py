"""Mixing sources by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, a piecewise
linear curve. Its integral is the source's overall weight, from which word
targets follow; the curve itself says when those words are due. A document
(or a repeat of it) starts at some word of its source's stream; inverting
the source's cumulative demand at the middle of the document gives its
training position. Sorting by position by ranges gives the training order.

The stream offset is a running sum over a source in a fixed random order. It
is taken in two levels, over hash buckets and within a bucket, so a source
that holds a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnspark.llm.common import WORD, stored, text_or_empty

#: A source repeats at most so often.
MAX_REPEATS = 3
#: Hex digits of the order key that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3
#: Schedules of the sources in order, repeating: knots (time, relative weight). Times rise from 0 to 1.
FALLING, LEVEL, RISING = [(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)]
CURVES = (FALLING, LEVEL, RISING)
WEIGHTS = (1, 2, 3)


def area(knots: list[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def check(knots: list[tuple[float, float]]) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("a schedule's times must rise from 0 to 1")
    if any(w < 0 for _, w in knots) or area(knots) <= 0:
        raise ValueError("a schedule's weights must be 0 or more, and not all 0")


def position(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which a fraction ``share`` of the area under the schedule has passed."""
    check(knots)
    total, passed, pieces = area(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        piece = (t1 - t0) * (w0 + w1) / 2
        if piece > 0:
            rest = F.least(F.greatest(share * F.lit(total) - F.lit(passed), F.lit(0.0)), F.lit(piece))
            slope = (w1 - w0) / (t1 - t0)
            # Solves w0*x + slope*x*x/2 = rest without cancellation.
            x = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))))
            pieces.append((F.lit(passed + piece), F.lit(t0) + F.when(rest > 0, x).otherwise(F.lit(0.0))))
        passed += piece
    out = pieces[-1][1]
    for until, at in reversed(pieces[:-1]):
        out = F.when(share * F.lit(total) <= until, at).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source, source_size, source_no, weight and target words, from one row for each source with its size.

    Sources are numbered by code point, null last. The targets share the total by weight; one above its cap of
    ``repeats`` times the size stops there and the excess goes to the others by weight. In rising order of
    cap over weight, a source is at its cap if handing out what the capped ones before it leave would lift
    it that far, so the final targets need one pass.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(order) - 1
    rows = sizes.withColumn("source_no", number)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("source_no") % len(weights) + 1))
    rows = rows.withColumn("_cap", F.col("source_size") * repeats)
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "source_no")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    rows = rows.withColumns({"_total": F.sum("source_size").over(all_), "_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
                             "_weights": F.sum("weight").over(rest)})
    rows = rows.withColumn("_full", F.col("_cap") * F.col("_weights") <= (F.col("_total") - F.col("_before")) * F.col("weight"))
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_), F.lit(0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(all_)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * left / open_)
    return rows.withColumn("target", target).select("source", "source_size", "source_no", "weight", "target")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, curves=CURVES, repeats: int = MAX_REPEATS) -> DataFrame:
    """Every document with size, source_size, source_no, target and ``positions``, the training times of the copies taken.

    ``docs`` has doc_id, source, size and any further columns, which are kept. A source's order is the MD5 of
    the document id, ties by id and then size, so reruns agree. Repeat number k of a document is taken if the
    middle of it lies before the target, which keeps the taken words within half a document of the target. A
    document without words is never taken.
    """
    docs = docs.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumns({"_bucket": F.substring("_key", 1, BUCKET_DIGITS), "_no_source": F.col("source").isNull(),
                             "_source": F.coalesce("source", F.lit(""))})
    keys = ["_no_source", "_source"]
    buckets = docs.groupBy(*keys, "_bucket").agg(F.sum("size").alias("_in_bucket"))
    sources = buckets.groupBy(*keys).agg(F.sum("_in_bucket").alias("source_size"))
    sources = targets(sources.select(F.when(~F.col("_no_source"), F.col("_source")).alias("source"), "source_size"), weights, repeats)
    sources = sources.withColumns({"_no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}).drop("source", "weight")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0))).drop("_in_bucket")
    starts = starts.join(sources, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*keys, "_bucket"])
    rows = rows.withColumn("_offset", F.col("_start") + F.col("_inside"))

    def time(k: int) -> Column:
        share = (F.col("_offset") + k * F.col("source_size") + F.col("size") / 2) / F.col("target")
        at = position(share, curves[-1])
        for i in reversed(range(len(curves) - 1)):
            at = F.when(F.col("source_no") % len(curves) == i, position(share, curves[i])).otherwise(at)
        taken = (2 * (F.col("_offset") + k * F.col("source_size")) + F.col("size") <= 2 * F.col("target")) & (F.col("size") > 0)
        return F.when(taken, at)

    times = F.array_compact(F.array(*[time(k) for k in range(repeats)]))
    return rows.withColumn("positions", times).drop("_key", "_bucket", "_no_source", "_source", "_start", "_inside", "_offset")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, curves=CURVES, repeats: int = MAX_REPEATS) -> DataFrame:
    """The training set in training order: one row for each taken copy, all columns of ``docs``, ``copy`` and ``position``.

    Positions are in 0..1; rows are range-sorted by position, ties by source and id. A null text has no words
    and is not taken; an empty table gives an empty one. Names that ``plan`` uses do not clash with columns of
    ``docs``, which travel in a struct.
    """
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = plan(packed, weights, curves, repeats).select("doc_id", "source_no", "_doc", F.posexplode("positions").alias("copy", "position"))
    ordered = rows.repartitionByRange("position", "source_no", "doc_id").sortWithinPartitions("position", "source_no", "doc_id", "copy")
    taken = ["copy", "position"]
    return ordered.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], *[F.col(c) for c in taken if c not in docs.columns])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, counted once and written."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
