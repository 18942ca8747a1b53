"""Relational building blocks the domain operators share.

Group-wise work is written as aggregate-then-join or as a ranked filter:
both pre-aggregate on the map side, so a key that holds a large share of
the rows never lands whole in one task. Joins back to the detail rows stay
plain equi-joins, where adaptive execution splits a skewed partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnspark.params import DAY


def cut_lineage(df: DataFrame) -> DataFrame:
    """A loop variable as a table of its own in the shared folder: made once, whatever reads it, and not lost with an executor."""
    from vulnspark.sources.state import written

    return written(df, "loop")


# --- aggregates -------------------------------------------------------------

def values(c: Column | str) -> Column:
    """Sorted distinct non-null values."""
    return F.array_sort(F.collect_set(c))


def values_text(c: Column | str, sep: str = ", ") -> Column:
    return F.array_join(values(c), sep)


def latest(c: Column | str, ts: Column | str) -> Column:
    """The newest non-null value; equal times keep the largest value."""
    c = F.col(c) if isinstance(c, str) else c
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.max_by(c, F.when(c.isNotNull(), F.struct(ts.alias("t"), c.alias("v"))))


def earliest(c: Column | str, ts: Column | str) -> Column:
    """The oldest non-null value; equal times keep the smallest value."""
    c = F.col(c) if isinstance(c, str) else c
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.min_by(c, F.when(c.isNotNull(), F.struct(ts.alias("t"), c.alias("v"))))


def count_when(cond: Column) -> Column:
    """Rows for which the condition is true, zero when there are none."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def distinct_when(cond: Column, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.count_distinct(F.when(cond, c))


def set_size(c: Column | str) -> Column:
    """Different non-null values of a group that bounds them (a host's ports): each row is kept once, however many such counts there are."""
    return F.size(F.collect_set(c)).cast("bigint")


# --- group shares -----------------------------------------------------------

def with_group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group aggregates on every row of the group."""
    shares = df.groupBy(*keys).agg(*aggs)
    renamed = shares.select(*[F.col(k).alias(f"_g_{k}") for k in keys],
                            *[c for c in shares.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, on, "inner").drop(*[f"_g_{k}" for k in keys])


def newest_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Every row of a key's newest time, ties kept."""
    return with_group(df, keys, F.max(ts).alias("_newest")).filter(
        F.col(ts) >= F.col("_newest")).drop("_newest")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def newest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict for each CVE: the newest, then the highest score, then the largest row, whatever the table repeats."""
    fields = [c for c in verdicts.columns if c != "cve_id"]
    order = [c for c in ("analysed_at", "priority_score") if c in fields]
    row = F.struct(*order, *[c for c in fields if c not in order])
    return verdicts.groupBy("cve_id").agg(F.max(row).alias("_row")).select("cve_id", *[F.col("_row")[c].alias(c) for c in fields])


def subtotal(df: DataFrame, keys: list[str], label: dict[str, str], *aggs: Column) -> DataFrame:
    """The rows plus one aggregate row per key, labelled."""
    total = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return df.unionByName(total.withColumns({k: F.lit(v) for k, v in label.items()}), allowMissingColumns=True)


def dimension_rows(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Single-dimension grouping sets as rows of ``dim`` and ``value``.

    Each row comes once for every dimension it has a value in, so the table
    is read a single time however many dimensions there are.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("value")) for n, c in dims.items()])
    long = df.withColumn("_p", F.explode(pairs)).select("*", "_p.dim", "_p.value").drop("_p")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != ""))


# --- joins ------------------------------------------------------------------

def lookup(df: DataFrame, table: DataFrame, on: dict[str, str] | list[str], outputs: dict[str, str] | list[str],
           how: str = "left") -> DataFrame:
    """Left join that adds renamed columns of a keyed table.

    ``on`` maps a column of ``df`` to a key column of ``table``; ``outputs``
    maps a table column to its new name. Null keys never match.
    """
    on = on if isinstance(on, dict) else {k: k for k in on}
    outputs = outputs if isinstance(outputs, dict) else {c: c for c in outputs}
    right = table.select(*[F.col(k).alias(f"__lk{i}") for i, k in enumerate(on.values())],
                         *[F.col(c).alias(f"__lo_{new}") for c, new in outputs.items()])
    cond = reduce(lambda a, b: a & b, [df[k] == right[f"__lk{i}"] for i, k in enumerate(on)])
    joined = df.join(right, cond, how)
    kept = [F.col(c) for c in df.columns if c not in outputs.values()]
    return joined.select(*kept, *[F.col(f"__lo_{n}").alias(n) for n in outputs.values()])


def lookup_fallback(df: DataFrame, table: DataFrame, keys: list[str], key: str, outputs: list[str]) -> DataFrame:
    """Try several key columns in order and keep the first value found per output."""
    out = df
    for i, k in enumerate(keys):
        out = lookup(out, table, {k: key}, {c: f"_f{i}_{c}" for c in outputs})
    return out.withColumns({
        c: F.coalesce(*[F.col(f"_f{i}_{c}") for i in range(len(keys))]) for c in outputs
    }).drop(*[f"_f{i}_{c}" for i in range(len(keys)) for c in outputs])


# --- state ------------------------------------------------------------------

def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row replace by key: columns the new row lacks become null."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def count_requests(state: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Of requested keys: how many there are, how many different ones the state has, how many are empty."""
    hits = state.select(key).distinct().withColumn("_hit", F.lit(1))
    return requests.select(F.col(key)).join(hits, key, "left").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_distinct(F.when(F.col("_hit") == 1, F.col(key))).alias("deleted"),
        count_when(F.col(key).isNull() | (F.col(key) == "")).alias("skipped"))


def delete_keys(state: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """State without the requested keys, and counts requested / deleted / skipped."""
    wanted = requests.select(F.col(key)).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return state.join(wanted.distinct(), key, "left_anti"), count_requests(state, requests, key)


def drop_retired(df: DataFrame, hoststate: DataFrame, now: int, retire_days: int, host: str = "hostname") -> DataFrame:
    """Leave out rows of hosts whose last scan is older than the retirement age."""
    retired = hoststate.filter(F.lit(now) - F.col("host_last_scan") > retire_days * DAY)
    return df.join(retired.select(F.col("hostname").alias(host)), host, "left_anti")


def carry_forward(new: DataFrame, old: DataFrame, ts: str, keys: list[str], hoststate: DataFrame,
                  now: int, retire_days: int, host: str = "hostname") -> DataFrame:
    """Per-host snapshot replace.

    A host that reported has its rows replaced; a silent host keeps its old
    ones until it retires. Equal times keep rows of both sides, the new row
    winning per key.
    """
    both = new.withColumn("_side", F.lit(0)).unionByName(
        old.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    kept = first_per_key(newest_rows(both, [host], ts), keys, F.col("_side"), F.col(ts).desc()).drop("_side")
    return drop_retired(kept, hoststate, now, retire_days, host)


def replace_reported(new: DataFrame, old: DataFrame, keys: list[str], hoststate: DataFrame,
                     now: int, retire_days: int, host: str = "hostname") -> DataFrame:
    """Carry-forward by presence instead of time: any new row replaces the host's old rows."""
    silent = old.join(new.select(host).distinct(), host, "left_anti")
    both = new.unionByName(silent, allowMissingColumns=True)
    return drop_retired(both.dropDuplicates(keys), hoststate, now, retire_days, host)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join for a side with known hot keys: its rows spread over salts, the other side repeats.

    Use only where the other side is much smaller than the big one; inner and
    left joins keep their exact result.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    repeated = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
