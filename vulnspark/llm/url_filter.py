"""URL filter: host and path rules first, then a blocked Bloom filter before an exact join.

The filter is a table of 256-bit blocks, eight 32-bit lanes each, and a key
sets one bit in every lane of its block. A page looks up one block, so the
probe is one equi-join on the block number. Only pages whose eight bits are
all set go on to the exact join with the listed URLs, which removes the
false positives.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
#: Query parameters that do not name another page.
TRACKING = ("ref",)
TRACKING_PREFIXES = ("utm_",)
#: A filter up to this size is broadcast; a larger one is joined by its block number.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for a URL without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)

    def counts(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        tracked = reduce(lambda a, b: a | b, [name == t for t in TRACKING] + [name.startswith(t) for t in TRACKING_PREFIXES])
        return (p != "") & ~tracked

    left = F.array_join(F.array_sort(F.filter(F.split(query, "&"), counts)), "&")
    return F.concat(host, path, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict, else null. ``rules``: (verdict, host, path), a short list."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    values = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in order]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(f, v) for f, v in zip(fits, values, strict=True)], none)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(31)).cast("int"))
            for i in range(LANES)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column ``url_key``: one row for each block that has a bit set."""
    key = F.col("url_key")
    rows = listed.select(_block(key, blocks).alias("block"), *[m.alias(f"lane{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], bits_per_key: int = 16,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verdict for each page: page_id, host, path, rule, verdict, passed_filter, listed.

    ``listed`` has block-listed URLs in the column ``url``. A page no rule fits is blocked if its canonical
    URL is listed, else allowed. A null URL has an empty host and path, is in no list and is allowed; an
    empty list allows all; repeated pages are each judged; other columns are left out.
    """
    keys = listed.filter(F.col("url").isNotNull()).select(canonical(F.col("url")).alias("url_key")).distinct()
    blocks = max(1, ceil(keys.count() * bits_per_key / (32 * LANES)))
    filter_ = bloom(keys, blocks)
    if blocks * ROW_BYTES <= broadcast_bytes:
        filter_ = F.broadcast(filter_)
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        F.when(url.isNotNull(), canonical(url)).alias("url_key"))
    seen = seen.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "block": _block(F.col("url_key"), blocks)})
    probed = seen.join(filter_, "block", "left")
    every = reduce(lambda a, b: a & b, [F.col(f"lane{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("url_key")))])
    probed = probed.withColumn("passed_filter", F.coalesce(every & F.col("url_key").isNotNull(), F.lit(False)))
    passed = probed.filter("passed_filter").join(keys.withColumn("listed", F.lit(True)), "url_key", "left")
    both = passed.unionByName(probed.filter("NOT passed_filter").withColumn("listed", F.lit(False)))
    on_list = F.coalesce("listed", F.lit(False))
    return both.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce(F.col("_rule.verdict"), F.when(on_list, "block").otherwise("allow")).alias("verdict"),
                       "passed_filter", on_list.alias("listed"))
