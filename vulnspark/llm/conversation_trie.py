"""Prefix trie of conversations in double arrays.

Equal conversations are counted first. The rest are dealt to shards by a
prefix, as short a one as not more than a fair share of conversations have:
prefixes of 1, 2, 4, 8 ... turns are counted, and a crowded one is passed
over for the next. So each node at or below the chosen prefix is whole in
one shard, however many conversations begin alike.

A shard gives its turns dense ids and packs its trie in two arrays: the child
of state s by turn id c is BASE[s] + c, if CHECK there is s. Conversations
are then walked through the arrays, which counts the nodes. Upper nodes,
above the chosen prefixes, are met in many shards; their counts are added up
globally, and sums over subtrees climb the upper nodes in jumps of 1, 2, 4 ...
levels.

Only digests of turns travel, 128 bits and a length for each; the digests of
one conversation are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored, text_or_empty
from vulnspark.llm.hashing import mix

#: Turns a shard holds on average, at most.
SHARD_TURNS = 1 << 18
#: Shards for each shuffle partition, so that they even out.
SHARDS_EACH = 4
#: Conversation ids in one piece of a list that is hashed.
PIECE = 4096
#: Free places looked at for a node's children before they go to the end of the arrays.
TRIES = 24

TURNS = "array<struct<turn:long,a:long,b:long,bytes:int>>"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as digests: a null turn number is first, equal ones are in the digests' order.

    Null roles and texts count as empty; repeated rows are turns of their own; rows without conv_id belong to no conversation.
    """
    what = [text_or_empty("role"), text_or_empty("text")]
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), *what).alias("a"), F.xxhash64(F.lit(2), *what).alias("b"),
                    F.octet_length(what[1]).alias("bytes"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _digest(turns: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.transform(turns, lambda t: t["a"]), F.transform(turns, lambda t: t["b"]))


def _ends(keyed: DataFrame) -> DataFrame:
    """k1, k2, n, conv_id (the smallest) and ends_sha256 of the conversations with equal turns.

    Ids are sorted over all tasks and joined in pieces, so a task hashes few rows even where very many conversations are equal.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "conv_id"))
            if not len(ids):
                continue
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            cuts = np.union1d(cuts, np.arange(0, len(ids), PIECE))
            stops = np.append(cuts[1:], len(ids))
            joined = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(cuts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"k1": k1[cuts], "k2": k2[cuts], "conv_id": ids[cuts], "n": stops - cuts, "ids": joined})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def close():
            if now is not None:
                out.append((*now, sha.hexdigest()))

        def send():
            part = pa.RecordBatch.from_pydict({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(
                (("k1", pa.int64()), ("k2", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())))})
            out.clear()
            return part

        for batch in batches:
            for k1, k2, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id", "n", "ids")), strict=True):
                if now is not None and now[:2] == (k1, k2):
                    now = (k1, k2, now[2], now[3] + n)
                    sha.update(b"," + ids.encode())
                else:
                    close()
                    now, sha = (k1, k2, first, n), hashlib.sha256(ids.encode())
            yield send()
        close()
        yield send()

    sorted_ids = keyed.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    parts = sorted_ids.mapInArrow(pieces, "k1 long, k2 long, conv_id long, n long, ids string")
    parts = parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return parts.mapInArrow(hashed, "k1 long, k2 long, conv_id long, n long, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK over dense turn ids from 1; state 0 is the root, and -1 in CHECK is a free place."""

    def __init__(self, room: int):
        self.base = np.zeros(room, np.int64)
        self.check = np.full(room, -1, np.int64)
        self.check[0] = 0
        self.low = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, number: int) -> np.ndarray:
        """The first ``number`` free places."""
        while self.low < len(self.check) and self.check[self.low] >= 0:
            self.low += 1
        width = 2 * number + 64
        while True:
            places = np.flatnonzero(self.check[self.low : self.low + width] < 0)[:number] + self.low
            if len(places) == number:
                return places
            if self.low + width >= len(self.check):
                self._grow(self.low + 2 * width)
            width *= 2

    def add_level(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children of the states ``parents`` by the turns ``ids``; rows are distinct and sorted, each parent is complete."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(first, len(parents)))
        for at, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            parent, own = parents[at], ids[at : at + size]
            for place in self._free(TRIES):
                places = own + (place - own[0])
                self._grow(int(places[-1]) + 1)
                if (self.check[places] < 0).all():
                    break
            else:
                used = np.flatnonzero(self.check >= 0)[-1]
                places = own + (used + 1 - own[0])
                self._grow(int(places[-1]) + 1)
            self.base[parent] = places[0] - own[0]
            self.check[places] = parent
        alone = first[sizes == 1]
        if len(alone):
            places = self._free(len(alone))
            self.base[parents[alone]] = places - ids[alone]
            self.check[places] = parents[alone]

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states after a turn; -1 where there is no such child."""
        to = self.base[states] + ids
        there = (to > 0) & (to < len(self.check))
        return np.where(there & (self.check[np.where(there, to, 0)] == states), to, -1)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids from 1 for equal pairs."""
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(a)]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def pack(ids: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """Double arrays of the sequences ids[offsets[i]:offsets[i + 1]], level by level."""
    trie, lengths, states = DoubleArray(2 * len(ids) + 64), np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    width = int(ids.max(initial=0)) + 1
    for depth in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > depth)
        own = ids[offsets[on] + depth]
        edges = np.unique(states[on] * width + own)
        trie.add_level(edges // width, edges % width)
        states[on] = trie.step(states[on], own)
    return trie


NODE = ("n1 long, n2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved long, bytes long, upper boolean, ends_sha256 string")


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of a shard's trie; upper ones with what the shard knows of them."""
    turns = table.column("turns").combine_chunks()
    turns = turns if isinstance(turns, pa.Array) else pa.concat_arrays(turns.chunks)
    offsets = np.append(0, np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    flat = turns.flatten()
    a, b, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "bytes"))
    n, conv, top = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "conv_id", "top"))
    ids, lengths = _dense(a, b), np.diff(offsets)
    trie = pack(ids, offsets)
    room = len(trie.check)
    depth, least, count, nbytes = np.full(room, -1, np.int64), np.full(room, 2**63 - 1, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    key, upper, end = np.zeros((2, room), np.uint64), np.zeros(room, bool), np.full(room, -1, np.int64)
    states = np.zeros(len(n), np.int64)
    for d in range(int(lengths.max(initial=0)) + 1):
        on = np.flatnonzero(lengths >= d)
        if d:
            at = offsets[on] + d - 1
            before, states[on] = states[on], trie.step(states[on], ids[at])
            for i, value in enumerate((a, b)):
                key[i, states[on]] = mix(key[i, before] ^ mix(value[at].view(np.uint64), 2 * i + 1), 2 * i)
            nbytes[states[on]] = size[at]
        depth[states[on]] = d
        np.add.at(count, states[on], n[on])
        np.minimum.at(least, states[on], conv[on])
        upper[states[on]] = d < top[on]
        done = on[lengths[on] == d]
        end[states[done]] = done
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    children, leaves, saved = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    levels = np.searchsorted(depth[nodes], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), -1, -1):
        here = nodes[levels[d] : levels[d + 1]]
        here = here[~upper[here]]
        leaves[here] += children[here] == 0
        saved[here] += (count[here] - 1) * nbytes[here]
        if d:
            for total, part in ((children, 1), (leaves, leaves[here]), (saved, saved[here])):
                np.add.at(total, trie.check[here], part)
    parent = trie.check[nodes]
    root = depth[nodes] == 0
    shas = np.append(np.array(table.column("ends_sha256").to_pylist(), object), None)
    return pa.table({
        "n1": key[0, nodes].view(np.int64), "n2": key[1, nodes].view(np.int64), "p1": key[0, parent].view(np.int64), "p2": key[1, parent].view(np.int64),
        "depth": depth[nodes], "conv_id": least[nodes], "parent_conv_id": pa.array(least[parent], pa.int64(), mask=root | upper[parent]),
        "n_convs": count[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "saved": saved[nodes], "bytes": nbytes[nodes],
        "upper": upper[nodes], "ends_sha256": pa.array(shas[end[nodes]], pa.string())})


def _dealt(lists: DataFrame, partitions: int) -> DataFrame:
    """Lists with the number of turns ``top`` that chose the shard, and the shard."""
    sizes = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("turns")).alias("turns"), F.max(F.size("turns")).alias("longest")).first()
    shards = max(SHARDS_EACH * partitions, -(-(sizes.turns or 0) // SHARD_TURNS))
    share = max(1, -(-sizes.n // partitions))
    steps = [1 << i for i in range(max(1, int(sizes.longest or 0)).bit_length())]
    prefixes = F.transform(F.filter(F.array(*map(F.lit, steps)), lambda d: d <= F.size("turns")),
                           lambda d: F.struct(d.alias("depth"), _digest(F.slice("turns", F.lit(1), d), 3).alias("prefix")))
    each = lists.select("k1", "k2", F.explode(prefixes).alias("p")).select("k1", "k2", "p.*")
    crowded = each.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share).select("depth", "prefix")
    chosen = each.join(crowded, ["depth", "prefix"], "left_anti").groupBy("k1", "k2").agg(F.min(F.struct("depth", "prefix")).alias("p"))
    rows = lists.join(chosen, ["k1", "k2"], "left")
    whole = F.struct((F.size("turns") + 1).alias("depth"), F.col("k1").alias("prefix"))
    rows = rows.withColumn("p", F.coalesce("p", whole))
    return rows.select("n", "conv_id", "ends_sha256", "turns", F.col("p.depth").alias("top"),
                       F.pmod(F.xxhash64("p"), F.lit(shards)).alias("shard"))


def _upper(parts: DataFrame) -> DataFrame:
    """The upper nodes whole: counts added up over the shards, subtree sums carried to all nodes above."""
    up = parts.filter("upper").groupBy("n1", "n2").agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    up = stored(up, "upper-nodes")
    below = up.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("_upper"))
    children = F.col("n_children") + F.coalesce("_upper", F.lit(0))
    up = up.join(below, ["n1", "n2"], "left").withColumns({
        "n_children": children, "n_leaves": F.col("n_leaves") + (children == 0).cast("long"),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")}).drop("_upper")
    up = up.withColumns({"j1": F.when(F.col("depth") > 0, F.col("p1")), "j2": F.when(F.col("depth") > 0, F.col("p2"))})
    deepest, step = up.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        up = stored(up, "upper-nodes")
        gain = up.filter("j1 IS NOT NULL").groupBy(F.col("j1").alias("n1"), F.col("j2").alias("n2")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        jump = up.select(F.col("n1").alias("j1"), F.col("n2").alias("j2"), F.col("j1").alias("_j1"), F.col("j2").alias("_j2"))
        moved = up.filter("j1 IS NOT NULL").join(jump, ["j1", "j2"]).drop("j1", "j2").withColumnsRenamed({"_j1": "j1", "_j2": "j2"})
        up = moved.unionByName(up.filter("j1 IS NULL")).join(gain, ["n1", "n2"], "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("_saved", F.lit(0))}).drop("_leaves", "_saved")
        step *= 2
    above = up.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    inner = up.filter("depth > 0").join(above, ["p1", "p2"])
    return inner.unionByName(up.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def nodes(lists: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns: node and parent_node (digests), conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``lists`` has distinct conv_id and the turns as ``turn_lists`` makes them; an empty list belongs to the root, whose
    parent is null. No conversation, no node: an empty table gives an empty one. Equal turns make one node whoever says them
    first; other columns are not looked at.
    """
    spark = lists.sparkSession
    keyed = stored(lists.select("conv_id", F.col("turns").cast(TURNS).alias("turns")).withColumns({"k1": _digest("turns", 1), "k2": _digest("turns", 2)}), "turns")
    distinct = stored(_ends(keyed).join(keyed.select("conv_id", "turns"), "conv_id"), "turn-lists")
    dealt = _dealt(distinct, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = stored(dealt.groupBy("shard").applyInArrow(_shard, NODE), "trie-nodes")
    upper = _upper(parts)
    whole = parts.filter("NOT upper")
    over = upper.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("_parent"))
    edge = whole.filter("parent_conv_id IS NULL").join(over, ["p1", "p2"]).withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    name = lambda x, y: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
    columns = ["n1", "n2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    rows = whole.filter("parent_conv_id IS NOT NULL").select(*columns).unionByName(edge.select(*columns)).unionByName(upper.select(*columns))
    return rows.select(
        name("n1", "n2").alias("node"), F.when(F.col("depth") > 0, name("p1", "p2")).alias("parent_node"), "conv_id", "depth", "parent_conv_id",
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
