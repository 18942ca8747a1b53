"""From band keys to verified components, for any sets made of texts.

In a bucket every node is first checked against one hub, so a bucket takes
as many checks as it has members. The hub is the member that shares most
buckets with others: the original of a large group of copies rather than
one of the copies. Components of the links found then show which buckets
still hold nodes that are apart, and only nodes of those go on. There every
pair across components is decided exactly, but pairs never become rows: a
bucket is cut into blocks of bounded bytes, one cell for two blocks holds
an inverted index of their elements, counts all overlaps of a member in one
pass and returns at most the links of a spanning forest. So every pair of a
bucket is either checked or already joined by a chain of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored
from vulnspark.llm.components import components

#: Text of one block of a bucket; a cell holds two.
BLOCK_BYTES = 2 << 20

#: Characters of text whose elements are made together.
CHUNK_CHARS = 1 << 20

#: Makes, in a task, the function from texts to the different elements of each, in rising order and never none.
Elements = Callable[[], Callable[[list[str]], list[np.ndarray]]]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two rising sets is high enough."""
    both = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return both >= similarity * (len(a) + len(b) - both)


def _chunks(batch: pd.DataFrame, *texts: str) -> Iterator[pd.DataFrame]:
    """The batch in pieces of about CHUNK_CHARS of text."""
    total = np.cumsum(sum(batch[c].str.len().to_numpy(np.int64) for c in texts))
    bounds = np.searchsorted(total, np.arange(1, total[-1] // CHUNK_CHARS + 1) * CHUNK_CHARS, side="right") if len(total) else []
    for a, b in zip([0, *bounds], [*bounds, len(batch)], strict=True):
        if a < b:
            yield batch.iloc[a:b]


def shared_buckets(bands: DataFrame) -> DataFrame:
    """key, node, hub for every bucket with two nodes or more; ``bands`` has (key, node)."""
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_lo"), F.max("node").alias("_hi"))
    sizes = sizes.filter("_lo < _hi").select("key", "_n")
    shared = stored(bands.join(sizes, "key"), "buckets")
    known = shared.groupBy("node").agg(F.sum("_n").alias("_known"))
    ranked = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("_known", "node")).alias("_best"))
    return stored(shared.select("key", "node").join(ranked.select("key", F.col("_best.node").alias("hub")), "key"), "shared")


def verified(pairs: DataFrame, texts: DataFrame, elements: Elements, similarity: float) -> DataFrame:
    """The true ones of pairs (a, b) of nodes; ``texts`` has node and text, once each."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last, first = elements(), None, None
        for batch in batches:
            for rows in _chunks(batch, "text_a", "text_b"):
                names = rows["a"].to_numpy()
                new = np.flatnonzero(np.concatenate([[names[0] != last or first is None], names[1:] != names[:-1]]))
                made = iter(of(rows["text_a"].iloc[new].tolist()))
                fresh, keep = set(new.tolist()), []
                for i, other in enumerate(of(rows["text_b"].tolist())):
                    if i in fresh:
                        first = next(made)
                    keep.append(alike(first, other, similarity))
                last = names[-1]
                yield rows.loc[keep, ["a", "b"]]

    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ba")
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long")


def forest(sets: list[np.ndarray], groups: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links (places in the lists) that join all groups which some pair of alike sets joins."""
    parent = {g: g for g in groups}

    def root(g):
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    bounds = np.searchsorted(element[order], np.arange(element.max() + 2))
    holders, starts = owner[order], np.cumsum(sizes) - sizes
    names, counts = np.unique(groups, return_counts=True)
    largest, out = int(names[counts.argmax()]), []
    for i, g in enumerate(groups):
        if g == largest:  # its members meet all others when those take their turn
            continue
        own = element[starts[i] : starts[i] + sizes[i]]
        n = bounds[own + 1] - bounds[own]
        at = np.arange(n.sum()) + np.repeat(bounds[own] - (np.cumsum(n) - n), n)
        both = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(both >= similarity * (sizes[i] + sizes - both)).tolist():
            a, b = root(g), root(groups[j])
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def _across(apart: DataFrame, texts: DataFrame, elements: Elements, similarity: float) -> DataFrame:
    """Links (a, b) that join components within buckets; ``apart`` has key, node, component."""
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, place, nodes, groups, sets = elements(), None, [], [], []

        def links() -> list[tuple[int, int]]:
            if len(set(groups)) < 2:
                return []
            if len(sets) == 2:
                return [(nodes[0], nodes[1])] if alike(sets[0], sets[1], similarity) else []
            return [(nodes[i], nodes[j]) for i, j in forest(sets, groups, similarity)]

        for batch in batches:
            for rows in _chunks(batch, "text"):
                out = []
                columns = (rows[c] for c in ("key", "i", "j", "node", "component"))
                for *cell, node, group, own in zip(*columns, of(rows["text"].tolist()), strict=True):
                    if cell != place:
                        out += links()
                        place, nodes, groups, sets = cell, [], [], []
                    nodes.append(node)
                    groups.append(group)
                    sets.append(own)
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(links(), columns=["a", "b"], dtype="int64")

    with_text = apart.join(texts, "node")
    blocks = with_text.groupBy("key").agg(F.ceil(F.sum(F.length("text")) / BLOCK_BYTES).alias("_blocks"))
    rows = with_text.join(blocks, "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "component", "text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInPandas(cells, "a long, b long")


def linked(shared: DataFrame, texts: DataFrame, elements: Elements, similarity: float) -> DataFrame:
    """``node`` and ``component`` of every node with a verified link."""
    tried = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(tried, texts, elements, similarity), "pairs")
    groups = components(links)
    placed = shared.join(groups, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("component"))
    # The hub has met every other; a bucket is open if the rest of it is still in different components.
    rest = placed.filter("node <> hub")
    open_ = rest.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("key")
    more = stored(_across(rest.select("key", "node", "component").join(open_, "key"), texts, elements, similarity), "pairs")
    return groups if more.isEmpty() else components(links.unionByName(more))
