"""Near-dedup by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles, weighted by how often each
occurs. Every shingle owns a half-plane of weight and rank on which hashed
darts fall, one per unit area on average and the same for every document.
A document meets the darts below its shingle's weight. Each dart belongs to
one of ``k`` coordinates, and the dart of lowest rank in a coordinate is the
signature there, so two documents agree in a coordinate with a probability
equal to their weighted Jaccard similarity. Darts are thrown in dyadic
weight bands by rising rank and only up to the rank that is expected to
fill all coordinates; documents with an empty one go on to twice that rank.

Candidates come from bands of the signature and every one is verified on
whole texts (see ``linking``). Copies with the same words are one node from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored, text_or_empty, words_of
from vulnspark.llm.hashing import WordHashes, mix, shingles
from vulnspark.llm.linking import linked, shared_buckets

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: The nodes whose texts are compared are broadcast up to this many bytes; more are joined by shuffle.
BROADCAST_BYTES, NODE_BYTES = 32 << 20, 16
#: Documents whose darts are thrown together.
CHUNK = 64

RANK_SEED, WEIGHT_SEED, COORDINATE_SEED = 1, 2, 3


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _darts(owner, element, weight, reach):
    """Darts of ``element`` below ``weight`` with a rank up to ``reach``: owner, dart hash, rank."""
    out, low, width = [], 0.0, 1.0
    while len(element):
        who, what, most, far = owner, mix(element, 16 + int(low)), weight, reach
        rank = np.zeros(len(what))
        throw = 0
        while len(what):
            dart = mix(what, 64 + throw)
            u = _uniform(mix(dart, RANK_SEED))
            # The next dart lies an exponential step further; most steps leave the reach at once.
            near = u >= np.exp((rank - far) * width)
            who, what, most, far, rank, dart, u = (x[near] for x in (who, what, most, far, rank, dart, u))
            rank = rank - np.log(u) / width
            in_weight = low + width * _uniform(mix(dart, WEIGHT_SEED)) <= most
            out.append((who[in_weight], dart[in_weight], rank[in_weight]))
            throw += 1
        low, width = low + width, low + width
        more = weight > low
        owner, element, weight, reach = owner[more], element[more], weight[more], reach[more]
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (owner, element, reach)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` dart hashes for each weighted set (elements, weights), none of them empty."""
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    totals = np.array([w.sum() for _, w in sets], np.float64)
    reach = k * (np.log(k) + 2.0) / np.maximum(totals, 1e-300)
    while len(todo):
        sizes = [len(sets[i][0]) for i in todo]
        owner = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        who, dart, rank = _darts(owner, element, weight, reach[todo][owner])
        at = who * k + (mix(dart, COORDINATE_SEED) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        at, dart = at[order], dart[order]
        found, filled = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        found[at], filled[at] = dart, True  # the last written is the lowest rank
        full = filled.reshape(-1, k).all(axis=1)
        out[todo[full]] = found.reshape(-1, k)[full]
        todo = todo[~full]
        reach[todo] *= 2.0
    return out


def weighted_set(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes, SHINGLE_WORDS), return_counts=True)


def elements():
    """A function from texts to the shingles of each, as often as they occur: Jaccard over these is the weighted one."""
    memory = WordHashes()

    def one(text: str) -> np.ndarray:
        found, weight = weighted_set(memory.of(words_of(text)))
        number = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        return np.sort(mix(np.repeat(found, weight) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    return lambda texts: [one(t) for t in texts]


def node_of(text: Column) -> Column:
    """The same for texts of the same words in the same order."""
    return F.xxhash64(F.trim(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")))


def band_keys(docs: DataFrame) -> DataFrame:
    """doc_id, node, keys: the band keys of each document; none for a text without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        seeds = mix(np.arange(BANDS, dtype=np.uint64), 7)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                rows = batch.iloc[at : at + CHUNK]
                keys: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
                sets = {}
                for i, text in enumerate(rows["text"]):
                    if words := words_of(text):
                        sets[i] = weighted_set(memory.of(words))
                signed = signatures(list(sets.values()), BANDS * ROWS).reshape(-1, BANDS, ROWS)
                banded = np.broadcast_to(seeds, signed.shape[:2]).copy()
                for r in range(ROWS):
                    banded = mix(banded ^ signed[:, :, r])
                for i, own in zip(sets, banded.view(np.int64), strict=True):
                    keys[i] = own
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "node": rows["node"].to_numpy(), "keys": keys})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), node_of(F.col("text")).alias("node"), "text")
    return rows.mapInPandas(sign, "doc_id string, node long, keys array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _place(doc_id: str) -> Column:
    """Ids in order, null first."""
    return F.struct(F.col(doc_id).isNotNull().alias("there"), F.col(doc_id).alias("id"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every document, and (node, component, class_id, class_size) of every node; class_id is the smallest id, null the
    smallest of all."""
    signed = stored(band_keys(docs), "darts")
    bands = signed.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = shared_buckets(bands)
    # Every text that shares a bucket, once: what all comparisons read.
    wanted = stored(shared.select("node").distinct(), "wanted")
    if wanted.count() * NODE_BYTES <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.select(node_of(F.col("text")).alias("node"), text_or_empty().alias("text")).join(wanted, "node", "left_semi")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    groups = linked(shared, texts, elements, SIMILARITY)
    nodes = signed.groupBy("node").agg(F.min(_place("doc_id")).alias("_least"), F.count(F.lit(1)).alias("_copies"))
    nodes = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = nodes.groupBy("component").agg(F.min("_least")["id"].alias("class_id"), F.sum("_copies").alias("class_size"))
    return signed.select("doc_id", "node"), nodes.select("node", "component").join(whole, "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size, kept.

    A class is a connected component of documents at least SIMILARITY alike; its smallest id stays. Texts
    without words, null included, are copies of each other; a text of fewer than five words is one shingle;
    null ids come before others; repeated rows share their verdict; an empty table gives an empty one.
    """
    rows, known = classes(docs)
    return rows.join(known, "node").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each class, with every column: that of the smallest id, null first; of rows that share it, the one whose words
    have the smallest hash, whatever else the rows hold."""
    rows, known = classes(docs)
    first = rows.join(known.select("node", "component"), "node").groupBy("component").agg(
        F.min(F.struct(_place("doc_id").alias("place"), "node")).alias("_f")).select(F.col("_f.place.id").alias("_id"), F.col("_f.node").alias("node"))
    packed = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("_own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    kept = packed.join(first, "node").filter(F.col("_own").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["node"]).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
