"""Substring dedup: passages of WINDOW words that an earlier document has are removed.

Suffix automata over reference passages decide what is shared: a document is
streamed through them and its matching statistics (the longest earlier match
ending at each word) mark every word under a match of WINDOW words or more.
One automaton of the whole corpus would neither fit an executor nor a
broadcast, so the reference is cut into shards by content. Every window has
an anchor, its run of ANCHOR words with the lowest hash; equal windows have
equal anchors, so it is enough to stream a passage through the automaton of
its anchor's shard. An anchor that only one text has needs no automaton.
A shard's automaton holds SHARD passages at most. An anchor with more is
dealt to many tasks, each with the automaton of the anchor's REFERENCES
earliest passages, which settles what very many documents share. Windows it
does not know are settled by the earliest document of each window's content,
a minimum combined before the shuffle; no passage and no window is left out.

Copies with the same words are one text, led by its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnspark.llm.common import stored, text_or_empty, words_of
from vulnspark.llm.dart_minhash import node_of
from vulnspark.llm.hashing import WordHashes, runs

WINDOW = 50
ANCHOR = 8
SHARD = 2000
REFERENCES = 32


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first lowest value in each run of ``width`` values."""
    n = len(values) - width + 1
    place = np.arange(len(values))
    best, span = values, 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        pa, pb = place[: len(best) - step], place[step:]
        right = b < a
        best, place = np.where(right, b, a), np.where(right, pb, pa)
        span += step
    return place[:n]


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each run of windows with one anchor."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = runs(hashes, ANCHOR)
    place = _lowest(grams, WINDOW - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], first, np.concatenate([first[1:], [len(place)]]) - 1


class SuffixAutomaton:
    """Suffix automaton of one growing sequence; a new passage follows a separator that matches nothing."""

    def __init__(self):
        self.next, self.link, self.len, self.last, self.parts = [{}], [-1], [0], 0, 0

    def _extend(self, c):
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p = self.last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words):
        self.parts += 1
        for w in words:
            self._extend(w)
        self._extend(self.parts)  # an int is never equal to a word

    def matching(self, words) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.len
        state, matched, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            out.append(matched)
        return out


def spans_of(ends: list[int]) -> list[tuple[int, int]]:
    """Half-open word spans covered by windows that end at the given rising places."""
    out: list[tuple[int, int]] = []
    for e in ends:
        start = e + 1 - WINDOW
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], e + 1)
        else:
            out.append((start, e + 1))
    return out


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchored(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows, out = batch.iloc[at : at + 256], []
                for text in rows["text"]:
                    words = words_of(text)
                    found, low, high = anchors(memory.of(words))
                    out.append((len(words), _sha(words), found.view(np.int64), low, high))
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "node": rows["node"].to_numpy(),
                                    **{c: [o[i] for o in out] for i, c in enumerate(("n_words", "sha", "anchor", "low", "high"))}})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), node_of(F.col("text")).alias("node"), "text")
    signed = rows.mapInPandas(sign, "doc_id string, node long, n_words long, sha string, anchor array<long>, low array<long>, high array<long>")
    return signed.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))


def _passages(texts: DataFrame) -> DataFrame:
    """The words of every run of windows with a shared anchor."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = []
                for r in batch.iloc[at : at + 64].itertuples(index=False):
                    words = words_of(r.text)
                    for m in r.marks:
                        out.append((m["anchor"], m["members"], r.node, r.first_id, m["low"], b" ".join(words[m["low"] : m["high"] + WINDOW]).decode()))
                yield pd.DataFrame(out, columns=["anchor", "members", "node", "first_id", "low", "words"])

    return texts.select("node", "first_id", "text", "marks").mapInPandas(
        cut, "anchor long, members long, node long, first_id long, low long, words string")


def _by_automaton(passages: DataFrame, hot: bool) -> DataFrame:
    """Spans (node, start, stop) matched in earlier documents; one shard after the other, never all of a partition.

    Passages with ``ref`` join the automaton, those with ``ask`` are streamed. If ``hot``, the windows of these that
    did not match follow as rows with the hash ``key`` of their words.
    """
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        shard, doc, seen, automaton, waiting, fresh = None, None, set(), None, [], []

        def close_doc():
            """What the document that ends adds to the reference."""
            for text in fresh:
                if text not in seen:
                    seen.add(text)
                    waiting.append(text)
            fresh.clear()

        def ends_in(words: list[str]) -> list[int]:
            nonlocal automaton
            if not seen:
                return []
            automaton = automaton or SuffixAutomaton()
            for reference in waiting:
                automaton.add(reference.split(" "))
            waiting.clear()
            return [i for i, n in enumerate(automaton.matching(words)) if n >= WINDOW]

        for batch in batches:
            for at in range(0, len(batch), 512):
                out, keys, starts, who = [], [], [], []
                for anchor, salt, node, first_id, low, text, ref, ask in batch.iloc[at : at + 512].itertuples(index=False):
                    if (anchor, salt) != shard:
                        shard, doc, seen, automaton = (anchor, salt), None, set(), None
                        waiting.clear()
                        fresh.clear()
                    if first_id != doc:
                        close_doc()
                        doc = first_id
                    if ref:
                        fresh.append(text)
                    if not ask:
                        continue
                    if text in seen:
                        out.append((node, low, low + text.count(" ") + 1, None, None, None))
                        continue
                    ends = ends_in(text.split(" "))
                    out += [(node, low + a, low + b, None, None, None) for a, b in spans_of(ends)]
                    if hot:
                        found = runs(memory.of(words_of(text)), WINDOW)
                        left = np.setdiff1d(np.arange(len(found)), np.array(ends, np.int64) - (WINDOW - 1))
                        keys.append(found[left].view(np.int64))
                        starts.append(left + low)
                        who.append((anchor, node, first_id, len(left)))
                yield pd.DataFrame(out, columns=["node", "start", "stop", "key", "anchor", "first_id"])
                if who:
                    n = [w[3] for w in who]
                    yield pd.DataFrame({"node": np.repeat([w[1] for w in who], n), "start": np.concatenate(starts), "stop": None, "key": np.concatenate(keys),
                                        "anchor": np.repeat([w[0] for w in who], n), "first_id": np.repeat([w[2] for w in who], n)})

    rows = passages.select("anchor", "salt", "node", "first_id", "low", "words", "ref", "ask")
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "first_id", "node", "low")
    return rows.mapInPandas(match, "node long, start long, stop long, key long, anchor long, first_id long")


def _few(passages: DataFrame) -> DataFrame:
    rows = passages.withColumns({"salt": F.lit(0).cast("long"), "ref": F.lit(True), "ask": F.lit(True)})
    return _by_automaton(rows, False).select("node", "start", "stop")


def _many(passages: DataFrame, shard: int) -> DataFrame:
    """Spans for anchors with more passages than a shard holds."""
    salts = F.ceil(F.col("members") / shard)
    asked = passages.withColumns({"salt": F.pmod(F.xxhash64("node", "low"), salts), "ref": F.lit(False), "ask": F.lit(True)})
    earliest = Window.partitionBy("anchor").orderBy("first_id", "node", "low")
    known = passages.withColumn("_rank", F.row_number().over(earliest)).filter(F.col("_rank") <= REFERENCES).drop("_rank")
    known = known.withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)), "ref": F.lit(True), "ask": F.lit(False)})
    both = stored(_by_automaton(asked.unionByName(known), True), "matched")
    left = both.filter("key IS NOT NULL")
    least = left.groupBy("key", "anchor").agg(F.min("first_id").alias("_least"), F.max("first_id").alias("_most")).filter("_least < _most")
    later = left.join(least, ["key", "anchor"]).filter("_least < first_id").select("node", "start", (F.col("start") + WINDOW).alias("stop"))
    return both.filter("key IS NULL").select("node", "start", "stop").unionByName(later)


def _removed(texts: DataFrame) -> DataFrame:
    """node, n_removed, kept_sha256 and kept text from a text and its spans."""
    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, text, spans in zip(batch["node"], batch["text"], batch["spans"], strict=True):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["stop"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                left = [words[i] for i in np.flatnonzero(keep)]
                out.append((node, len(words) - len(left), _sha(left), b" ".join(left).decode()))
            yield pd.DataFrame(out, columns=["node", "n_removed", "kept_sha256", "kept_text"])

    return texts.select("node", "text", "spans").mapInPandas(strip, "node long, n_removed long, kept_sha256 string, kept_text string")


def dedup(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, kept_text (null: the words are all kept).

    Null texts have no words; a null id counts as the smallest; rows that repeat an id are not earlier than
    each other; texts of fewer than WINDOW words are kept; an empty table gives an empty one.
    """
    signed = stored(_anchored(docs), "anchors")
    first = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    each = signed.select("node", F.explode(F.arrays_zip("anchor", "low", "high")).alias("m")).select("node", "m.*")
    shared = each.groupBy("anchor").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count(F.lit(1)).alias("members"))
    shared = shared.filter("_lo <> _hi").select("anchor", "members")
    marks = each.join(shared, "anchor").distinct().groupBy("node").agg(F.collect_list(F.struct("anchor", "members", "low", "high")).alias("marks"))
    texts = docs.select(node_of(F.col("text")).alias("node"), text_or_empty().alias("text")).join(marks.join(first, "node"), "node")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    few = _passages(texts.withColumn("marks", F.filter("marks", lambda m: m["members"] <= shard)))
    many = _passages(texts.withColumn("marks", F.filter("marks", lambda m: m["members"] > shard)))
    spans = _few(few).unionByName(_many(many, shard))
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = _removed(texts.select("node", "text").join(spans, "node"))
    rows = signed.select("doc_id", "node", "n_words", "sha").join(first, "node").join(changed, "node", "left")
    copied = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    return rows.select(
        F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
