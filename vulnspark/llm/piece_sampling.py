"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A segmentation's weight is the product of its pieces' weights. For a text,
forward filtering sums the weights of all segmentations of every prefix;
backward sampling then draws the last piece, the piece before it and so on,
each with its exact conditional probability. The uniform numbers are hashes
of the row key and the place in the text, so a row is always cut alike.
Decoding joins the pieces and gives the text back, byte by byte.

A byte-pair model has merge ranks and no probabilities; a piece weighs
(1 + rank) ** -alpha, Zipf's law for alpha 1. A character without a piece
of its own is written as its UTF-8 bytes.

The work is done by numpy on many texts at once. A text falls into units
at places that no piece of the vocabulary can span, so segmentations of
units are independent. Filtering runs once for each different unit of a
chunk, side by side, and sampling for all units side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import text_or_empty
from vulnspark.llm.hashing import mix

#: Characters handled side by side.
CHUNK_CHARS = 1 << 19
SPACE = 0x2581
#: A literal U+2581 is not a space; it has this code and goes by its bytes.
LITERAL = 0x110000
#: Neighbouring characters are looked up in a table for the first so many characters of the vocabulary.
COMMON = 512
STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The lattice's pieces: hash table of pieces and their beginnings, weights, and bytes for decoding."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.size = n
        self.byte_id = np.zeros(256, np.int32)
        self.data: list[bytes] = [b""] * n
        self.weight = np.zeros(n + 2, np.float64)
        pieces = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.byte_id[value], self.data[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                pieces[piece], self.data[i] = i, piece.replace(chr(SPACE), " ").encode()
                self.weight[i] = (1.0 + abs(model.get_score(i))) ** -alpha
        self.rare = (1.0 + n) ** -alpha
        self.longest = max(map(len, pieces))
        # Characters: 0 stands for one that no piece has; it is the only piece of its unit.
        chars = sorted({c for p in pieces for c in p}, key=lambda c: (c != chr(SPACE), ord(c)))
        self.chars = np.array(sorted(ord(c) for c in chars), np.int64)
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.number = np.array([number[chr(c)] for c in self.chars])
        self.joined = np.zeros((COMMON, COMMON), bool)
        for p in pieces:
            for a, b in zip(p, p[1:], strict=False):
                if number[a] < COMMON and number[b] < COMMON:
                    self.joined[number[a], number[b]] = True
        # Beginnings map to n (no piece ends here); a character without a piece of its own maps to n + 1.
        known = {p[:k]: n for p in pieces for k in range(1, len(p))} | {c: n + 1 for c in chars} | pieces
        self.weight[n + 1] = self.rare
        keys = mix(np.array(self._hashes(list(known)), np.uint64))
        self.mask = np.uint64((1 << (4 * len(known)).bit_length()) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int32)
        for key, value in zip(keys, known.values(), strict=True):
            at = int(key & self.mask)
            while self.values[at] >= 0:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.values[at] = key, value

    def _hashes(self, pieces: list[str]) -> list[int]:
        """What the rolling hash over a text's characters gives for each piece."""
        char = dict(zip(map(chr, self.chars), mix(self.chars.astype(np.uint64)).tolist(), strict=True))
        out, step, whole = [], int(STEP), (1 << 64) - 1
        for piece in pieces:
            h = 0
            for c in piece:
                h = (h * step + char[c]) & whole
            out.append(h)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id, n for a beginning, n + 1 for a character without a piece, -1 for neither."""
        h = mix(hashes)
        at = (h & self.mask).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (self.values[at[todo]] >= 0)]
        return out

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, self.number[at], 0)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.data.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One vocabulary a worker, whatever the number of its tasks."""
    return Vocabulary(path, alpha)


def codes_of(text: str) -> np.ndarray:
    """Code points with spaces as U+2581, after the one that every text but an empty one begins with."""
    codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) if text else np.empty(0, np.int64)
    return np.where(codes == SPACE, LITERAL, np.where(codes == 32, SPACE, codes))


def _filter(voc: Vocabulary, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and prefix ratios of units of like length.

    ``codes`` is places x units. Returns piece[k - 1, i, u], the id of the piece of k characters from place i (-1: none),
    and ratio[i, u], the weight of all segmentations up to place i over that up to the place before.
    """
    places, units = codes.shape
    piece = np.full((min(voc.longest, places), places, units), -1, np.int32)
    char = mix(codes.astype(np.uint64))
    at = np.flatnonzero((np.arange(places)[:, None] < length[None]).ravel())
    hashes = np.zeros(len(at), np.uint64)
    flat_char, left = char.ravel(), (length[None] - np.arange(places)[:, None]).ravel()
    for k in range(1, len(piece) + 1):
        hashes = hashes * STEP + flat_char[at + (k - 1) * units]
        found = voc.find(hashes)
        if k == 1:
            found[found < 0] = voc.size + 1
        piece[k - 1].reshape(-1)[at] = np.where(found == voc.size, -1, found)
        go = (found >= 0) & (left[at] > k) & (found != voc.size + 1 if k > 1 else True)
        at, hashes = at[go], hashes[go]
        if not len(at):
            piece = piece[:k]
            break
    ratio = np.ones((places, units))
    weight = voc.weight
    for i in range(places):
        total = weight[piece[0, i]]
        span = np.ones(units)
        for k in range(2, min(len(piece), i + 1) + 1):
            span = span * ratio[i - k + 1]
            own = piece[k - 1, i - k + 1]
            total = total + np.where(own >= 0, weight[own], 0.0) / span
        ratio[i] = np.where(i < length, total, 1.0)
    return piece, ratio


def _sample(voc: Vocabulary, piece: np.ndarray, ratio: np.ndarray, unit: np.ndarray, end: np.ndarray, place: np.ndarray, seed: np.ndarray, out: np.ndarray) -> None:
    """Draws pieces from the end of each unit; ``place`` is where in ``out`` the unit's last character stands."""
    weight = voc.weight
    while len(unit):
        u = ((mix(seed + place.astype(np.uint64) * STEP) >> np.uint64(11)).astype(np.float64)) * 2.0**-53
        chosen = np.zeros(len(unit), np.int64)
        todo, span = np.arange(len(unit)), np.ones(len(unit))
        last = np.zeros(len(unit), np.int64)
        for k in range(1, len(piece) + 1):
            if not len(todo):
                break
            at, own_unit = end[todo] - k + 1, unit[todo]
            span = span * ratio[end[todo] - k + 1, own_unit]
            own = piece[k - 1, at, own_unit]
            share = np.where(own >= 0, weight[own], 0.0) / span
            last[todo[own >= 0]] = k
            u[todo] -= share
            done = u[todo] < 0
            chosen[todo[done]] = k
            more = ~done & (end[todo] >= k)
            todo, span = todo[more], span[more]
        chosen = np.where(chosen == 0, last, chosen)  # rounding left a sliver above the last piece
        out[place - chosen + 1] = piece[chosen - 1, end - chosen + 1, unit]
        more = end - chosen >= 0
        unit, end, place, seed = unit[more], (end - chosen)[more], (place - chosen)[more], seed[more]


def segment(voc: Vocabulary, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each text, seeded by its 64-bit key."""
    parts = [codes_of(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if not len(codes):
        return [np.empty(0, np.int32) for _ in texts]
    first = np.cumsum(sizes) - sizes
    number = voc.numbers(codes)
    a, b = number[:-1], number[1:]
    rare = (a >= COMMON) | (b >= COMMON)
    together = (a > 0) & (b > 0) & (rare | voc.joined[np.where(rare, 0, a), np.where(rare, 0, b)])
    cut = np.concatenate([[True], ~together])
    cut[first[sizes > 0]] = True
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate([begin, [len(codes)]]))
    # Equal units are found by a hash of their characters and their length.
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = STEP
    power = np.cumprod(power)
    inside = np.arange(len(codes)) - np.repeat(begin, length)
    name = np.add.reduceat(mix(codes.astype(np.uint64)) * power[inside], begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, example, kind = np.unique(name, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), sizes)[begin]
    # Makes a place count from the start of its own text, so neighbours do not matter.
    seed = mix(keys)[owner] - first[owner].astype(np.uint64) * STEP
    out = np.full(len(codes), -1, np.int32)
    level = np.ceil(np.log2(np.maximum(length[example], 4))).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(len(example) + 1))
    counts = np.diff(bounds)
    for l in np.unique(level):
        units = np.flatnonzero(level == l)
        longest = int(length[example[units]].max())
        for i in range(0, len(units), max(1, CHUNK_CHARS // longest)):
            own = units[i : i + max(1, CHUNK_CHARS // longest)]
            n = length[example[own]]
            grid = begin[example[own]][None] + np.arange(longest)[:, None]
            block = np.where(np.arange(longest)[:, None] < n[None], codes[np.minimum(grid, len(codes) - 1)], 0)
            piece, ratio = _filter(voc, block, n)
            at = np.repeat(bounds[own], counts[own]) + np.arange(counts[own].sum()) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
            who = order[at]
            unit = np.repeat(np.arange(len(own)), counts[own])
            _sample(voc, piece, ratio, unit, n[unit] - 1, begin[who] + n[unit] - 1, seed[who], out)
    return _with_bytes(voc, out, codes, first, sizes)


def _with_bytes(voc: Vocabulary, out: np.ndarray, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ids in order, characters without a piece as their bytes, cut by text."""
    places = np.flatnonzero(out >= 0)
    ids = out[places]
    bare = np.flatnonzero(ids == voc.size + 1)
    if len(bare):
        code = codes[places[bare]]
        data = [chr(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in code.tolist()]
        count = np.ones(len(ids), np.int64)
        count[bare] = [len(d) for d in data]
        full = np.repeat(ids, count)
        ends = np.cumsum(count)
        where = np.repeat(ends[bare] - count[bare], count[bare]) + np.concatenate([np.arange(len(d)) for d in data])
        full[where] = voc.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        places, ids = np.repeat(places, count), full
    bounds = np.searchsorted(places, np.concatenate([first, [len(codes)]]))
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, ids, n_pieces, ids_crc32 (little-endian u32) and lossless (decoding gave the text).

    The key of a row is its id; a null text is empty and has no pieces; a null id is a key like another;
    repeated rows are cut alike; other columns are left out; an empty table gives an empty one.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model, alpha)
        for batch in batches:
            texts = batch["text"].tolist()
            keys = batch["key"].to_numpy(np.int64).view(np.uint64) + np.uint64(seed)
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (held == 0 or held + len(texts[stop]) <= CHUNK_CHARS):
                    held += len(texts[stop]) + 1
                    stop += 1
                ids = segment(voc, texts[at:stop], keys[at:stop])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:stop].to_numpy(), "ids": ids, "n_pieces": [len(x) for x in ids],
                                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                                    "lossless": [voc.decode(x) == t for x, t in zip(ids, texts[at:stop], strict=True)]})
                at = stop

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
                       text_or_empty().alias("text"))
    out = rows.mapInPandas(apply, "doc_id string, ids array<int>, n_pieces long, ids_crc32 long, lossless boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """The rows with ``text`` decoded from ``ids``."""
    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = vocabulary(model, 1.0)
        for ids in batches:
            yield pd.Series([voc.decode(np.asarray(x)) for x in ids])

    return rows.withColumn("text", join("ids"))
