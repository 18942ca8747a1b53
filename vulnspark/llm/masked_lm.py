"""Language-model scores by masked pseudo-likelihood.

A small network predicts a word from SIDE words on either side: their
embeddings, a tanh layer, then a two-level softmax (class of the word, word
within its class). Every word of a text is masked in turn, and the sum of
the conditional log-probabilities scores the text.

Everything is learned from the whole corpus. Words are counted over all
documents; the frequent ones get ids of their own, the rest share hashed
ids (buckets) in the network, and each has its share of its bucket's count as
its own probability within the bucket. These counts are a table as large as
the corpus has words, joined to the documents' words by shuffle. Every text is
split once; its ids are a written table that all rounds and the scoring read.

Training deals the positions of every document to the rounds by hash, so that
each is a target once, and the documents to groups by a hash of text and id. In
each round every group is trained on in the order of its hashes from the same
start, and the results are averaged, weighted by positions. The average is a
sum of whole numbers over (parameter). So the parameters depend neither on the
order of tasks nor on how the table is cut into files, and only one number for
each parameter reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import pieces, stored, text_or_empty
from vulnspark.llm.hashing import mix

CLASSES, PER_CLASS = 64, 64
VOCABULARY = CLASSES * PER_CLASS
#: Ids that all words outside the frequent ones share; a power of two.
HASHED = 256
#: Bytes a word can have, and its end.
SPELLED = 251
SIDE, WIDTH, HIDDEN = 2, 12, 24
ROUNDS, STEP_POSITIONS, RATE = 2, 8192, 0.1
#: Positions scored at once, and ids of the texts that are scored together.
CHUNK, SCORED_IDS = 16384, 262_144
#: Words of a training group; beyond MAX_GROUPS groups they grow instead, as each sends every parameter.
GROUP_WORDS, MAX_GROUPS = 1 << 22, 4096
#: Bytes of text whose words are told apart together: the larger, the fewer rows the tables of words get before they are merged.
PIECE_BYTES = 16 << 20
#: Averages are sums of parameters times this, as whole numbers.
FIXED_POINT = 1 << 20
PAD = VOCABULARY

SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "klass": (HIDDEN, CLASSES),
          "klass_bias": (CLASSES,), "word": (CLASSES, HIDDEN, PER_CLASS), "word_bias": (CLASSES, PER_CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def start() -> np.ndarray:
    """The parameters before training, on end."""
    rng = np.random.default_rng(10)
    scale = {"embed": 0.3, "inner": (2 * SIDE * WIDTH) ** -0.5, "klass": HIDDEN**-0.5, "word": HIDDEN**-0.5}
    return np.concatenate([(rng.normal(size=s) * scale.get(n, 0.0)).ravel() for n, s in SHAPES.items()]).astype(np.float32)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters by name."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


class WordIds(dict):
    """Id of each word; frequent words by rank, others by hash."""

    def __init__(self, frequent: list[str]):
        super().__init__((w.encode("utf-8", "surrogatepass"), i) for i, w in enumerate(frequent))

    def __missing__(self, word: bytes) -> int:
        return VOCABULARY - HASHED + xxhash.xxh3_64_intdigest(word) % HASHED


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every word of the texts on end, and how many each text has."""
    # Splits at the ASCII white space that ends a word; a text with some at an end has an empty word there.
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(some), np.diff(before[lists.offsets.to_numpy()])


def _bytes(words: pa.Array) -> list[bytes]:
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = data.to_pybytes()
    return [raw[a:b] for a, b in pairwise(bounds)]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Every word of the texts on end as a place in the list of different words; words of each text; that list."""
    words, counts = _words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), counts, _bytes(coded.dictionary)


def split_rare(texts: pa.Array, frequent: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ranks of the words of the texts on end (0 for those not frequent) and words of each text; where the others are, their
    places in the list of the different ones, and that list. A lookup among the frequent ones is cheap, so only the others are told apart.
    """
    words, counts = _words(texts)
    ranks = pc.index_in(words, value_set=pa.array(frequent, words.type))
    others = ranks.is_null()
    coded = words.filter(others).dictionary_encode()
    at = np.flatnonzero(others.to_numpy(zero_copy_only=False))
    return ranks.fill_null(0).to_numpy(), counts, at, coded.indices.to_numpy(), _bytes(coded.dictionary)


def _hashes(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def _text_keys(texts: pa.Array) -> np.ndarray:
    """A number of 63 bits for each text."""
    return _hashes([t.as_buffer() for t in texts]) & np.uint64(2**63 - 1)


def padded(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts on end with SIDE pads around each; the place of every word in it, and the text it belongs to."""
    pad = np.full(SIDE, PAD, np.int32)
    lengths = np.array([len(x) for x in ids], np.int64)
    stream = np.concatenate([x for own in ids for x in (pad, own)] + [pad])
    owner = np.repeat(np.arange(len(ids)), lengths)
    return stream, np.arange(lengths.sum()) + SIDE * (owner + 1), owner


def by_class(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the places by the class of their words, the words in it, and where each class begins."""
    order = np.argsort(stream[at].astype(np.int16), kind="stable")
    target = stream[at[order]].astype(np.int64)
    return order, target, np.searchsorted(target, np.arange(CLASSES + 1) * PER_CLASS)


def forward(p: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids, their embeddings and the hidden layer for the words at the given places."""
    around = stream[at[:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])]
    x = np.take(p["embed"], around.ravel(), axis=0).reshape(len(at), -1)
    hidden = x @ p["inner"]
    hidden += p["inner_bias"]
    return around, x, np.tanh(hidden, out=hidden)


def word_logits(p: dict[str, np.ndarray], hidden: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For rows in the order of classes, a number for each word of the row's class."""
    out = np.empty((len(hidden), PER_CLASS), hidden.dtype)
    for c, (a, b) in enumerate(pairwise(bounds)):
        if a < b:
            np.matmul(hidden[a:b], p["word"][c], out=out[a:b])
            out[a:b] += p["word_bias"][c]
    return out


def _less_shares(z: np.ndarray) -> np.ndarray:
    """Softmax of every row with its sign turned, in place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= -(z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_share(z: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of every row; overwrites ``z``."""
    z -= z.max(axis=1, keepdims=True)
    picked = z[np.arange(len(z)), pick].astype(np.float64)
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype))


def log_probabilities(p: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the word at each place, given the words around it."""
    out = np.empty(len(at))
    for i in range(0, len(at), CHUNK):
        own = at[i : i + CHUNK]
        order, target, bounds = by_class(stream, own)
        _, _, hidden = forward(p, stream, own[order])
        klass = hidden @ p["klass"]
        klass += p["klass_bias"]
        out[i + order] = _log_share(klass, target // PER_CLASS) + _log_share(word_logits(p, hidden, bounds), target % PER_CLASS)
    return out


def gradient(p: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray, flat: np.ndarray) -> None:
    """Writes the gradient of the mean log-probability at the given places into ``flat``."""
    flat[:] = 0
    g, n = parts(flat), len(at)
    order, target, bounds = by_class(stream, at)
    around, x, hidden = forward(p, stream, at[order])
    rows, ones = np.arange(n), np.ones(n, hidden.dtype)
    klass = hidden @ p["klass"]
    klass += p["klass_bias"]
    d = _less_shares(klass)
    d[rows, target // PER_CLASS] += 1
    g["klass"][:], g["klass_bias"][:] = hidden.T @ d, ones @ d
    dh = d @ p["klass"].T
    e = word_logits(p, hidden, bounds)
    _less_shares(e)
    e[rows, target % PER_CLASS] += 1
    for c, (a, b) in enumerate(pairwise(bounds)):
        if a < b:
            g["word"][c], g["word_bias"][c] = hidden[a:b].T @ e[a:b], e[a:b].sum(axis=0)
            dh[a:b] += e[a:b] @ p["word"][c].T
    hidden *= hidden
    dh *= 1 - hidden
    g["inner"][:], g["inner_bias"][:] = x.T @ dh, ones @ dh
    dx = (dh @ p["inner"].T).reshape(-1, WIDTH)
    ids = around.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g["embed"][ids[firsts]] = np.add.reduceat(np.take(dx, order, axis=0), firsts, axis=0)
    flat /= n


def targets(owner_hash: np.ndarray, at: np.ndarray, owner: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places that one of the rounds trains on: dealt by a hash of the text's words and the place in it."""
    first = np.searchsorted(owner, np.arange(len(owner_hash)))
    place = np.arange(len(at)) - first[owner]
    return at[mix(owner_hash[owner] + place.astype(np.uint64)) % np.uint64(rounds) == np.uint64(turn)]


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, word and n (occurrences) of every word of the corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            coded = _words(piece.column("text"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            hashes = _hashes(_bytes(coded.dictionary)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), coded.dictionary.cast(pa.string()), pa.array(n)], ["hash", "word", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "hash long, word string, n long")
    return rows.groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _bucket(hashes: Column) -> Column:
    return hashes.bitwiseAND(F.lit(HASHED - 1))


def vocabulary(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words, ties by the word, at most VOCABULARY less HASHED; occurrences and different words of each bucket."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - HASHED).collect()
    buckets = np.zeros((2, HASHED))
    for r in counts.groupBy(_bucket(F.col("hash")).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        buckets[:, r.b] = r.n, r.words
    for r in top:
        buckets[:, r["hash"] & (HASHED - 1)] -= r.n, 1
    return [r.word for r in top], buckets


def within_bucket(n: Column, size: Column, bucket: Column, buckets: np.ndarray) -> Column:
    """Log-probability of a word of ``size`` bytes and count ``n`` (null if the corpus lacks it) within its bucket.

    A bucket of N occurrences of T words leaves T + 1 parts of N + T + 1 to the words spelled out byte by byte, so
    a word the corpus lacks has a probability too, and those of a bucket sum to one at most.
    """
    def of(values: np.ndarray) -> Column:
        return F.get(F.array(*map(F.lit, values.tolist())), bucket)

    spelled = of(np.log(buckets[1] + 1)) - (size + 1) * float(np.log(SPELLED))
    return F.when(n.isNull(), spelled).otherwise(F.log(n + F.exp(spelled))) - of(np.log(buckets.sum(axis=0) + 1))


def encoded(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """doc_id (as text), key, n_tokens and ids (unsigned 16-bit numbers on end) of every document."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            texts = piece.column("text")
            ranks, counts, at, places, others = split_rare(texts, frequent)
            ids = ranks.astype(np.uint16)
            ids[at] = (VOCABULARY - HASHED + _hashes(others) % np.uint64(HASHED)).astype(np.uint16)[places]
            ends = np.concatenate([[0], np.cumsum(counts * ids.itemsize)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_text_keys(texts).view(np.int64)), pa.array(counts), packed],
                                             ["doc_id", "key", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(code, "doc_id string, key long, n_tokens long, ids binary"), "ids")


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint16).astype(np.int32)


def train_round(coded: DataFrame, groups: int, flat: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Parameters averaged over the groups, each trained on its own documents; one of ``rounds`` turns."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = flat.copy()
        p, grad, square, seen = parts(own), np.zeros_like(own), np.full_like(own, 1e-6), 0
        waiting, held = [], 0

        def step():
            nonlocal seen, held
            keys, ids = zip(*waiting, strict=True)
            waiting.clear()
            held = 0
            stream, at, owner = padded(ids)
            at = targets(np.array(keys, np.uint64), at, owner, turn, rounds)
            for i in range(0, len(at), 2 * STEP_POSITIONS):
                places = at[i : i + 2 * STEP_POSITIONS]
                gradient(p, stream, places, grad)
                np.add(square, grad * grad, out=square)
                own[:] += RATE * grad / np.sqrt(square)
                seen += len(places)

        for batch in batches:
            for key, packed in zip(batch["key"], batch["ids"], strict=True):
                waiting.append((key, _ids(packed)))
                held += len(waiting[-1][1])
                # About a step's positions of this turn, whatever the batches are.
                if held >= 2 * rounds * STEP_POSITIONS:
                    step()
        if held:
            step()
        if seen:
            yield pd.DataFrame({"positions": [seen], "change": [np.rint((own - flat).astype(np.float64) * FIXED_POINT).astype(np.int64)]})

    group = F.pmod(F.xxhash64("key", "doc_id"), F.lit(groups)).cast("int")
    dealt = coded.repartitionById(groups, group).sortWithinPartitions("key", "doc_id").select("key", "ids")
    rows = dealt.mapInPandas(local, "positions long, change array<long>")
    each = rows.select("positions", F.posexplode("change").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(20,0)") * F.col("positions").cast("decimal(18,0)")).alias("v"), F.sum("positions").alias("n"))
    # Whole numbers of any size, so the mean does not depend on the order and no sum runs over.
    got = each.select("i", (F.col("v").cast("double") / F.col("n")).alias("v")).toPandas()
    out = flat.copy()
    out[got["i"].to_numpy()] += (got["v"].to_numpy() / FIXED_POINT).astype(np.float32)
    return out


class Model:
    """The frequent words, the network, and for score() the counts of all words and of the buckets and the ids of the training texts."""

    def __init__(self, frequent: list[str], flat: np.ndarray, counts: DataFrame | None = None, buckets: np.ndarray | None = None,
                 coded: DataFrame | None = None):
        self.frequent, self.flat, self.counts, self.buckets, self.coded = frequent, flat, counts, buckets, coded

    def texts(self, ids: list[np.ndarray]) -> np.ndarray:
        """Summed log-probability of the ids of each text."""
        stream, at, owner = padded(ids)
        return np.bincount(owner, log_probabilities(parts(self.flat), stream, at), len(ids)) if len(at) else np.zeros(len(ids))


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    counts = stored(word_counts(docs), "words")
    frequent, buckets = vocabulary(counts)
    coded, flat = encoded(docs, frequent), start()
    words = coded.agg(F.sum("n_tokens")).first()[0] or 0
    groups = min(MAX_GROUPS, max(1, -(-words // GROUP_WORDS)))
    for turn in range(rounds):
        flat = train_round(coded, groups, flat, turn, rounds)
    return Model(frequent, flat, counts, buckets, coded)


def _bucket_terms(docs: DataFrame, model: Model) -> DataFrame:
    """key of each different text with words beyond the frequent ones, and ``own``: their summed log-probability within buckets.

    Sums are of whole numbers, so equal texts have equal sums; the lowest bit of a key marks one word of each row,
    which counts the rows of a text.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            texts = piece.column("text")
            _, counts, at, places, words = split_rare(texts, frequent)
            owner = np.repeat(np.arange(len(counts)), counts)[at]
            keys = _text_keys(texts)[owner] << np.uint64(1)
            keys[np.flatnonzero(np.diff(owner, prepend=-1))] |= np.uint64(1)
            order = np.argsort(places, kind="stable")
            firsts = np.flatnonzero(np.diff(places[order], prepend=-1))
            ends = pa.array(np.append(firsts, len(order)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(words).view(np.int64)), pa.array(np.fromiter(map(len, words), np.int64, len(words))),
                                              pa.ListArray.from_arrays(ends, pa.array(keys[order].view(np.int64)))], ["hash", "size", "keys"])

    frequent = model.frequent
    words = docs.select(text_or_empty().alias("text")).mapInArrow(gather, "hash long, size long, keys array<long>")
    met = words.join(model.counts.select("hash", "n").hint("merge"), "hash", "left")
    own = within_bucket(F.col("n"), F.col("size"), _bucket(F.col("hash")), model.buckets)
    each = met.select(F.rint(own * FIXED_POINT).cast("long").alias("own"), F.explode("keys").alias("key"))
    sums = each.groupBy(F.shiftrightunsigned("key", 1).alias("key")).agg(
        F.sum("own").alias("own"), F.sum(F.col("key").bitwiseAND(F.lit(1))).alias("rows"))
    return sums.select("key", (F.expr("own div rows") / FIXED_POINT).alias("own"))


def score(docs: DataFrame, model: Model, coded: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, pll (sum of log-probabilities) and mean_logprob.

    ``coded`` is the documents' :func:`encoded` table where there is one already, as a model has of its training texts.
    A text without words, null included, has a sum of 0 and no mean; repeated rows score alike; other columns
    are left out; an empty table gives an empty one.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Texts of about SCORED_IDS ids together.
            part = np.cumsum(batch["n_tokens"].to_numpy()) // SCORED_IDS
            for _, rows in batch.groupby(part, sort=False):
                yield pd.DataFrame({"doc_id": rows["doc_id"], "key": rows["key"], "n_tokens": rows["n_tokens"], "pll": texts(list(map(_ids, rows["ids"])))})

    # Tasks get the network alone: a table does not travel.
    texts = Model([], model.flat).texts
    rows = encoded(docs, model.frequent) if coded is None else coded
    scored = rows.mapInPandas(apply, "doc_id string, key long, n_tokens long, pll double").join(_bucket_terms(docs, model), "key", "left")
    scored = scored.withColumn("pll", F.col("pll") + F.coalesce("own", F.lit(0.0)))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "pll",
                         F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logprob"))
