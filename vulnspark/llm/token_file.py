"""Token ids in fixed-width bit-packed files.

Ids are stored in the fewest bits that hold the vocabulary, low bit first,
as one stream for each shard. A shard is one row of a written table, so the
storage, the commit of finished tasks and the removal of failed attempts
are Spark's. The shard row is self-contained:

    part, shard          place of the shard; (part, shard) rises with document order
    bits, block_ids      bits of an id, ids of a full block
    n_ids                ids in the shard
    block_offset[]       byte at which each block begins in the payload
    doc_id[], n_tokens[] the documents in order, with their ids (end id included)
    payload              the blocks, each padded to a whole byte

Any id range is read by unpacking only the blocks it touches, each with a
few numpy operations. A shard ends with the first document that fills it,
so a reader holds at most ``SHARD_IDS`` ids and one document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnspark.llm.common import pieces

BLOCK_IDS = 8192
SHARD_IDS = 1 << 20
#: Bytes of text whose words are told apart together.
PIECE_BYTES = 8 << 20
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHED_WORDS = 400_000

SCHEMA = ("part int, shard int, bits int, block_ids int, n_ids long, block_offset array<long>, doc_id array<long>, "
          "n_tokens array<long>, payload binary")
ARROW_SCHEMA = pa.schema([*[(c, pa.int32()) for c in ("part", "shard", "bits", "block_ids")], ("n_ids", pa.int64()),
                          *[(c, pa.list_(pa.int64())) for c in ("block_offset", "doc_id", "n_tokens")], ("payload", pa.binary())])


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit stream, padded with zeros to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """Payload and the byte offset of each block."""
    blocks = [pack_block(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    return b"".join(blocks), [int(x) for x in offsets]


def read_ids(payload: bytes, offsets, bits: int, n_ids: int, start: int, count: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a shard; only the blocks that hold them are unpacked."""
    stop = min(start + count, n_ids)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // block_ids, (stop - 1) // block_ids
    parts = []
    for b in range(first, last + 1):
        n = min(block_ids, n_ids - b * block_ids)
        at = int(offsets[b])
        parts.append(unpack_block(payload[at : at + (n * bits + 7) // 8], bits, n))
    return np.concatenate(parts)[start - first * block_ids : stop - first * block_ids]


def byte_letters() -> dict[int, str]:
    """The character a byte-level vocabulary writes each byte as: visible Latin-1 as itself, others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}


class WordIds(dict):
    """Ids of white-space-free parts of texts as little-endian u32 bytes; a worker remembers those of their letters or signs.

    For the file word_bpe_49k.json and others with its steps: composing and lower-casing, white space dropped,
    then runs of letters, single digits and runs of other signs as separate units of the byte-level model. A
    part of plain letters with ASCII signs after it is therefore the ids of the letters and of the signs;
    the letters go straight to the library's model, everything else through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def __missing__(self, unit: str) -> bytes:
        """Ids of lower-case plain letters, or of anything that is not letters and signs."""
        if len(self) >= CACHED_WORDS:
            self.clear()
        if unit.isascii() and unit.isalpha():
            ids = [t.id for t in self.model.tokenize(unit)]
        elif self.PLAIN.fullmatch(unit):
            ids = [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        ids = self[unit] = array("I", ids).tobytes()
        return ids

    def part(self, part: str) -> bytes:
        ids = self.get(part)
        if ids is not None:
            return ids
        plain = self.PLAIN.fullmatch(part)
        if not plain:
            return self[part]
        return self[plain[1].lower()] + self[plain[2]] if plain[2] else self[plain[1].lower()]

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        return self.encode_all(pa.array([text]), 0)[0][:-1].tobytes()

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each with its end id, and how many each has; a part met twice is looked up once.

        Such a tokenizer joins nothing over a space or line feed.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        own = [*map(self.part, coded.dictionary.to_numpy(zero_copy_only=False)), array("I", [end_id]).tobytes()]
        ids = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        places = np.insert(coded.indices.to_numpy(), bounds[1:], len(own) - 1)
        sizes = sizes[places]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(before[-1]) + np.repeat(starts[places] - before[:-1], sizes)
        return ids[at], np.diff(before[bounds + np.arange(len(bounds))])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The tokenizer of a file, which a worker reads once for all its tasks."""
    return WordIds(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, compression: str = "uncompressed") -> None:
    """Encode doc_id and text and write the shards in ascending id order, ties by a hash of the text.

    A null text is empty and still gets its end id; a null id comes first and is kept as null; repeated rows
    are written again; an empty table writes a table without rows. Other columns are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = (rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie")
               .sortWithinPartitions("doc_id", "_tie").select(F.spark_partition_id().alias("part"), "doc_id", "text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        bits, shard = bits_for(max(known.vocabulary(), end_id + 1)), 0
        ids, doc_ids, lengths, size, part = [], [], [], 0, 0

        def flush():
            payload, offsets = pack(np.concatenate(ids), bits)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "bits": bits, "block_ids": BLOCK_IDS, "n_ids": size,
                                                "block_offset": offsets, "doc_id": doc_ids, "n_tokens": lengths, "payload": payload}], ARROW_SCHEMA)

        for piece in pieces(batches, PIECE_BYTES):
            part = piece.column("part")[0].as_py()
            stream, counts = known.encode_all(piece.column("text"), end_id)
            ends = np.cumsum(counts)
            for doc_id, n, end in zip(piece.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                ids.append(stream[end - n : end])
                doc_ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                lengths.append(n)
                size += n
                if size >= SHARD_IDS:
                    yield flush()
                    ids, doc_ids, lengths, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    ordered.mapInArrow(shards, SCHEMA).write.option("compression", compression).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """part, shard and ``first_id``, the ids before the shard in the whole corpus; two levels, so no task holds all shards."""
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_inside")).alias("first_id"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def documents(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, part, shard, start (in the shard), n_tokens, ids_crc32 (little-endian u32)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = read_ids(r.payload, r.block_offset, r.bits, r.n_ids, 0, r.n_ids, r.block_ids)
                n = np.asarray(r.n_tokens, np.int64)
                ends = np.cumsum(n)
                data = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_id), "Int64"), "part": r.part, "shard": r.shard, "start": ends - n, "n_tokens": n,
                                    "ids_crc32": [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]})

    return files.mapInPandas(decode, "doc_id long, part int, shard int, start long, n_tokens long, ids_crc32 long")


def take(files: DataFrame, start: int, count: int) -> np.ndarray:
    """``count`` ids of the corpus from the global position ``start``: only the shards that hold them are read."""
    places = starts(files).join(files.select("part", "shard", "n_ids"), ["part", "shard"])
    hit = places.filter((F.col("first_id") < start + count) & (F.col("first_id") + F.col("n_ids") > start))
    out = []
    for p in hit.orderBy("first_id").collect():
        row = files.filter((F.col("part") == p.part) & (F.col("shard") == p.shard)).first()
        at = max(0, start - p.first_id)
        out.append(read_ids(row.payload, row.block_offset, row.bits, row.n_ids, at, start + count - p.first_id - at, row.block_ids))
    return np.concatenate(out) if out else np.empty(0, np.uint32)
