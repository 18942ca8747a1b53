"""Packed token files: every text against the tokenizer itself, exact round trip, random access."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vulnspark.llm import token_file as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 9, 16, 17, 31, 32])
def test_blocks_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    data, offsets = tf.pack(ids, bits, 64)
    assert len(data) <= (len(ids) * bits + 7) // 8 + len(offsets)
    for start, count in ((0, 1000), (63, 2), (64, 64), (999, 50), (1000, 5), (130, 700)):
        assert (tf.read_ids(data, offsets, bits, len(ids), start, count, 64) == ids[start : start + count]).all()


def test_fewest_bits():
    assert [tf.bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


ODD = [None, "", " \t\n", "don't I'LL we've 's 'S can'tx", "A-B c_d 12ab3 x²½", "é Été ÉTÉ İstanbul ẞ ß", "tab\tand\r\nfeed\x0bvt\x1c\x85\xa0end",
       "<|endoftext|> a<|startoftext|>b <|EndOfText|>", "日本語テキスト と english", "😀👩‍👩‍👧 ok!!!...", "ŀ ﬁ ﬀ Å Å", "foo,bar foo, (foo) \"foo\"", "́ á, ´a a´!"]


def test_odd_texts_equal_the_tokenizer(plain):
    known = tf.WordIds(PATH)
    for text in ODD:
        assert np.frombuffer(known.encode(text or ""), "<u4").tolist() == plain(text), text


def test_texts_together_equal_the_tokenizer(plain, monkeypatch):
    known, met, texts = tf.WordIds(PATH), [], [t or "" for t in ODD] + ["Foo foo, foo\nbar", "bar " * 50]
    monkeypatch.setattr(known, "part", lambda part, of=known.part: met.append(part) or of(part))
    ids, sizes = known.encode_all(pa.array(["left out", *texts]).slice(1), 7)
    assert [own.tolist() for own in np.split(ids, np.cumsum(sizes))[:-1]] == [[*plain(t), 7] for t in texts]
    # A part is looked up once however often it occurs.
    assert len(met) == len(set(met)) and "bar" in met and "left" not in met


def test_a_worker_reads_the_tokenizer_once():
    assert tf.word_ids(PATH) is tf.word_ids(PATH)


def test_every_text_equals_the_tokenizer(plain):
    known = tf.WordIds(PATH)
    for text in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        assert np.frombuffer(known.encode(text), "<u4").tolist() == plain(text)


def test_files(spark, docs_of, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_IDS", 50)
    rows = [(i * 7 % 40, t) for i, t in enumerate(ODD)] + [(None, "null id"), (100, "w " * 9000), (101, "same"), (101, "same")]
    tf.write(docs_of(rows), str(tmp_path / "ids"), PATH, end_id=1)
    files = tf.read(spark, str(tmp_path / "ids"))
    docs = tf.documents(files).join(tf.starts(files), ["part", "shard"]).selectExpr("doc_id", "first_id + start AS start", "n_tokens", "ids_crc32").collect()
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text) + [1]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, docs), key=repr) == sorted(want, key=repr)
    stream = [i for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*plain(t), 1]]
    for start, count in ((0, 10), (45, 120), (len(stream) - 3, 100), (0, len(stream)), (len(stream), 4)):
        assert tf.take(files, start, count).tolist() == stream[start : start + count]


def test_no_rows(spark, docs_of, tmp_path):
    tf.write(docs_of([]), str(tmp_path / "ids"), PATH, end_id=1)
    files = tf.read(spark, str(tmp_path / "ids"))
    assert tf.documents(files).join(tf.starts(files), ["part", "shard"]).count() == 0
    assert len(tf.take(files, 0, 5)) == 0
