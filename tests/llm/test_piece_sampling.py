"""Sampled segmentations: exact probabilities by enumeration, exact round trip, the same cut in any company."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vulnspark.llm import piece_sampling as ps

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  lead", "trail ", "a\tb\nc\r\n", "▁ literal ▁▁", "日本語 ünïcödé ß", "😀👩‍👩‍👧", "x" * 5000, "\x00\x1f\x7f\x85\xa0", "<s> </s> <unk> <0x41>", "é é"]


@pytest.fixture(scope="module")
def voc():
    return ps.vocabulary(MODEL, 1.0)


@pytest.fixture(scope="module")
def weights(voc):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {model.id_to_piece(i): voc.weight[i] for i in range(voc.size) if voc.weight[i] > 0}


def segmentations(text, weights):
    """Every segmentation with its weight."""
    if not text:
        return [((), 1.0)]
    return [((text[:k], *rest), weights[text[:k]] * w) for k in range(1, len(text) + 1) if text[:k] in weights for rest, w in segmentations(text[k:], weights)]


@pytest.mark.parametrize("text", ["then", "a test", "hello,the"])
def test_frequencies_equal_enumeration(voc, weights, text):
    n = 20000
    ways = segmentations("▁" + text.replace(" ", "▁"), weights)
    total = sum(w for _, w in ways)
    got = Counter(tuple(voc.data[i].decode().replace(" ", "▁") for i in ids) for ids in ps.segment(voc, [text] * n, np.arange(n, dtype=np.uint64)))
    assert set(got) <= {p for p, _ in ways}
    for pieces, w in ways:
        p = w / total
        assert abs(got[pieces] - n * p) < 5 * (n * p * (1 - p)) ** 0.5 + 1e-6 or n * p < 1


def test_cuts_are_where_no_piece_spans(voc, weights):
    codes = [ord(c) for c in "▁hello,▁worldé1"]
    number = voc.numbers(np.array(codes))
    spans = {a + b for p in weights for a, b in zip(p, p[1:], strict=False)}
    for a, b, x, y in zip(codes, codes[1:], number, number[1:], strict=False):
        if x < ps.COMMON and y < ps.COMMON:
            assert voc.joined[x, y] == (chr(a) + chr(b) in spans)


def test_round_trip_and_company(voc):
    keys = np.arange(len(ODD), dtype=np.uint64)
    together = ps.segment(voc, ODD, keys)
    for text, key, ids in zip(ODD, keys, together, strict=True):
        assert voc.decode(ids) == text
        assert (ps.segment(voc, [text], np.array([key]))[0] == ids).all()


def test_long_units_do_not_underflow(voc):
    text = "ab" * 20000
    assert voc.decode(ps.segment(voc, [text], np.array([1], np.uint64))[0]) == text


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = ps.encode(docs, MODEL)
    assert rows.filter("NOT lossless OR size(ids) <> n_pieces").count() == 0
    decoded = {r.doc_id: r.text for r in ps.decode(rows, MODEL).select("doc_id", "text").collect()}
    assert decoded == {r.doc_id: r.text for r in docs.collect()}
    again = {r.doc_id: r.ids_crc32 for r in ps.encode(docs.repartition(3), MODEL).collect()}
    assert again == {r.doc_id: r.ids_crc32 for r in rows.collect()}


def test_odd_rows(docs_of):
    rows = ps.encode(docs_of([(1, None), (2, ""), (None, "same text"), (None, "same text"), (3, "same text")]), MODEL).collect()
    assert [(r.n_pieces, r.lossless) for r in rows if r.doc_id in (1, 2)] == [(0, True)] * 2
    assert len({r.ids_crc32 for r in rows if r.doc_id is None}) == 1
    assert ps.encode(docs_of([]), MODEL).count() == 0
