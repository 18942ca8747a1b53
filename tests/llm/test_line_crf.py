"""Quality rules: base counts against plain Python, decoding against enumeration, held-out accuracy."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from texts import sentence

from vulnspark.llm import line_crf as lc
from vulnspark.llm.hashing import WordHashes

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a " * 30, "x|y<z># *$%&\nx|y<z># *$%&\n\n x|y<z># *$%&", "\u0085     é\n" * 12,
         "one two three four five six seven eight nine " * 2 + " ".join(f"w{i}" for i in range(60)), "\n".join(["same line here"] * 9), "😀 " * 25]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert lc.judge(text, None, WordHashes())[:6] == plain(text)


def test_base_counts_random(rng):
    memory = WordHashes()
    for n in (9, 40, 300):
        text = "\n".join(sentence(rng, rng.randrange(1, 12), words=6) for _ in range(n))
        assert lc.judge(text, None, memory)[:6] == plain(text)


def test_very_long_text(rng):
    text = sentence(rng, 300_000)
    assert lc.judge(text, None, WordHashes())[0] == 300_000


def test_viterbi_finds_the_best_of_all_labellings():
    r = np.random.default_rng(1)
    for n in range(1, 8):
        emit, step = r.normal(size=(n, 2)), r.normal(size=(2, 2))

        def score(y, emit=emit, step=step, n=n):
            return sum(emit[i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1))

        assert tuple(lc.viterbi(emit, step)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_expectations_equal_enumeration():
    r = np.random.default_rng(2)
    emit, step = r.normal(size=(5, 2)), r.normal(size=(2, 2))
    ways = list(itertools.product((0, 1), repeat=5))
    weight = np.array([np.exp(sum(emit[i, y[i]] for i in range(5)) + sum(step[y[i], y[i + 1]] for i in range(4))) for y in ways])
    weight /= weight.sum()
    marginal = np.array([[sum(w for w, y in zip(weight, ways, strict=True) if y[i] == c) for c in (0, 1)] for i in range(5)])
    pairs = np.array([[sum(w * sum(y[i : i + 2] == (a, b) for i in range(4)) for w, y in zip(weight, ways, strict=True)) for b in (0, 1)] for a in (0, 1)])
    got, both = lc._expectations([emit], step)
    assert np.allclose(got[0], marginal) and np.allclose(both, pairs)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = lc.verdicts(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    assert len(rows) > 100 and np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97


def test_same_as_row_by_row(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field, memory = lc.train(docs, labels), WordHashes()
    want = {r.doc_id: lc.judge(r.text, field, memory) for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in lc.verdicts(docs, labels).collect()}
    assert got == want


def test_no_rows_no_labels_and_other_columns(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    text = " ".join(f"w{i}." for i in range(40))
    docs = docs_of([(1, text), (2, None), (None, text), (1, text)]).selectExpr("*", "7 AS kept", "8 AS v")
    assert sorted(str(r.doc_id) for r in lc.keep(docs, labels).collect()) == ["1", "1", "None"]
    assert lc.keep(docs, labels).columns == docs.columns
    assert lc.verdicts(docs_of([]), labels).count() == 0
    assert [r.content for r in lc.content_lines(docs_of([(1, "a\n\nb")]), labels).collect()] == [True, True]
