"""The pipeline's stages, each against brute force on its own input, and run() against the stages."""

from collections import Counter

import numpy as np
import pytest
from test_dart_minhash import brute
from test_mixing import plain

import corpus_pipeline as cp
from vulnspark.llm import line_crf, piece_sampling
from vulnspark.llm.hashing import WordHashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with nulls, empty texts and repeated rows besides the given documents."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, None), (None, "a b c " * 20, "en", None, 3)], docs.schema)
    docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(docs.filter("doc_id = 7").selectExpr("9003 AS doc_id", "text", "lang", "NULL AS source", "n_chars")).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """(stage name, input, output) frames, written and read again as a driver does."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_but_the_last_return_documents(steps):
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert [n for n, _, _ in steps] == ["quality rules", "exact dedup", "near dedup", "mixing", "piece encoding"]


def test_quality(spark, folder, steps):
    _, before, after = steps[0]
    field, memory = line_crf.train(before, spark.read.parquet(f"{folder}/labels.parquet")), WordHashes()
    assert as_rows(after) == Counter(tuple(r) for r in before.collect() if line_crf.judge(r.text, field, memory)[-1])


def test_exact(steps):
    _, before, after = steps[1]
    best = {}
    for r in before.collect():
        key = (r.doc_id is not None, r.doc_id)
        if r.text not in best or key > best[r.text][0]:
            best[r.text] = (key, r)
    assert as_rows(after) == Counter(tuple(r) for _, r in best.values())
    assert before.count() > after.count()


def test_near(steps):
    _, before, after = steps[2]
    rows = before.collect()
    known = brute([(r.doc_id, r.text) for r in rows])
    assert as_rows(after) == Counter(tuple(r) for r in rows if known[r.doc_id][0] == r.doc_id)
    assert before.count() > after.count()


def test_mixing(steps):
    _, before, after = steps[3]
    rows = before.collect()
    taken = plain([(r.doc_id, r.text, r.source) for r in rows])
    want = Counter()
    for i, r in enumerate(rows):
        want[tuple(r)] += len(taken[i][3])
    assert as_rows(after) == +want


def test_pieces(steps):
    _, before, after = steps[4]
    voc = piece_sampling.vocabulary(cp.public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    assert sorted(voc.decode(np.array(r.ids)) for r in after.collect()) == sorted(r.text for r in before.collect())


def test_run_equals_the_stages(spark, folder, steps):
    assert as_rows(cp.run(spark, folder).drop("ids")) == as_rows(steps[-1][2].drop("ids"))
