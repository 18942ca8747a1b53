"""Exact dedup against dictionaries, with digests that collide as well."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vulnspark.llm import exact_dedup as ed

ROWS = [(1, "a"), (2, "a"), (3, "a "), (4, ""), (5, None), (6, "A"), (7, "a"), (None, "a"), (None, "b"), (9, "é"), (10, "é"), (7, "a"), (11, "x" * 100_000)]


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        own = groups[t or ""]
        best = max((x for x in own if x is not None), default=None)
        out.append((d, best, len(own), d == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [ed.sha256, lambda t: F.pmod(F.length(t), F.lit(2)), lambda t: F.lit(0)])
def test_verdicts(docs_of, digest):
    got = ed.verdicts(docs_of(ROWS).repartition(6), salts=3, digest=digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=repr) == plain(ROWS)


@pytest.mark.parametrize("digest", [ed.sha256, lambda t: F.lit(0)])
def test_survivors_keep_all_columns(docs_of, digest):
    docs = docs_of(ROWS).selectExpr("*", "'z' AS keep_id", "map(1, 2) AS m", "doc_id AS _digest").drop("m")
    got = ed.survivors(docs, digest=digest)
    assert got.columns == docs.columns
    rows = {r.text: (r.doc_id, r.keep_id, r._digest, r.lang) for r in got.collect()}
    assert {(t or "") for t in rows} == {t or "" for _, t in ROWS} and len(rows) == len({t or "" for _, t in ROWS})
    assert rows["a"] == (7, "z", 7, "en") and rows["b"] == (None, "z", None, "en") and rows.get(None, rows.get(""))[0] == 5


def test_hot_group_is_never_gathered(spark, docs_of):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS text").repartition(40)
    rows = ed.verdicts(docs).filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(rows) == (6667, 19998, 19998, 1)


def test_no_rows(docs_of):
    assert ed.verdicts(docs_of([])).count() == 0 and ed.survivors(docs_of([])).count() == 0
