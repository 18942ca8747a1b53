"""Whitening against exact fractions and plain numpy on the same rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from vulnspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def frame(spark, vectors, ids=None):
    ids = ids or range(len(vectors))
    return spark.createDataFrame([(i, v, "other", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, k=4):
    whole = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(whole))
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(v[i] for v in fit), n) for i in range(d)]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    centred = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in whole])
    deviation = [int(sum((n * c - n * m) ** 2 for c, m in zip(v, mean, strict=True))) for v in whole]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(cov)


def test_matches_exact_fractions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()
    vectors += vectors[:5] + [vectors[7]] * 30
    n, deviation, scores, explained = brute(vectors)
    rows = whitening.whiten(frame(spark, vectors).repartition(5)).collect()
    assert len(rows) == 4 * len(vectors) and {r.n for r in rows} == {n}
    sign = {}
    for r in rows:
        want = scores[r.vec_id][r.component - 1]
        sign.setdefault(r.component, math.copysign(1, r.whitened * want))
        assert r.whitened == pytest.approx(sign[r.component] * want, abs=1e-8)
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-9


def test_numbers_beyond_64_bits_stay_exact(spark):
    vectors = [[1e12, 1.0], [-1e12, 2.0], [3e12, -1.0], [5e15, 0.0]]
    n, deviation, scores, explained = brute(vectors, 2)
    rows = whitening.whiten(frame(spark, vectors), components=1).collect()
    for r in rows:
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None)
        assert abs(r.whitened) == pytest.approx(abs(scores[r.vec_id][0]), rel=1e-9)
        assert r.explained == pytest.approx(explained[0], rel=1e-9)


def test_unsound_rows_null_ids_and_ragged_lengths(spark):
    vectors = [[1.0, 2.0], None, [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [3.0], [0.0, -0.0], [], [2.0, 5.0]]
    ids = [1, 2, 3, 4, 5, None, 7, 8, 7]
    rows = whitening.whiten(frame(spark, vectors, ids)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in rows) == sorted(
        (i is None, i or 0, c) for i in (1, None, 7, 8, 7) for c in (1, 2))
    n, deviation, _, _ = brute([[1, 2], [3, 0], [0, 0], [2, 5]], 2)
    assert {r.n for r in rows} == {n} and {r.deviation for r in rows if r.vec_id == 1} == {deviation[0]}


@pytest.mark.parametrize("vectors", [[], [[]], [[1.0, 2.0]] * 5, [None]])
def test_nothing_to_fit(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_does_not_depend_on_the_partitioning(spark):
    vectors = np.random.default_rng(5).normal(size=(80, 5)).astype(np.float32).tolist()
    got = [sorted((r.vec_id, r.component, r.deviation, round(r.whitened, 12)) for r in whitening.whiten(frame(spark, vectors).repartition(p)).collect())
           for p in (1, 7)]
    assert got[0] == got[1]
