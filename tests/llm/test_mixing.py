"""Mixing against a plain Python water-filling and numeric integration."""

import hashlib

import numpy as np
import pytest

from vulnspark.llm import mixing


def plain(rows, repeats=3, weights=(1, 2, 3)):
    """{doc index: (size, source_size, target, positions)} by loops."""
    sizes = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(sizes), set(sources)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= repeats * total[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: float(repeats * total[s]) for s in full}
        left -= sum(repeats * total[s] for s in full)
        open_ -= full
    out = {}
    for n, s in enumerate(sources):
        order = sorted((i for i, r in enumerate(rows) if r[2] == s),
                       key=lambda i: (hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest(), rows[i][0] is not None, rows[i][0] or 0, sizes[i]))
        at = 0
        for i in order:
            middles = [at + k * total[s] + sizes[i] / 2 for k in range(repeats)]
            out[i] = (sizes[i], total[s], target[s], [when(m / target[s], mixing.CURVES[n % 3]) for m in middles if sizes[i] and m <= target[s]])
            at += sizes[i]
    return out


def when(share, knots):
    grid = np.linspace(0, 1, 200001)
    rate = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
    passed = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    return float(np.interp(share, passed / passed[-1], grid))


def corpus(rng):
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(300)]
    return rows + [(400, None, "a"), (401, "", "empty"), (402, "x y", "tiny"), (None, "one two", "a"), (5, rows[5][1], rows[5][2])]


def test_plan_equals_plain_python(spark, docs_of, rng):
    rows = corpus(rng)
    docs = docs_of(rows).selectExpr("*", "size(array()) AS unused")
    got = mixing.plan(mixing.sized(docs)).collect()
    want = sorted(plain(rows).items())
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    a = sorted([(r.doc_id, r.size, r.source_size, r.target, list(r.positions)) for r in got], key=key)
    b = sorted([(rows[i][0], *v) for i, v in want], key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3]) and x[4] == pytest.approx(y[4], abs=1e-4)


def test_taken_words_come_near_the_targets(spark, docs_of, rng):
    rows = corpus(rng)
    got = mixing.plan(mixing.sized(docs_of(rows))).collect()
    for no in {r.source_no for r in got}:
        own = [r for r in got if r.source_no == no]
        assert abs(sum(r.size * len(r.positions) for r in own) - own[0].target) <= max(r.size for r in own)


def test_mix_is_in_training_order(spark, docs_of, rng):
    docs = docs_of(corpus(rng)).selectExpr("*", "1 AS size", "'x' AS positions", "2 AS offset")
    rows = mixing.mix(docs).collect()
    times = [r.position for r in rows]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    assert {r.size for r in rows} == {1} and {r.positions for r in rows} == {"x"}
    assert [r.doc_id for r in rows] == [r.doc_id for r in mixing.mix(docs.repartition(5)).collect()]


def test_schedule_shapes_the_time(spark, docs_of):
    docs = docs_of([(i, "w " * 10, "abc"[i % 3]) for i in range(900)])
    rows = mixing.mix(docs).collect()
    first = {s: np.mean([r.position < 0.5 for r in rows if r.source == s]) for s in "abc"}
    assert first["a"] == pytest.approx(0.625, abs=0.02) and first["b"] == pytest.approx(0.5, abs=0.02) and first["c"] == pytest.approx(0.3125, abs=0.02)


@pytest.mark.parametrize("knots", [[(0, 1), (0.5, 1)], [(0, 0), (1, 0)], [(0, 1), (0, 1), (1, 1)], [(0, -1), (1, 3)]])
def test_schedules_that_make_no_sense(knots):
    with pytest.raises(ValueError):
        mixing.check(knots)


def test_no_rows(docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and mixing.plan(mixing.sized(docs_of([]))).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")])).count() == 0
