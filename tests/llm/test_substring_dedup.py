"""Substring dedup against brute force over all windows."""

import hashlib

import pytest
from texts import sentence

from vulnspark.llm import substring_dedup as sd


def brute(rows):
    words = [(-1 if d is None else d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - sd.WINDOW + 1):
            key = tuple(w[i : i + sd.WINDOW])
            least[key] = min(least.get(key, d), d)
    out = []
    for (d, w), (own, _) in zip(words, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - sd.WINDOW + 1):
            if least[tuple(w[i : i + sd.WINDOW])] < d:
                gone[i : i + sd.WINDOW] = [True] * sd.WINDOW
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((own, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,references", [(sd.SHARD, 32), (2, 32), (2, 1)])
def test_equals_brute_force(spark, docs_of, rng, monkeypatch, shard, references):
    monkeypatch.setattr(sd, "REFERENCES", references)
    shared = [sentence(rng, n) for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(40):
        parts = [sentence(rng, rng.randrange(90))] + [x for s in rng.sample(shared, 2) for x in (s, sentence(rng, rng.randrange(60)))]
        rows.append((i, " ".join(parts)))
    cycle = " ".join(f"c{i % 3}" for i in range(160))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "\n"), (52, cycle), (53, "x " + cycle + " c0"), (54, None), (55, ""), (56, "a b"), (57, "a b"),
             (3, rows[3][1]), (7, rows[9][1]), (None, rows[20][1]), (60, "ein Wort \u0085 x " + shared[4])]
    got = sd.dedup(docs_of(rows), shard).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_kept_text(spark, docs_of, rng):
    a = sentence(rng, 120)
    got = {r.doc_id: r.kept_text for r in sd.dedup(docs_of([(1, a), (2, "first " + a + " last")])).collect()}
    assert got == {1: None, 2: "first last"}


def test_no_rows(spark, docs_of):
    assert sd.dedup(docs_of([])).count() == 0


def test_automaton_matches():
    a = sd.SuffixAutomaton()
    a.add(["a", "b", "c"])
    a.add(["c", "a", "b", "d"])
    assert a.matching(["x", "b", "c", "a", "b", "d", "a", "b", "c"]) == [0, 1, 2, 2, 3, 4, 1, 2, 3]
