"""DartMinHash: the estimate, and classes against brute force over all pairs."""

from collections import Counter

import numpy as np
from texts import sentence

from vulnspark.llm import dart_minhash as dm
from vulnspark.llm import linking


def jaccard(a, b):
    def bag(t):
        w = t.split()
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def brute(rows):
    """class_id and class_size per id, by comparing every pair."""
    parent = {i: i for i in range(len(rows))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            same = (a or "").split() == (b or "").split()
            if same or ((a or "").split() and (b or "").split() and jaccard(a, b) >= dm.SIMILARITY):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_agreement_is_the_weighted_similarity(rng):
    hashes = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    a = (np.sort(hashes[:200]), np.array([1 + i % 5 for i in range(200)]))
    b = (np.sort(hashes[60:260]), np.array([1 + i % 3 for i in range(200)]))
    s = dm.signatures([a, b], 4000)
    both = {h: w for h, w in zip(*a, strict=True)}, {h: w for h, w in zip(*b, strict=True)}
    least = sum(min(both[0].get(h, 0), both[1].get(h, 0)) for h in {*both[0], *both[1]})
    assert abs(float((s[0] == s[1]).mean()) - least / (sum(a[1]) + sum(b[1]) - least)) < 0.03


def test_signature_does_not_depend_on_company(rng):
    sets = [(np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)), np.ones(n, np.int64)) for n in (1, 3, 50, 900)]
    together = dm.signatures(sets, 60)
    for i, s in enumerate(sets):
        assert (dm.signatures([s], 60)[0] == together[i]).all()


def test_classes_equal_brute_force(spark, docs_of, rng):
    rows = [(i, sentence(rng, 20 + 15 * i)) for i in range(12)]
    for i in range(12):
        rows += [(100 + 10 * i + j, edited(rng, rows[i][1], 1 + j)) for j in range(3)]
    # One large group whose members differ pairwise by more than they differ from the base.
    base = sentence(rng, 200)
    rows += [(1000 + j, edited(rng, base, 2)) for j in range(60)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1] + "  \n"), (2002, ""), (2003, None), (2004, "one two"), (2005, "one  two"), (2006, "\t")]
    got = {r.doc_id: (r.class_id, r.class_size) for r in dm.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_small_blocks_lose_no_link(spark, docs_of, rng, monkeypatch):
    """Copies of a text that is not there: some pairs are alike, no hub is alike to all."""
    monkeypatch.setattr(linking, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(dm, "BROADCAST_BYTES", 0)
    base = sentence(rng, 100)
    rows = [(j, edited(rng, base, 1 + j % 4)) for j in range(70)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in dm.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows) and len({c for c, _ in got.values()}) > 3


def test_forest_joins_what_pairs_join(rng):
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(20)], np.uint64)) for _ in range(40)]
    groups = [i // 2 for i in range(40)]
    links = linking.forest(sets, groups, 0.5)
    alike = [(i, j) for i in range(40) for j in range(i) if linking.alike(sets[i], sets[j], 0.5)]

    def parts(pairs):
        root = {g: g for g in groups}
        for _ in groups:
            for i, j in pairs:
                a, b = root[groups[i]], root[groups[j]]
                root = {g: min(a, b) if r in (a, b) else r for g, r in root.items()}
        return root

    assert parts(links) == parts(alike) and all(linking.alike(sets[i], sets[j], 0.5) for i, j in links) and len(links) < len(set(groups))


def test_survivors_keep_one_of_each_class(spark, docs_of, rng):
    base = sentence(rng, 80)
    rows = [(5, base), (3, base + " x"), (9, sentence(rng, 60)), (3, base + " x")]
    left = dm.survivors(docs_of(rows).selectExpr("*", "1 AS node", "'k' AS class_id"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 9]
    assert left.columns[-2:] == ["node", "class_id"]


def test_no_rows(spark, docs_of):
    assert dm.near_duplicates(docs_of([])).count() == 0
    assert dm.survivors(docs_of([])).count() == 0


def test_one_document_of_each_class_whatever_its_ids(spark, docs_of, rng):
    base, other = sentence(rng, 120), sentence(rng, 90)
    near = [edited(rng, base, 1) for _ in range(4)]
    rows = [(7, base), (7, near[0]), (None, near[1]), (None, near[2]), (9, near[3]), (3, other), (3, other), (4, other + " more")]
    got = sorted(((r.doc_id, r.text) for r in dm.survivors(docs_of(rows)).collect()), key=repr)
    assert len(got) == 2 and (3, other) in got
    (kept,) = [g for g in got if g[1] != other]
    assert kept[0] is None and kept[1] in near[1:3]
    told = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in dm.near_duplicates(docs_of(rows)).collect()}
    assert told == {(7, None, 5, False), (None, None, 5, True), (9, None, 5, False), (3, 3, 3, True), (4, 3, 3, False)}
