"""Conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnspark.llm import conversation_trie as ct
from vulnspark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, n long"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(lists):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in lists.items():
        turns = tuple(turns)
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, who in members.items()), key=repr)


def lists_of(rows):
    """Turns of each conversation, null numbers first."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return out


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def made(rng, n=150):
    rows = []
    for c in range(n):
        if rng.random() < 0.3:
            talk = [("user", "same"), ("bot", "ï same")] + [("user", f"t{rng.randrange(3)}") for _ in range(rng.randrange(12))]
        elif rng.random() < 0.3:
            talk = [("user", "hello"), ("bot", "hi")]
        else:
            talk = [(rng.choice(["user", "bot"]), f"t{rng.randrange(4)}" * rng.randrange(3)) for _ in range(rng.randrange(6))]
        rows += [(c, i if i or rng.random() < 0.5 else None, r, t or None) for i, (r, t) in enumerate(talk)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=repr)


@pytest.mark.parametrize("partitions,piece", [(2, 4096), (8, 3), (60, 1)])
def test_equals_dictionary_of_prefixes(spark, rng, monkeypatch, partitions, piece):
    monkeypatch.setattr(ct, "PIECE", piece)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = made(rng)
        assert got(ct.nodes(ct.turn_lists(frame(spark, rows)))) == brute(lists_of(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_deep_shared_beginning(spark):
    talk = [("u", f"{i}") for i in range(70)]
    lists = {c: talk[: 40 + c % 30] + [("u", f"end {c}")] * (c % 3) for c in range(90)}
    rows = [(c, i, *t) for c, turns in lists.items() for i, t in enumerate(turns)]
    assert got(ct.nodes(ct.turn_lists(frame(spark, rows)))) == brute(lists)


def test_query_rebuilds_conversations(spark, tmp_path, rng):
    rows = [(c if c != 10 else None, *r) for c, *r in made(rng, 60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op11_conversation_trie(spark, str(tmp_path))) == brute(rebuilt(lists_of(rows)))


def test_edges(spark):
    assert got(ct.nodes(ct.turn_lists(frame(spark, [])))) == []
    turnless = spark.createDataFrame([(4, []), (2, [])], f"conv_id long, turns {ct.TURNS}")
    assert got(ct.nodes(turnless)) == brute({4: [], 2: []})
    rows = [(1, 0, None, "long " * 50_000), (1, 0, None, "long " * 50_000), (2, 0, "", "long " * 50_000), (3, None, "a", None)]
    assert got(ct.nodes(ct.turn_lists(frame(spark, rows)))) == brute(lists_of(rows))
    assert ct.nodes(ct.turn_lists(frame(spark, rows))).filter(F.col("depth") == 0).first().parent_node is None


def test_double_array_holds_all_and_nothing_else():
    rng = random.Random(5)
    sequences = [[rng.randrange(1, 60) for _ in range(rng.randrange(8))] for _ in range(400)]
    offsets = np.append(0, np.cumsum([len(s) for s in sequences]))
    trie = ct.pack(np.array([x for s in sequences for x in s], np.int64), offsets)
    known = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    assert (trie.check >= 0).sum() == len(known)
    states = {}
    for node in sorted(known, key=len):
        if node:
            states[node] = int(trie.step(np.array([states[node[:-1]]]), np.array([node[-1]]))[0])
            assert states[node] > 0 and trie.check[states[node]] == states[node[:-1]]
        else:
            states[node] = 0
    assert len(set(states.values())) == len(known)
    for _ in range(300):
        node = rng.choice(list(known))
        other = rng.randrange(1, 70)
        assert (trie.step(np.array([states[node]]), np.array([other]))[0] >= 0) == ((*node, other) in known)
