"""Masked language model: scores against plain Python, gradients against differences, and what it learns."""

import numpy as np
import pytest

from vulnspark.llm import masked_lm as lm

SF = "/root/testdata/sf0.01"


def plain(p, ids):
    """Sum of log-probabilities, one word after the other."""
    def log_softmax(z):
        return z - np.log(np.exp(z).sum())

    around = [lm.PAD] * lm.SIDE + list(ids) + [lm.PAD] * lm.SIDE
    total = 0.0
    for i, word in enumerate(ids):
        ctx = around[i : i + lm.SIDE] + around[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]
        hidden = np.tanh(np.concatenate([p["embed"][c] for c in ctx]) @ p["inner"] + p["inner_bias"])
        k, w = divmod(int(word), lm.PER_CLASS)
        total += log_softmax(hidden @ p["klass"] + p["klass_bias"])[k] + log_softmax(hidden @ p["word"][k] + p["word_bias"][k])[w]
    return total


def test_scores_equal_plain_python(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 7)
    r = np.random.default_rng(3)
    model = lm.Model([], lm.start())
    ids = [r.integers(0, lm.VOCABULARY, n).astype(np.int32) for n in (0, 1, 2, 5, 40, 0)]
    want = [plain({k: v.astype(np.float64) for k, v in lm.parts(model.flat).items()}, x) for x in ids]
    assert np.allclose(model.texts(ids), want, rtol=1e-4, atol=1e-4)


def test_probabilities_sum_to_one():
    p = lm.parts(lm.start())
    stream = np.array([[lm.PAD, 5, w, 9, 4000] for w in range(lm.VOCABULARY)], np.int32).ravel()
    got = lm.log_probabilities(p, stream, np.arange(lm.VOCABULARY) * 5 + 2)
    assert abs(np.exp(got).sum() - 1) < 1e-4


def test_gradient_equals_differences():
    r = np.random.default_rng(4)
    flat = lm.start().astype(np.float64)
    stream = r.integers(0, lm.VOCABULARY, 60).astype(np.int32)
    at = np.arange(2, 58)
    grad = np.zeros_like(flat)
    lm.gradient(lm.parts(flat), stream, at, grad)
    strong = np.argsort(-np.abs(grad))[:400:20]
    for i in strong:
        low, high = flat.copy(), flat.copy()
        low[i] -= 1e-4
        high[i] += 1e-4
        slope = (lm.log_probabilities(lm.parts(high), stream, at).mean() - lm.log_probabilities(lm.parts(low), stream, at).mean()) / 2e-4
        assert abs(slope - grad[i]) < 1e-4 * max(1, abs(slope))


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, lm.train(docs.filter("doc_id % 4 <> 0"))


def test_frequent_words(spark, trained):
    docs, model = trained
    words = docs.filter("doc_id % 4 <> 0").selectExpr("explode(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) w")
    top = words.groupBy("w").count().orderBy("count", ascending=False).limit(50).collect()
    assert {r.w for r in top if r["count"] > top[-1]["count"]} <= set(model.frequent[:50])
    assert len(model.frequent) == lm.VOCABULARY - lm.HASHED


def test_held_out_text_beats_its_words_in_random_order(trained):
    docs, model = trained
    texts = [r.text for r in docs.filter("doc_id % 4 = 0").collect() if len(r.text.split()) > 30]
    known, r = lm.WordIds(model.frequent), np.random.default_rng(5)
    ids = [np.array([known[w] for w in t.encode().split()], np.int32) for t in texts]
    before = lm.Model(model.frequent, lm.start()).texts(ids)
    after, shuffled = model.texts(ids), model.texts([r.permutation(x) for x in ids])
    assert (after > before).mean() > 0.95
    # The made-up prose has a random word order; mixing languages within a window is what it must tell apart.
    mixed = [r.permutation(np.concatenate([a, b])) for a, b in zip(ids, ids[1:], strict=False)]
    apart = after[:-1] + after[1:]
    assert apart.sum() > model.texts(mixed).sum() and after.sum() > shuffled.sum() - 0.02 * abs(shuffled.sum())


def test_odd_rows(docs_of, trained):
    model = trained[1]
    got = lm.score(docs_of([(1, None), (2, ""), (3, " \n"), (None, "the of"), (4, "the of"), (5, "x" * 100_000 + " the")]), model).collect()
    by = {r.doc_id: r for r in got}
    assert [(by[i].n_tokens, by[i].pll, by[i].mean_logprob) for i in (1, 2, 3)] == [(0, 0.0, None)] * 3
    assert by[None].pll == by[4].pll < 0 and by[5].n_tokens == 2


def test_no_rows(docs_of):
    empty = docs_of([])
    model = lm.train(empty)
    assert model.frequent == [] and (model.flat == lm.start()).all() and lm.score(empty, model).count() == 0


def test_every_word_has_its_own_probability(docs_of, trained, spark):
    docs, model = trained
    counts = {r.word: r.n for r in model.counts.collect()}
    fixed, buckets = set(model.frequent), {}
    bucket = lambda w: lm.xxhash.xxh3_64_intdigest(w.encode()) % lm.HASHED
    for w, n in counts.items():
        if w not in fixed:
            own = buckets.setdefault(bucket(w), {})
            own[w] = n
    b = next(b for b, own in buckets.items() if len(set(own.values())) > 1)
    common, rare = max(buckets[b], key=buckets[b].get), min(buckets[b], key=buckets[b].get)
    unseen = next(w for w in (f"zq{i}" for i in range(100_000)) if bucket(w) == b and w not in counts)
    texts = [f"the {common} of", f"the {rare} of {rare}", f"the {unseen} of", "the of"]
    got = {r.doc_id: r.pll for r in lm.score(docs_of([*enumerate(texts), (9, texts[1])]), model).collect()}
    assert got[0] > got[2] and got[9] == got[1]

    def within(word):
        n, kinds = sum(buckets[b].values()), len(buckets[b])
        return np.log((buckets[b].get(word, 0) + (kinds + 1) * float(lm.SPELLED) ** -(len(word.encode()) + 1)) / (n + kinds + 1))

    known = lm.WordIds(model.frequent)
    for i, t in enumerate(texts):
        words = t.split()
        net = model.texts([np.array([known[w.encode()] for w in words], np.int32)])[0]
        assert abs(got[i] - net - sum(within(w) for w in words if w not in fixed)) < 1e-4
    assert sum(np.exp(within(w)) for w in buckets[b]) < 1


def test_every_position_is_a_target_once_whatever_its_neighbours():
    r = np.random.default_rng(6)
    ids = [r.integers(0, 50, n).astype(np.int32) for n in (3, 0, 200, 1, 90)]
    hashes = np.array([lm.xxhash.xxh3_64_intdigest(x.tobytes()) for x in ids], np.uint64)

    def dealt(which, turn):
        _, at, owner = lm.padded([ids[i] for i in which])
        own = lm.targets(hashes[which], at, owner, turn, 3)
        text = owner[np.searchsorted(at, own)]
        return {(which[t], int(p - at[np.searchsorted(owner, t)])) for p, t in zip(own, text, strict=True)}

    turns = [dealt([0, 1, 2, 3, 4], t) for t in range(3)]
    assert sum(map(len, turns)) == len(set().union(*turns)) == sum(map(len, ids))
    assert turns == [dealt([4, 2, 1, 3, 0], t) for t in range(3)] and all(len(t) > 50 for t in turns)


def test_words_of_odd_texts():
    texts = ["", " a\x0bb\x1c c\x0c\r\n", "a", "\u00a0x \u2003 y\u0085", "  "]
    places, counts, words = lm.split_words(lm.pa.array(texts))
    want = [t.encode().split() for t in texts]
    assert [words[i] for i in places] == [w for t in want for w in t] and counts.tolist() == list(map(len, want))
    none, counts, words = lm.split_words(lm.pa.array([], lm.pa.string()))
    assert len(none) == len(counts) == len(words) == 0


def test_the_same_model_however_the_table_is_cut(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_WORDS", 40_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = [lm.train(docs.repartition(n)) for n in (1, 4, 32)]
    assert all((m.flat == models[0].flat).all() and m.frequent == models[0].frequent for m in models)
    assert not (models[0].flat == lm.start()).all()
    one, other = ({r.doc_id: r.pll for r in lm.score(d, models[0], m).collect()} for d, m in ((docs, None), (docs.repartition(5), models[1].coded)))
    assert one.keys() == other.keys() and np.allclose([one[i] for i in one], [other[i] for i in one], rtol=1e-6)


def test_only_words_that_are_not_frequent_are_told_apart():
    texts, frequent = ["", "the odd of the", " \t", "odd odder the\n\nof"], ["the", "of"]
    ranks, counts, at, places, others = lm.split_rare(lm.pa.array(["left out", *texts]).slice(1), frequent)
    assert counts.tolist() == [0, 4, 0, 4] and others == [b"odd", b"odder"]
    assert at.tolist() == [1, 4, 5] and places.tolist() == [0, 0, 1]
    ids = ranks.copy()
    ids[at] = [lm.WordIds(frequent)[others[i]] for i in places]
    assert ids.tolist() == [lm.WordIds(frequent)[w.encode()] for t in texts for w in t.split()]
    ranks, counts, at, places, others = lm.split_rare(lm.pa.array([], lm.pa.string()), [])
    assert len(ranks) == len(counts) == len(at) == len(places) == len(others) == 0
