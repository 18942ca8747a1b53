"""Quality rules with line labels from a linear-chain conditional random field.

Base rules on word counts and repetition come first. The lines of what is
left are labelled content or boilerplate: each line has a few features, the
field scores a label by the line's features and by the label before it, and
Viterbi decoding finds the best labelling of the whole text. A document is
kept if enough of its characters stand in content lines.

There are labels for documents, not for lines. A logistic model first learns
from lines that carry their document's label; the lines it takes for the
other kind change sides; the field is then trained on those sequences by
exact gradients (forward-backward). Both see only TRAIN_DOCS labelled
documents, the first by the MD5 of the id; every other step sees all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import text_or_empty, words_of
from vulnspark.llm.hashing import WordHashes, runs

TRAIN_DOCS = 2000
MIN_CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
BOILERPLATE, CONTENT = 0, 1
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"

VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "content_share double, kept boolean")

#: Kinds of characters, one bit each; characters beyond the table count as other.
_BLANK, _SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT = (1 << i for i in range(6))
_TABLE = np.zeros(0x2000, np.uint8)
for _c in range(len(_TABLE)):
    _s = chr(_c)
    _TABLE[_c] = (_BLANK * (_s in BLANK) | _SYMBOL * (_s in SYMBOLS) | _UPPER * _s.isupper() | _LOWER * (_s.isalpha() and not _s.isupper())
                  | _DIGIT * _s.isdigit() | _SHOUT * (_s in "!?"))

FEATURES = ("always", "symbols", "upper", "digits", "shouts", "short", "long", "ends in a full stop", "repeated", "one word in a cell")


def kinds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their kinds."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return points, _TABLE[np.minimum(points, len(_TABLE) - 1)]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of each line that has a word, its characters, and how many of those lines equal an earlier one."""
    lines = text.split("\n")
    points, kind = kinds(text)
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = ends - np.array([len(x) + 1 for x in lines])
    counted = {}
    for bit in (_BLANK, _SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT):
        total = np.concatenate([[0], np.cumsum((kind & bit) != 0)])
        counted[bit] = total[np.minimum(ends - 1, len(points))] - total[starts]
    pipes = np.concatenate([[0], np.cumsum(points == ord("|"))])
    pipes = pipes[np.minimum(ends - 1, len(points))] - pipes[starts]
    n = ends - starts - 1
    full = n > counted[_BLANK]
    seen: set[str] = set()
    repeated = np.zeros(len(lines), bool)
    for i in np.flatnonzero(full):
        repeated[i] = lines[i] in seen
        seen.add(lines[i])
    n, repeated = n[full], repeated[full]
    c = {k: v[full] for k, v in counted.items()}
    shown = np.maximum(n - c[_BLANK], 1)
    words = c[_BLANK] + 1
    stop = np.array([lines[i].rstrip(BLANK)[-1] in ".!?" for i in np.flatnonzero(full)], bool) if full.any() else np.zeros(0, bool)
    out = np.stack([np.ones(len(n)), np.minimum(1, 4 * c[_SYMBOL] / shown), c[_UPPER] / np.maximum(c[_UPPER] + c[_LOWER], 1), c[_DIGIT] / shown,
                    np.minimum(1, 4 * c[_SHOUT] / shown), np.exp(-n / 20), np.minimum(1, n / 400), stop, repeated,
                    np.minimum(1, 3 * pipes[full] / words)], axis=1) if len(n) else np.zeros((0, len(FEATURES)))
    return out, n, int(repeated.sum())


def viterbi(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels for the scores ``emit`` (lines x 2) and ``step`` (label before, label); ties take boilerplate."""
    if not len(emit):
        return np.zeros(0, np.int8)
    (s00, s01), (s10, s11) = step.tolist()
    rows = emit.tolist()
    a, b = rows[0]
    back = []
    for ea, eb in rows[1:]:
        fa, fb = b + s10 > a + s00, b + s11 > a + s01
        back.append((fa, fb))
        a, b = (b + s10 if fa else a + s00) + ea, (b + s11 if fb else a + s01) + eb
    out = np.empty(len(rows), np.int8)
    out[-1] = label = int(b > a)
    for i in range(len(rows) - 2, -1, -1):
        out[i] = label = int(back[i][label])
    return out


class Field:
    """Weights (features x 2) and steps (2 x 2)."""

    def __init__(self, weights: np.ndarray, step: np.ndarray):
        self.weights, self.step = weights, step

    def labels(self, features: np.ndarray) -> np.ndarray:
        return viterbi(features @ self.weights, self.step)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights by Newton steps' cheap cousin: full-batch gradient with momentum, both classes weighing the same."""
    share = np.where(y == CONTENT, 0.5 / max((y == CONTENT).sum(), 1), 0.5 / max((y != CONTENT).sum(), 1))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 2.0 * (x.T @ (share * (p - y)) + 1e-4 * w)
        w = w + speed
    return w


def _expectations(emit: list[np.ndarray], step: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of labels of each line, and of label pairs over all, by forward-backward on probabilities scaled line by line."""
    trans, pairs, out = np.exp(step), np.zeros((2, 2)), []
    for e in emit:
        p = np.exp(e - e.max(axis=1, keepdims=True))
        fore, aft = np.empty_like(p), np.ones_like(p)
        fore[0] = p[0] / p[0].sum()
        for i in range(1, len(p)):
            f = (fore[i - 1] @ trans) * p[i]
            fore[i] = f / f.sum()
        for i in range(len(p) - 2, -1, -1):
            b = trans @ (p[i + 1] * aft[i + 1])
            aft[i] = b / b.sum()
        m = fore * aft
        out.append(m / m.sum(axis=1, keepdims=True))
        if len(p) > 1:
            joint = fore[:-1, :, None] * trans[None] * (p[1:] * aft[1:])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, pairs


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 40) -> Field | None:
    """A field from (line features, document label) rows; None if only one label occurs."""
    sequences = [(x, int(y)) for x, y in sequences if len(x)]
    if len({y for _, y in sequences}) < 2:
        return None
    x = np.concatenate([s for s, _ in sequences])
    y = np.concatenate([np.full(len(s), label) for s, label in sequences])
    w = _logistic(x, y)
    lines = [(s @ w > 0).astype(int) for s, _ in sequences]
    weights, step = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    weights[:, CONTENT] = w / 2
    weights[:, BOILERPLATE] = -w / 2
    hot = [np.eye(2)[l] for l in lines]
    seen = sum((np.array([[((l[:-1] == a) & (l[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)]) for l in lines), np.zeros((2, 2)))
    total = len(x)
    speed_w, speed_s = np.zeros_like(weights), np.zeros_like(step)
    for _ in range(rounds):
        marginal, pairs = _expectations([s @ weights for s, _ in sequences], step)
        grad = x.T @ (np.concatenate(hot) - np.concatenate(marginal)) / total - 1e-3 * weights
        speed_w = 0.8 * speed_w + grad
        speed_s = 0.8 * speed_s + (seen - pairs) / total - 1e-3 * step
        weights, step = weights + speed_w, step + speed_s
    return Field(weights, step)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Field | None:
    """A field from the first ``limit`` labelled documents by the MD5 of the id; only their line features reach the driver."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [line_features(t)[0].astype("<f4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "data": data})

    got = rows.mapInPandas(features, "doc_id long, quality int, data binary").toPandas()
    got = got.sort_values(["doc_id", "data"], kind="stable")
    return fit([(np.frombuffer(d, "<f4").reshape(-1, len(FEATURES)).astype(np.float64), q) for d, q in zip(got["data"], got["quality"], strict=True)])


def repeated_words(words: list[bytes], memory: WordHashes) -> int:
    """Words covered by runs of REPEAT_WINDOW words that occur twice or more in the text."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    hashes = runs(memory.of(words), REPEAT_WINDOW)
    found = np.sort(hashes)
    twice = found[1:][found[1:] == found[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(hashes, twice))
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i in starts.tolist():  # equal hashes are settled on the words themselves
        places.setdefault(tuple(words[i : i + REPEAT_WINDOW]), []).append(i)
    gone = np.zeros(len(words) + 1, np.int64)
    for own in places.values():
        if len(own) > 1:
            at = np.array(own)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(gone) > 0).sum())


def judge(text: str | None, field: Field | None, memory: WordHashes, min_share: float = MIN_CONTENT_SHARE) -> tuple:
    text = text or ""
    words = words_of(text)
    _, kind = kinds(text)
    features, chars, n_dup = line_features(text)
    n_repeat = repeated_words(words, memory)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    labels = field.labels(features) if field is not None else np.ones(len(features), np.int8)
    share = float(chars[labels == CONTENT].sum() / chars.sum()) if len(chars) else 0.0
    return (len(words), int((kind & _BLANK == 0).sum()), int((kind & _SYMBOL != 0).sum()), n_dup, n_repeat, failed, share, not failed and share >= min_share)


def verdict(field: Field | None, text: Column | str = "text") -> Column:
    """The verdict struct of a text column; a null text is an empty one, which fails."""
    @F.pandas_udf(VERDICT)
    def rule(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        columns = [c.split()[0] for c in VERDICT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([judge(t, field, memory) for t in texts], columns=columns)

    return rule(text_or_empty(text))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id and the verdict's columns.

    Repeated rows are judged alike; without labels of both kinds every line is content; an empty table gives
    an empty one; other columns are left out.
    """
    return docs.select("doc_id", verdict(train(docs, labels)).alias("v")).select("doc_id", "v.*")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with every column."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), verdict(train(docs, labels)).alias("_v"))
    return packed.filter("_v.kept").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def content_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and whether the line is content, for every line with a word."""
    field = train(docs, labels)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                numbers = [i for i, x in enumerate(text.split("\n")) if x.strip(BLANK)]
                features = line_features(text)[0]
                labels_ = field.labels(features) if field is not None else np.ones(len(features), np.int8)
                yield pd.DataFrame({"doc_id": doc_id, "line_no": numbers, "content": labels_ == CONTENT})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(label, "doc_id string, line_no long, content boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
