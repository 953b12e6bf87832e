"""Quality classification by supervised subword embeddings.

A document is the average of learned vectors of its hashed features: character n-grams (2 to 4, over the text with runs of white space as one blank, and none in front), words and pairs of neighbouring words, and the shapes of words, alone and in pairs. A shape is the run-length-free sequence of character kinds in a word (capital, small, digit, other letter; any other character stands for itself), with a sign that says whether the word repeats the one before it or the one before that: a hashed word alone can't say so of words never seen. A linear softmax over the average gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy, on a sample bounded by `sample` labelled rows (those with the smallest hashes of their ids, each by all of its features, counted in Spark tasks; the fit is a task of its own); one sampled row in five is held out and sets the softmax's temperature. For prediction the vectors are put through the layer once, so that a text costs a look-up for each feature.

Defined results: a null text counts as empty; a text without a word has no feature and gets the score of the biases; texts of any length are read whole, in blocks of at most `BLOCK` characters that end after white space where they hold any (features don't reach across blocks), so memory is bounded; repeated rows get equal results; where labels of one id differ, the larger holds; labels other than 0 and 1, and labels without a document, don't count; where only one class is labelled, or none, every score is one half; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import column, in_one_task, map_batches, mix, texts

BUCKETS, DIM, ORDERS, SAMPLE, BLOCK = 1 << 16, 16, (2, 3, 4), 4000, 1 << 18
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
UNBASE = pow(BASE, -1, 1 << 64)
CAPITAL, SMALL, DIGIT, LETTER = 1, 2, 3, 4  # kinds of characters; no text has these control characters as words' usual parts
KNOWN_KINDS = 0x3000  # code points from here on count as letters


@functools.cache
def _kinds() -> np.ndarray:
    one = lambda c: CAPITAL if c.isupper() else SMALL if c.islower() else DIGIT if c.isdigit() else LETTER if c.isalpha() else ord(c) + 5
    return np.array([one(chr(c)) for c in range(KNOWN_KINDS)], np.uint64)


@functools.cache
def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK + 2, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _spans(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of x[start:end] for each span, from sums over x: equal content, equal hash, wherever it lies."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(BASE)[: len(x)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(UNBASE)[starts]


def blocks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in " \t\n\v\f\r")
            end = cut + 1 if cut >= at else end
        yield text[at:end]
        at = end


def features(text: str) -> np.ndarray:
    """The buckets of all features of one block; none if it has no word."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    if blank.all():
        return np.zeros(0, np.int32)
    keep = ~blank
    keep[1:] |= keep[:-1]  # of a run of white space the first stays
    a, blank = np.where(blank, np.uint32(32), a)[keep], blank[keep]
    c = a.astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        h = h[: max(0, len(c) - n + 1)] * np.uint64(BASE) + c[n - 1 :]
        if n in ORDERS:
            out.append(mix(h + np.uint64(n)))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mix(_spans(c, starts, ends))
    kind = _kinds()[np.minimum(a, KNOWN_KINDS - 1)]
    kind[a >= KNOWN_KINDS] = LETTER
    turn = ~blank
    turn[1:] &= (kind[1:] != kind[:-1]) | blank[:-1]
    at = np.concatenate([[0], np.cumsum(turn)])
    shapes = _spans(kind[turn], at[starts], at[ends])
    again = np.zeros(len(words), np.uint64)
    again[2:][words[2:] == words[:-2]] = 2
    again[1:][words[1:] == words[:-1]] = 1
    shapes = mix(shapes * np.uint64(4) + again)
    for salt, x in ((11, words), (13, shapes)):
        out += [mix(x + np.uint64(salt)), mix(x[:-1] * np.uint64(BASE) + x[1:] + np.uint64(salt + 1))]
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray | None = None  # log-odds of class 1 for each bucket: the vectors through the layer; None: unknown
    bias: float = 0.0
    temperature: float = 1.0

    def score(self, text: str) -> float:
        if self.table is None:
            return 0.5
        total, n = 0.0, 0
        for part in blocks(text):
            b = features(part)
            total += float(self.table.take(b).sum(dtype=np.float64))
            n += len(b)
        z = (total / max(1, n) + self.bias) / self.temperature
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


@dataclass
class Example:
    at: np.ndarray  # buckets
    share: np.ndarray  # of each
    label: int
    held: bool


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, x: Example) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one row's cross-entropy: by the vectors of its buckets (a row for each), the layer and the biases."""
    h = x.share @ e[x.at]
    z = h @ w + b
    p = np.exp(z - z.max())
    p /= p.sum()
    p[x.label] -= 1
    return np.outer(x.share, w @ p), np.outer(h, p), p


def fit(rows: list[Example], epochs: int = 8, rate: float = 0.5, lift: float = 20.0, seed: int = 11) -> Model:
    """One row a step, at a rate that falls to 0. A bucket's share of a text is small, so the vectors move `lift` times as fast as the layer. Rows that are held out choose the temperature, each counted as wrong by 1 in their number plus 2, so that a perfect separation doesn't end in certainty."""
    if len({r.label for r in rows}) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    train = [r for r in rows if not r.held]
    train = train if len({r.label for r in train}) == 2 else rows
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    for epoch in range(epochs):
        for k, i in enumerate(rng.permutation(len(train))):
            step = rate * (1 - (epoch + k / len(train)) / epochs)
            de, dw, db = gradients(e, w, b, train[i])
            e[train[i].at] -= (step * lift) * de
            w -= step * dw
            b -= step * 0.1 * db
    table, bias = (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])
    check = [r for r in rows if r.held] or rows
    z, y = np.array([r.share @ table[r.at] for r in check]) + bias, np.array([2 * r.label - 1 for r in check])
    ts, wrong = np.geomspace(0.05, 20, 60), 1 / (len(check) + 2)
    loss = [((1 - wrong) * np.logaddexp(0, -y * z / t) + wrong * np.logaddexp(0, y * z / t)).mean() for t in ts]
    return Model(table, bias, float(ts[int(np.argmin(loss))]))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, at, n) of at most `sample` labelled documents: the buckets of their features, and how often each occurs. The driver gets their ids and labels."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = y.join(rows.select("doc_id").hint("merge"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    label = {r["doc_id"]: r["label"] for r in known}

    def run(b):
        out = {n: [] for n in ("doc_id", "label", "at", "n")}
        for i, t in zip(column(b, "doc_id").to_pylist(), texts(b), strict=True):
            n = np.zeros(BUCKETS, np.int64)
            for part in blocks(t):
                n += np.bincount(features(part), minlength=BUCKETS)
            at = np.flatnonzero(n)
            for name, v in zip(out, (i, label[i], at.astype("<u2").tobytes(), n[at].astype("<u4").tobytes()), strict=True):
                out[name].append(v)
        return out

    return map_batches(rows.filter(F.col("doc_id").isin(list(label))), run, "doc_id long, label int, at binary, n binary")


def train(docs: DataFrame, labels: DataFrame, epochs: int = 8, **columns) -> Model:
    """Fit to what `sampled` gives, in one task; only the model comes to the driver."""

    def made(rows):
        rows.sort(key=lambda r: (r["doc_id"], r["at"], r["n"]))
        share = lambda n: (n / max(1, n.sum())).astype(np.float32)
        held = lambda i: bool(int(mix(np.array([i & (2**64 - 1)], np.uint64))[0]) % 5 == 0)
        return fit([Example(np.frombuffer(r["at"], "<u2").astype(np.int64), share(np.frombuffer(r["n"], "<u4")), r["label"], held(r["doc_id"])) for r in rows], epochs)

    return in_one_task(sampled(docs, labels, **columns), made) or Model()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted): the probability of label 1, and whether it reaches the threshold."""

    def run(b):
        s = [model.score(t) for t in texts(b, text_col)]
        return {"doc_id": column(b, id_col), "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, score double, predicted int")
