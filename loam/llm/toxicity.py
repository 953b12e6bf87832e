"""Toxicity by maximum-scoring segments.

Features are words and their beginnings of 3 to 8 characters. Each gets its log-odds between toxic and other training rows, smoothed by a Dirichlet prior with the shape of all training counts; it is significant with log-odds of at least `LEAST` and a z-score of at least `Z`. A token scores the best of its significant features, so a feature that a shorter beginning betters is left out without any loss; any other token scores the log-ratio of the two classes' rates of such tokens, a small negative drift. One linear pass finds every maximal scoring segment of a text. Extreme-value (Karlin-Altschul) statistics of the background give each segment its expected number by chance (E-value), which makes scores comparable over lengths; passages are the segments with an E-value of at most `LEVEL`. A text's evidence is the best significance of its r best segments together, by the sum statistic, over all r; it becomes a probability by a logistic fit on the training rows.

Token counts are summed by Spark. The classifier's vocabulary is bounded by that of its training rows, which are all labelled ones up to `most_rows`, and an even sample by a hash of the ids where there are more. Defined results: null and empty texts have no tokens and get the base score; texts of any length take linear time; repeated rows get equal results; where no row is labelled every score is one half; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import column, map_batches, release, spill, texts

Z, LEAST, PRIOR = 3.0, 2.0, 10_000.0
PREFIXES = range(3, 9)
LEVEL, MOST_ROWS = 0.05, 1_000_000

_SPACE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-case UTF-8 words: runs of anything but ASCII punctuation, spaces and control characters."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one linear pass: each can't be bettered by lengthening or shortening, and they don't overlap."""
    found: list[list[float]] = []  # start, end, sum before, sum with
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        now = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4] if len(found[j]) > 4 else j - 1
            if j < 0 or found[j][3] >= now[3]:
                found.append([*now[:4], j])
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(int(a), int(b), d - c) for a, b, c, d, _ in found]


class Scores(dict):
    """Token scores; remembers those of up to 300,000 tokens."""

    def __init__(self, weights: dict[str, float], drift: float):
        super().__init__()
        self.weights, self.drift = weights, drift

    def __missing__(self, token: bytes) -> float:
        word = token.decode()
        w = self.weights
        best = max((w[f] for f in (word, *(word[:k] + "^" for k in PREFIXES if k <= len(word))) if f in w), default=self.drift)
        if len(self) < 300_000:
            self[token] = best
        return best


def evidence(x: list[float]) -> float:
    """-ln p of the best of all r by the sum statistic: x are the segments' scores, normalised so that exp(-x) is the E-value. The sum t of the r best exceeds its value by chance with probability exp(-t) t^(r-1) / (r! (r-1)!); each r counts as 2^r tests, since r is chosen after the scores are seen."""
    x = sorted(x, reverse=True)
    if not x:
        return 0.0
    best = x[0] if x[0] > 20 else max(0.0, -math.log(-math.expm1(-math.exp(min(-x[0], 3.0)))))
    t = x[0]
    for r in range(2, len(x) + 1):
        if x[r - 1] <= 0:
            break
        t += x[r - 1]
        best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.01
    lam: float = 1.0  # of exp(-lam * score): the root of E[exp(lam * s)] = 1 over background tokens
    rate: float = 1.0  # K: segments expected per background token at score 0
    slope: float = 0.0
    shift: float = 0.0

    def __post_init__(self):
        self.scores = Scores(self.weights, self.drift)

    def __reduce__(self):
        return Model, (self.weights, self.drift, self.lam, self.rate, self.slope, self.shift)

    def found(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence (-ln p, at least 0), and the significant segments."""
        words = tokens(text)
        s = np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words))
        hits = np.flatnonzero(s > 0)
        if not len(hits):
            return 0.0, []
        lo, hi = int(hits[0]), int(hits[-1]) + 1
        spans = [(a + lo, z + lo, v) for a, z, v in segments(s[lo:hi].tolist())]
        chance = math.log(self.rate * len(words))  # E-value at score 0
        return evidence([self.lam * v - chance for *_, v in spans]), [x for x in spans if chance - self.lam * x[2] <= math.log(LEVEL)]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log1p(evidence) + self.shift))))


def token_counts(rows: DataFrame) -> DataFrame:
    """rows: (text, label). (token, toxic, other): each task sums its batches, Spark the rest."""

    def run(b):
        n: dict[bytes, list[int]] = {}
        for t, y in zip(texts(b), column(b, "label").to_pylist(), strict=True):
            for w in tokens(t):
                n.setdefault(w, [0, 0])[y] += 1
        return {"token": list(n), "toxic": [x[1] for x in n.values()], "other": [x[0] for x in n.values()]}

    return map_batches(rows, run, "token binary, toxic long, other long", 5000).groupBy(F.col("token").cast("string").alias("token")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def feature_counts(counts: DataFrame) -> DataFrame:
    """Counts of words and of their beginnings, which end in ^."""
    starts = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k <= F.length("token")), lambda k: F.concat(F.substring(F.col("token"), F.lit(1), k), F.lit("^")))
    features = counts.select(F.explode(F.concat(F.array("token"), starts)).alias("feature"), "toxic", "other")
    return features.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def significant(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(feature, delta) of the significant features that no shorter beginning betters."""
    prior = (F.col("toxic") + F.col("other")) * F.lit(PRIOR / (n1 + n0))
    odds = lambda c, n: F.log((F.col(c) + prior) / (F.lit(float(n + PRIOR)) - F.col(c) - prior))
    scored = feature_counts(counts).filter("toxic > 0").select("feature", F.round(odds("toxic", n1) - odds("other", n0), 6).alias("delta"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior)).alias("sd"))
    kept = spill(scored.filter((F.col("delta") >= F.lit(Z) * F.col("sd")) & (F.col("delta") >= LEAST)).select("feature", "delta"), "significant")
    bare = F.regexp_replace("feature", r"\^$", "")
    longest = F.length("feature") - F.when(F.col("feature").endswith("^"), 2).otherwise(0)  # a beginning has only shorter ones, a word its own length too
    starts = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k <= longest), lambda k: F.concat(F.substring(bare, F.lit(1), k), F.lit("^")))
    above = kept.select("feature", "delta", F.explode(starts).alias("start")).join(kept.select(F.col("feature").alias("start"), F.col("delta").alias("has")), "start").filter("has >= delta")
    return kept.join(above.select("feature").distinct(), "feature", "left_anti")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Counts and calibration use the same labelled rows; rows without a label of 0 or 1 don't count. Labels of one id must agree; otherwise the larger holds."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    if (n := y.count()) > most_rows:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int(most_rows / n * (1 << 32))))
    # The labels grow with the documents, so the join is by a shuffle at every size; its rows are read twice, so they are written once.
    rows = spill(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(y.hint("merge"), "doc_id").select("text", "label"), "training")
    counts = spill(token_counts(rows), "tokens")
    n1, n0 = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first()
    if not n1 or not n0:
        return Model()
    best = significant(counts, n1, n0).orderBy("feature").collect()
    if not best:
        return Model()
    model = Model({r["feature"]: float(r["delta"]) for r in best})

    def hits(b):
        s = [model.scores[w.encode()] for w in column(b, "token").to_pylist()]
        return {"score": [round(x, 3) for x in s], "toxic": column(b, "toxic"), "other": column(b, "other")}

    levels = map_batches(counts, hits, "score double, toxic long, other long", 5000).filter("score > 0").groupBy("score").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()
    p1, p0 = sum(r["toxic"] for r in levels) / n1, sum(r["other"] for r in levels) / n0
    model = Model(model.weights, min(-1e-3, math.log(max(1e-6, 1 - p1) / (1 - p0))))
    background = [((r["other"] + 0.5) / n0, r["score"]) for r in levels]
    rest = 1 - sum(p for p, _ in background)
    mean = lambda lam: sum(p * math.exp(lam * s) for p, s in background) + rest * math.exp(lam * model.drift)
    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    model.lam = max(0.05, high)
    model.rate = max(1e-9, sum(p for p, _ in background))

    def run(b):
        e = [round(model.found(t)[0], 3) for t in texts(b)]
        return {"evidence": e, "label": column(b, "label")}

    by = map_batches(rows, run, "evidence double, label int").groupBy(F.round(F.log1p("evidence"), 2).alias("x")).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
    release(rows, counts)
    x = np.array([r["x"] for r in by for _ in range(2)])
    t = np.array([v for _ in by for v in (1.0, 0.0)])
    w = np.array([v for r in by for v in (r["pos"], r["n"] - r["pos"])], float)
    model.slope, model.shift = _weighted(x, t, w)
    return model


def _weighted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression over counts; the sums of Newton's method only need each distinct value once."""
    a, b = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6) * n
        g = np.array([(n * (p - y) * x).sum() + 1e-2 * a, (n * (p - y)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(max(0.0, a)), float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, n_segments, passages): passages are the significant segments as start:end:score over tokens, best first."""

    def run(b):
        s, n, spans = [], [], []
        for t in texts(b, text_col):
            e, found = model.found(t)
            s.append(model.score(e))
            n.append(len(found))
            spans.append(",".join(f"{a}:{z}:{v:.3f}" for a, z, v in sorted(found, key=lambda x: (-x[2], x[0]))))
        return {"doc_id": column(b, id_col), "score": s, "predicted": [int(x >= threshold) for x in s], "n_segments": n, "passages": spans}

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, score double, predicted int, n_segments long, passages string")
