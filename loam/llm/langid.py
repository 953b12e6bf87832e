"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

The classifier is fitted on a sample bounded by `sample` labelled rows, chosen by a hash of their ids, each by all of its subwords; every text, whole, is predicted. One sampled row in five is held out. It calibrates the temperature, and, for texts of each length, the confidence below which a prediction is rejected: the lowest log-odds of a right prediction among held-out texts and snippets of that length, less a margin. So a short text of a known language needs little confidence, and a long text much.

Defined results: a text that is null or has no letter is `und` with score 0, and rejected; repeated rows get equal results; ties go to the language first in order; where no labelled row exists every text is `und`; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import arrow, column, in_one_task, map_batches, mix, texts

BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
SAMPLE = 3000
SNIPPETS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)  # letters; texts of at least so many, up to the next, are one band
MARGIN = 1.0


def letters(text: str) -> np.ndarray:
    """Lower-case letters' code points, with one 32 at every run of anything else and at both ends; empty if there is no letter."""
    low = text.lower()
    a = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = (a >= 97) & (a <= 122)
    wide = np.flatnonzero(a >= 170)
    if len(wide):
        kinds, at = np.unique(a[wide], return_inverse=True)
        ok[wide] = np.array([chr(c).isalpha() for c in kinds])[at]
    if not ok.any():
        return a[:0]
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    keep[0] = True
    return np.where(ok, a, 32)[keep]


def buckets(codes: np.ndarray, n: int = BUCKETS) -> np.ndarray:
    """Hashed buckets of all subwords of 1 to 4 characters; spaces mark word edges."""
    out, h = [], np.zeros(len(codes), np.uint64)
    c = codes.astype(np.uint64)
    for k in ORDERS:
        h = h[: len(c) - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :] + np.uint64(k)
        out.append((mix(h) % np.uint64(n)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, langs): the embeddings through the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: dict[int, float] = field(default_factory=dict)  # by band: the least log-odds of the best language

    def judge(self, text: str) -> tuple[str, float, bool]:
        """The language, its probability, and whether it is rejected."""
        c = letters(text)
        if not len(c) or not self.langs:
            return "und", 0.0, True
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(c), 1 << 16):  # bounded memory, whatever the text's length
            b = buckets(c[at : at + (1 << 16) + ORDERS[-1] - 1])
            total += self.table.take(b, 0).sum(0, dtype=np.float64)
            n += len(b)
        p = _softmax((total / n + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], min(1.0, float(p[best])), bool(_log_odds(p[best]) < self.reject_below.get(band(len(c)), -np.inf))


def band(size: int) -> int:
    return max((x for x in SNIPPETS if x <= size), default=0)


def _log_odds(p):
    return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-12))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Example:
    at: np.ndarray  # buckets
    share: np.ndarray  # of each
    lang: str
    size: int  # letters
    held: bool


def fit(rows: list[Example], epochs: int = 6, rate: float = 0.5, margin: float = MARGIN, seed: int = 7) -> Model:
    """Rows that are held out choose the temperature that makes them likeliest, and the log-odds needed in each band; a band without a right example takes the next shorter one's."""
    langs = sorted({r.lang for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    train = [r for r in rows if not r.held] or rows
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(langs)))
    b = np.zeros(len(langs))
    number = {x: i for i, x in enumerate(langs)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(train)):
            at, share = train[i].at, train[i].share
            near = e[at]
            h = share @ near
            p = _softmax((h @ w + b)[None])[0]
            p[number[train[i].lang]] -= 1
            g = w @ p
            w -= step * np.outer(h, p)
            b -= step * 0.1 * p
            near -= np.outer(share * min(step * 20, 10), g)
            e[at] = near
    table = (e @ w).astype(np.float32)
    check = [r for r in rows if r.held] or rows
    y, sizes = np.array([number[r.lang] for r in check]), np.array([band(r.size) for r in check])
    z = np.array([r.share @ table[r.at] + b for r in check])
    ts = np.geomspace(0.02, 5, 50)
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y], 1e-12)).mean() for t in ts]
    t = float(ts[int(np.argmin(losses))])
    p = _softmax(z / t)
    right, odds = p.argmax(1) == y, _log_odds(p.max(1))
    least, low = {}, -np.inf
    for size in (0, *SNIPPETS):
        seen = odds[right & (sizes == size)]
        low = float(seen.min()) - margin if len(seen) else low
        least[size] = low
    return Model(langs, table, b, t, least)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on the `sample` labelled rows with the smallest hashes of their ids. Tasks count the subwords, and cut snippets of held-out rows; one task fits the model to the counts of the sampled rows, and only the model comes to the driver."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = [r[0] for r in known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]

    def run(b):
        out = {n: [] for n in ("doc_id", "lang", "held", "size", "at", "n")}
        for i, lang, t in zip(column(b, "doc_id").to_pylist(), column(b, "lang").to_pylist(), texts(b), strict=True):
            c, seed = letters(t), zlib.crc32(str(i).encode())
            if not len(c):
                continue
            held = seed % 5 == 0
            rng = np.random.default_rng(seed)
            cuts = [c, *(c[at : at + k] for k in SNIPPETS if held and k < len(c) for at in rng.integers(0, len(c) - k, 2))]
            for x in cuts:
                if (x != 32).any():
                    u, n = np.unique(buckets(x), return_counts=True)
                    for name, v in zip(out, (i, lang, held, len(x), u.astype("<u2").tobytes(), n.astype("<u4").tobytes()), strict=True):
                        out[name].append(v)
        return out

    def made(rows):
        rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["size"], r["at"]))
        share = lambda n: (n / n.sum()).astype(np.float32)
        return fit([Example(np.frombuffer(r["at"], "<u2"), share(np.frombuffer(r["n"], "<u4")), r["lang"], r["size"], r["held"]) for r in rows])

    rows = map_batches(known.filter(F.col("doc_id").isin(ids)), run, "doc_id long, lang string, held boolean, size long, at binary, n binary")
    return in_one_task(rows, made) or fit([])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected)."""

    def run(b):
        lang, score, rejected = map(list, zip(*map(model.judge, texts(b, text_col)), strict=True))
        return {"doc_id": column(b, id_col), "lang_pred": lang, "score": score, "rejected": rejected}

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language isn't rejected."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([not model.judge(t or "")[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return arrow(docs, run, docs.schema)
