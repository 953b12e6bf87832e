"""The quality classifier: features and scores against plain loops, gradients against differences, and held-out accuracy."""

import math
import random

import numpy as np
import pytest

from loam.llm import quality as q

M = 1 << 64


def fine(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % M
    return x ^ (x >> 31)


def poly(xs):
    return sum(x * pow(q.BASE, i, M) for i, x in enumerate(xs)) % M


def kind(ch):
    if ord(ch) >= q.KNOWN_KINDS:
        return q.LETTER
    return q.CAPITAL if ch.isupper() else q.SMALL if ch.islower() else q.DIGIT if ch.isdigit() else q.LETTER if ch.isalpha() else ord(ch) + 5


def plain(text):
    """The buckets of a block's features, one after the other."""
    import re

    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    if not words:
        return []
    flat, out = re.sub(r"[ \t\n\v\f\r]+", " ", text).lstrip(" "), []
    for n in q.ORDERS:
        for i in range(len(flat) - n + 1):
            h = 0
            for ch in flat[i : i + n]:
                h = (h * q.BASE + ord(ch) + 1) % M
            out.append(fine((h + n) % M))
    hashes = [fine(poly([ord(c) + 1 for c in w])) for w in words]
    shapes = []
    for i, w in enumerate(words):
        runs = [k for j, k in enumerate(map(kind, w)) if j == 0 or k != kind(w[j - 1])]
        again = 1 if i and w == words[i - 1] else 2 if i > 1 and w == words[i - 2] else 0
        shapes.append(fine((poly(runs) * 4 + again) % M))
    for salt, xs in ((11, hashes), (13, shapes)):
        out += [fine((x + salt) % M) for x in xs] + [fine((a * q.BASE + b + salt + 1) % M) for a, b in zip(xs, xs[1:])]
    return [x % q.BUCKETS for x in out]


TEXTS = ["a", "Ab  cd\n\nAb cd", "  lead and trail  ", "x x x y x y", "HÉ!! 12,5 ñandú 日本語 \U0001f600\x1c z", "one\x0btwo\ttwo", "\ud800 lone"]


@pytest.mark.parametrize("text", TEXTS)
def test_features_equal_plain_loops(text):
    assert sorted(q.features(text).tolist()) == sorted(plain(text))


def test_features_of_random_texts():
    rng = random.Random(4)
    for _ in range(60):
        t = "".join(rng.choice("aB1é. \n!日") for _ in range(rng.randint(1, 80)))
        assert sorted(q.features(t).tolist()) == sorted(plain(t))


def test_no_feature_without_a_word():
    for t in ("", " ", "\n\t \x0b"):
        assert sum(len(q.features(b)) for b in q.blocks(t)) == 0


def test_blocks_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(q, "BLOCK", 10)
    for t in ("", "short", "a long text cut at blanks", "x" * 35, "ab " * 9, "word\nand  more\n"):
        parts = list(q.blocks(t))
        assert "".join(parts) == t and all(0 < len(p) <= 10 for p in parts)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    e, w, b = rng.normal(0, 1, (40, 5)), rng.normal(0, 1, (5, 2)), rng.normal(0, 1, 2)
    x = q.Example(np.array([3, 7, 21]), np.array([0.5, 0.3, 0.2]), 1, False)

    def loss():
        z = x.share @ e[x.at] @ w + b
        return math.log(np.exp(z).sum()) - z[x.label]

    de, dw, db = q.gradients(e, w, b, x)
    for part, grad, where in ((e, de, x.at), (w, dw, range(5)), (b, db, range(2))):
        for row, i in enumerate(where):
            for j in np.ndindex(part[i].shape) if np.ndim(part[i]) else [()]:
                at = (i, *j)
                was = part[at]
                part[at] = was + 1e-6
                up = loss()
                part[at] = was - 1e-6
                down = loss()
                part[at] = was
                assert abs((up - down) / 2e-6 - grad[(row, *j)]) < 1e-6


def make(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(30, 90))]
        bad = i % 4 == 0
        if bad:
            w = [w[0]] * len(w) if i % 8 == 0 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "c", 1.5))
        labels.append((i, int(not bad), 0))
    return rows, labels


SCHEMA = "doc_id long, text string, label string, score double"


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = make(1, 240)
    return q.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), epochs=12)


def test_held_out_documents_are_told_apart(spark, model):
    rows, labels = make(9, 120)
    got = {r["doc_id"]: r for r in q.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert all(got[i]["predicted"] == y for i, y, _ in labels) and all(0 <= r["score"] <= 1 for r in got.values())


def test_scores_equal_a_plain_sum(spark, model):
    for text in TEXTS:
        b = plain(text)
        z = (sum(float(model.table[x]) for x in b) / len(b) + model.bias) / model.temperature
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-6


def test_odd_rows(spark, model):
    base = 1 / (1 + math.exp(-model.bias / model.temperature))
    rows = [(1, None, None, None), (2, "", "x", 0.0), (3, " \n", "x", 0.0), (4, "a b c", "x", 0.0), (4, "a b c", "x", 0.0), (None, "a b c", "x", 0.0), (5, "long word " * 60_000, "x", 0.0)]
    got = q.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    by = sorted(((r["doc_id"] or 0, r["score"], r["predicted"]) for r in got), key=lambda r: r[0])
    assert len(by) == len(rows) and all(abs(s - base) < 1e-9 for i, s, _ in by if i in (1, 2, 3))
    assert len({s for i, s, _ in by if i in (0, 4)}) == 1 and all(p == int(s >= 0.3) for _, s, p in by)
    assert q.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_labels_that_say_nothing(spark):
    rows, _ = make(3, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(0, 1), (1, 1)], [(0, None), (1, 7)], [(99, 0), (98, 1)], [(0, 0), (0, 1), (1, 1)]):  # none, one class, no class, no documents, the larger of two
        m = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert m.table is None and m.score("anything") == 0.5
    assert q.train(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int"), epochs=1).table is not None


def test_the_sample_is_bounded(spark):
    rows, labels = make(5, 40)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([x[:2] for x in labels], "doc_id long, quality int")
    assert q.sampled(docs, labels, sample=25).count() == 25 and q.sampled(docs, labels).count() == 40
