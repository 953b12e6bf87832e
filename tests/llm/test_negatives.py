"""Hard-negative mining: Strassen's recursion and heaps against plain ones, results against brute force over many tiles, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, q string, score long, dim string"


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (9, 9, 9), (33, 64, 17), (100, 12, 50), (64, 64, 64), (8, 100, 8), (31, 1, 40)])
def test_strassen_is_exact(m, k, n):
    rng = np.random.default_rng(m * k * n)
    for most in (3, 1 << 20):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (h.strassen(a, b) == a.astype(object) @ b.astype(object)).all()


def test_strassen_may_wrap_around_on_the_way():
    a = np.full((16, 16), 1 << 60, np.int64)
    b = np.zeros((16, 16), np.int64)
    b[0] = 2
    b[1] = -2
    b[2] = 1
    assert (h.strassen(a, b) == 1 << 60).all()


def test_heaps_hold_the_best_in_any_order():
    rng = random.Random(3)
    rows = [[(rng.randint(-5, 5), rng.randint(0, 99)) for _ in range(40)] for _ in range(6)]
    heaps = h.Heaps((6,), 4)
    for at in range(0, 40, 7):
        part = [r[at : at + 7] for r in rows]
        heaps.merge(np.array([[s for s, _ in r] for r in part]), np.array([[i for _, i in r] for r in part]))
    for r, s, i in zip(rows, heaps.score, heaps.id):
        assert sorted(r, key=lambda x: (-x[0], x[1]))[:4] == list(zip(s.tolist(), i.tolist()))


def brute(rows, anchor):
    good = [(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if not anchor(i):
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i and len(w) == len(v)]
        order = lambda x: (-x[0], x[1])
        for p, j, _ in sorted((x for x in others if x[2] == y), key=order)[:5]:
            window = sorted((x for x in others if x[2] != y and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(i, j, n, k, p, s) for n, (s, k, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 1, "z") for i, v, y in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in h.mine(df, F.col("vec_id") % 5 == 0).collect())


def vectors(seed, n, labels=4, dim=6, hot=0.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [rng.choice(centre)[d] * 0.3 + rng.gauss(0, 0.4) for d in range(dim)], 0 if rng.random() < hot else rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("anchors,candidates", [(1024, 2048), (4, 7), (1, 50)])
def test_equal_to_brute_force_over_tiles(spark, monkeypatch, anchors, candidates):
    monkeypatch.setattr(h, "ANCHORS", anchors)
    monkeypatch.setattr(h, "CANDIDATES", candidates)
    rows = vectors(anchors, 120, hot=0.4)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 40 and mined(spark, rows) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(h, "ANCHORS", 3)
    monkeypatch.setattr(h, "CANDIDATES", 5)
    rows = vectors(7, 40)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (105, [], 1), (110, [nan] + [0.1] * 5, 1), (115, [inf] + [0.1] * 5, 2), (120, [None] + [0.1] * 5, 2), (125, [0.5] * 6, None), (None, [0.5] * 6, 1), (130, [0.0] * 6, 1)]
    rows += [rows[5], rows[5], rows[6], (10, [0.3] * 6, 2), (200, [0.4, 0.5], 1), (205, [0.4, 0.5], 1), (206, [0.3, 0.3], 2), (300, [0.4] * 6, 3), (301, [0.4] * 6, 3), (302, [0.3] * 6, 0), (303, [0.3] * 6, 1), (-5, [0.2] * 6, 1)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert any(r[0] == 200 for r in want) and mined(spark, rows) == want


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.1], 1), (2, [0.1], 1)]) == []  # no anchor
    assert mined(spark, [(5, [0.1], 1), (2, [0.1], 2)]) == []  # no positive
    assert mined(spark, [(5, [0.5], 1), (2, [0.5], 1), (3, [-0.5], 2)]) == []  # an empty window


def test_huge_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(5, [3e30], 1), (6, [1.0], 1)])
