"""Ordered folds by windows, against plain loops."""

import random

import numpy as np
import pytest

from loam.operators import near_facts, ordered

SCHEMA = "batch long, pos long, confidence double, importance double, embedding array<double>, content string, context string, sources array<string>"


def loop(rows, least=0.95):
    """(batch, pos) -> survivor, and the merged facts, one after the other."""
    into, merged = {}, {}
    for batch in {r[0] for r in rows}:
        held = []  # pos, the accumulated fact, its vector
        for _, pos, c, m, v, content, context, sources in sorted((r for r in rows if r[0] == batch), key=lambda r: r[1]):
            v = np.array(v)
            near = [h for h in held if np.linalg.norm(v) > 0 and np.linalg.norm(h["v"]) > 0 and v @ h["v"] / np.linalg.norm(v) / np.linalg.norm(h["v"]) >= least]
            if not near:
                held.append({"pos": pos, "v": v, "c": c, "m": m, "content": content, "context": context, "sources": list(sources), "n": 1})
                into[batch, pos] = pos
                continue
            h = near[0]
            into[batch, pos] = h["pos"]
            h["sources"] += [x for x in sources if x not in h["sources"]]
            h["n"] += 1
            if (c, m) > (h["c"], h["m"]):
                h |= {"v": v, "c": c, "m": m, "content": content, "context": context if context is not None else h["context"]}
            elif h["context"] is None:
                h["context"] = context
        merged |= {(batch, h["pos"]): (h["content"], h["c"], h["m"], h["context"], h["sources"], h["n"]) for h in held}
    return into, merged


def facts(seed, n, batches, centres=12, dim=6):
    rng, base = random.Random(seed), np.random.default_rng(seed).normal(size=(centres, dim))
    out = []
    for i in range(n):
        v = base[rng.randrange(centres)] + np.random.default_rng(i).normal(size=dim) * rng.choice([0.02, 0.15, 0.4])
        out.append((i % batches, i, round(rng.random(), 1), round(rng.random(), 1), v.tolist(), f"c{i}", rng.choice([None, f"x{i}"]), [f"s{rng.randrange(9)}", f"s{rng.randrange(9)}"]))
    return [(*r[:7], list(dict.fromkeys(r[7]))) for r in out] + [(1 % batches, 9000, 0.5, 0.5, [0.0] * dim, "zero", None, [])]


@pytest.mark.parametrize("batches,window", [(3, 4096), (3, 11), (1, 7)])
def test_collapse_equals_a_loop(spark, monkeypatch, batches, window):
    monkeypatch.setattr(ordered, "TILE", 4)
    rows = facts(window, 130, batches)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_facts.collapse_near(df, window=window)
    into, merged = loop(rows)
    assert {(r["batch"], r["pos"]): r["survivor"] for r in got.collect()} == into and len(merged) < 100
    assert {(r["batch"], r["pos"]): tuple(r)[2:] for r in near_facts.merged(df, got).collect()} == merged


def test_a_large_group_of_copies(spark):
    """One group of 30,000 facts goes by windows; all say one of three things."""
    rows = [(0, i, (i * 7 % 10) / 10, 0.5, [float(i % 3 == k) for k in range(3)]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "batch long, pos long, confidence double, importance double, embedding array<double>")
    got = near_facts.collapse_near(df, window=8192)
    assert {(r["survivor"], r["n"]) for r in got.groupBy("survivor").count().withColumnRenamed("count", "n").collect()} == {(0, 10_000), (1, 10_000), (2, 10_000)}
    assert got.filter("rep").count() <= 30


def test_nothing_to_collapse(spark):
    assert near_facts.collapse_near(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(0, 1, None, None, None, "a", None, None), (0, 2, 0.5, 0.5, [None, 1.0], "b", None, []), (0, 3, 0.5, 0.5, [float("nan"), 1.0], "c", None, []), (0, 4, 0.5, 0.5, [1.0, 1.0], "d", None, [])]
    got = near_facts.collapse_near(spark.createDataFrame(odd, SCHEMA))
    assert all(r["pos"] == r["survivor"] for r in got.collect()) and got.count() == 4


def test_places_are_numbered_across_partitions(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(1000)) for _ in range(500)]
    got = ordered.placed(spark.createDataFrame(rows, "g long, x long").repartition(7), ["g"], ["x"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["n"], r["x"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for a, x in rows if a == g)
