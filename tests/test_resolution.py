"""Ordered resolution of names against a plain loop."""

import random

import numpy as np
import pytest

from loam.operators import ordered, resolution

NAMES = "pos long, name string, type string, scope string, embedding array<double>"
ENTITIES = "id string, name string, type string, aliases array<string>, mention_count long, first_seen long, last_seen long, scope string"


def loop(names, entities, vectors):
    known = {e[0]: {"name": e[1], "type": e[2], "aliases": list(e[3]), "v": vectors.get(e[0])} for e in entities}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) if a is not None and b is not None and np.any(a) and np.any(b) else 0.0
    out = {}
    for pos, name, kind, _, v in sorted(names):
        by_name = sorted(i for i, e in known.items() if e["name"].lower() == name.lower())
        by_alias = sorted(i for i, e in known.items() if name.lower() in [a.lower() for a in e["aliases"]])
        if by_name or by_alias:
            out[pos] = ("exact_name", by_name[0]) if by_name else ("alias", by_alias[0])
            continue
        near = sorted((-cos(v, e["v"]), i) for i, e in known.items() if cos(v, e["v"]) >= 0.85)[:5]
        hit = next((i for c, i in near if -c >= 0.95 or known[i]["type"] == kind), None)
        if hit:
            out[pos] = ("embedding", hit)
            known[hit]["aliases"].append(name)
        else:
            out[pos] = ("created", f"new-{pos}")
            known[f"new-{pos}"] = {"name": name, "type": kind, "aliases": [], "v": v}
    return out, known


def made(seed, n):
    rng, base = random.Random(seed), np.random.default_rng(seed).normal(size=(8, 5))
    vec = lambda i: (base[rng.randrange(8)] + np.random.default_rng(seed * 1000 + i).normal(size=5) * rng.choice([0.05, 0.3, 0.8])).tolist()
    entities = [(f"e{i:02}", f"Known {i}", rng.choice(["person", "tool"]), [f"nick {i}", f"Nick {i + 1}"], 1, 5, 6, rng.choice([None, "global", "tenant:a"])) for i in range(12)]
    vectors = {e[0]: vec(900 + i) for i, e in enumerate(entities) if i % 3}
    names = [(i, rng.choice([f"known {i % 15}", f"NICK {i % 15}", f"thing {rng.randrange(n // 2)}", f"Other {i}", f"other {i}"]), rng.choice(["person", "tool"]), rng.choice(["global", "tenant:a", "tenant:b"]), rng.choice([vec(i), vec(i), vec(i), None]) if i % 9 else [0.0] * 5) for i in range(n)]
    return names, entities, vectors


@pytest.mark.parametrize("window", [4096, 9])
def test_equal_to_a_loop(spark, monkeypatch, window):
    monkeypatch.setattr(ordered, "TILE", 3)
    names, entities, vectors = made(window, 90)
    df, ent = spark.createDataFrame(names, NAMES).repartition(3), spark.createDataFrame(entities, ENTITIES)
    found = resolution.resolve(df, ent, spark.createDataFrame(list(vectors.items()), "id string, embedding array<double>"), window=window)
    want, known = loop(names, entities, vectors)
    got = {r["pos"]: (r["stage"], r["entity_id"]) for r in found.collect()}
    assert got == want and {s for s, _ in got.values()} == {"exact_name", "alias", "embedding", "created"}
    after = {r["id"]: r for r in resolution.applied(df, found, ent, 77).collect()}
    assert after.keys() == known.keys()
    for i, e in known.items():
        n = sum(x == i for _, x in want.values())
        assert (after[i]["name"], after[i]["type"], after[i]["aliases"]) == (e["name"], e["type"], e["aliases"])
        assert after[i]["mention_count"] == n + (i[0] == "e") and after[i]["last_seen"] == (77 if n else 6) and after[i]["first_seen"] == (5 if i[0] == "e" else 77)


def test_a_name_finds_what_an_earlier_one_made(spark):
    v = [1.0, 0.2, 0.0]
    names = [(1, "Apollo", "tool", "tenant:a", v), (2, "Apollo Guide", "person", "tenant:b", v), (3, "apollo guide", "person", None, None), (4, "APOLLO", "x", None, None)]
    df = spark.createDataFrame(names, NAMES)
    none = spark.createDataFrame([], ENTITIES)
    found = resolution.resolve(df, none, spark.createDataFrame([], "id string, embedding array<double>"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "created", "new-1"), (2, "embedding", "new-1"), (3, "alias", "new-1"), (4, "exact_name", "new-1")]
    (one,) = resolution.applied(df, found, none, 9).collect()
    assert (one["aliases"], one["mention_count"], one["scope"]) == (["Apollo Guide"], 4, "global")
    assert resolution.resolve(df.limit(0), none, spark.createDataFrame([], "id string, embedding array<double>")).count() == 0
