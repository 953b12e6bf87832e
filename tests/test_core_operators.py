"""Operators without an oracle, against plain loops on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import centrality, exploration, temporal


def brute_betweenness(edges):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    near = {x: [] for x in nodes}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        best, paths = float("inf"), []
        stack = [(s, 0.0, [s])]
        while stack:
            x, d, path = stack.pop()
            if d > best:
                continue
            if x == t:
                paths = paths + [path] if d == best else [path]
                best = d
                continue
            stack += [(y, d + w, [*path, y]) for y, w in near[x] if y not in path]
        for path in paths:
            for x in path[1:-1]:
                out[x] += 1 / len(paths)
    n = len(nodes)
    return {x: v / ((n - 1) * (n - 2) / 2) for x, v in out.items()}


@pytest.mark.parametrize("edges", [
    [("center", f"l{i}", 1.0) for i in range(5)],
    [(a, b, 2.0) for g in (["a1", "a2", "a3"], ["b1", "b2", "b3", "b4"]) for a, b in itertools.combinations(g, 2)] + [("a1", "bridge", 0.5), ("b1", "bridge", 0.5)],
    [("p", "q", 1.0), ("q", "r", 1.0), ("p", "s", 1.0), ("s", "r", 1.0), ("p", "r", 3.0), ("r", "t", 0.5)],
])
@pytest.mark.parametrize("block", [2, 512])
def test_betweenness_equals_brute_force(spark, edges, block):
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r["node"]: r["betweenness"] for r in centrality.betweenness(df, block=block, wave=2).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want)
    members = spark.createDataFrame([(x, x[0]) for x in want], "node string, community string")
    found = centrality.bridges(df, members).collect()
    near = {x: {x[0]} | {b[0] for a, b, _ in edges if a == x} | {a[0] for a, b, _ in edges if b == x} for x in want}
    assert [r["node"] for r in found] == sorted((x for x in want if want[x] > 0), key=lambda x: (-round(want[x] * len(near[x]), 12), x))


def test_betweenness_by_joins_equals_that_by_sources(spark, monkeypatch):
    """A graph that tasks hold takes a shuffle or two, not rounds of tables; sources in several tasks and several matrices."""
    edges = [(f"{a:02}", f"{b:02}", float(1 + (a * b) % 3)) for a in range(12) for b in range(a + 1, 12) if (a + 2 * b) % 3 == 0]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    want = brute_betweenness(edges)
    monkeypatch.setattr(centrality, "_round", None)
    for name, value in (("TAKEN", 5), ("CELLS", 30), ("MET", 8)):
        monkeypatch.setattr(centrality, name, value)
    got = {r["node"]: r["betweenness"] for r in centrality.betweenness(df).collect()}
    monkeypatch.undo()
    joins = {r["node"]: r["betweenness"] for r in centrality.betweenness(df, block=6, wave=1, held=0).collect()}
    assert got.keys() == want.keys() == joins.keys() and all(np.isclose(got[x], want[x]) and np.isclose(joins[x], want[x]) for x in want)


def test_betweenness_by_hubs_equals_that_by_sources(spark, monkeypatch):
    """A graph whose edges touch a few nodes goes by paths between these, and looks at no edge for each source and round; hubs with edges between them, several paths of a length, two components, matrices that aren't full."""
    rng = random.Random(6)
    edges = {(f"{a}h{rng.randrange(5)}", f"{a}n{b:02}"): rng.choice([1.0, 1.0, 2.0, 0.5]) for a in "xy" for b in range(25) for _ in range(rng.randint(1, 4))}
    edges |= {("xh0", "xh1"): 1.0, ("xh1", "xh2"): 2.0, ("yh0", "yh1"): 0.5}
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a string, b string, weight double")
    want = {r["node"]: r["betweenness"] for r in centrality.betweenness(df, hubs=0).collect()}
    monkeypatch.setattr(centrality, "dependencies", None)
    monkeypatch.setattr("loam.operators.hubs.CELLS", 20)
    got = {r["node"]: r["betweenness"] for r in centrality.betweenness(df).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 0.1 and all(np.isclose(got[x], want[x]) and (got[x] > 0) == (want[x] > 0) for x in want)


def test_betweenness_counts_isolated_nodes(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.0), ("b", "b", 1.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "node string")
    got = {r["node"]: r["betweenness"] for r in centrality.betweenness(df, nodes).collect()}
    assert got.keys() == set("abcdz") and np.isclose(got["b"], 1 / 6) and sum(got.values()) == got["b"]
    assert {r["betweenness"] for r in centrality.betweenness(df.limit(0), nodes).collect()} == {0.0}


def test_selective_exploration(spark):
    edges = [("c", "a", "uses", 3.0), ("c", "b", "uses", 2.0), ("a", "d", "uses", 1.0), ("b", "e", "made", 5.0), ("x", "c", "uses", 9.0), ("d", "f", "uses", 1.0), ("e", "a", "uses", 4.0)]
    e = spark.createDataFrame(edges, "source string, target string, type string, weight double")
    names = spark.createDataFrame([(x, x.upper()) for x in "abcdefx"], "id string, name string")
    score = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("d", 0.5), ("e", 2.0), ("x", 0.3)], "id string, score double")
    x = exploration.selective(e, names, "c", score)
    told = lambda x: [(r["id"], r["hop"], r["relevance"], r["path"]) for r in x.nodes.collect()]
    assert told(x) == [("x", 1, 0.3, ["C", "X"]), ("a", 1, 0.9, ["C", "A"]), ("e", 2, 1.0, ["C", "A", "E"]), ("d", 2, 0.5, ["C", "A", "D"])]
    assert x.pruned == 2  # b is not relevant, f is unknown
    assert {tuple(r)[:3] for r in x.links.collect()} == {("X", "C", "uses"), ("C", "A", "uses"), ("E", "A", "uses"), ("A", "D", "uses")}
    x = exploration.selective(e, names, "c", None, most=2)
    assert [r[0] for r in told(x)] == ["x", "a"] and x.pruned == 1
    # Two nodes at the first level, so three more: the first fills the number with one left over, and the second meets nobody.
    x = exploration.selective(e, names.filter("id <> 'x'"), "c", None, most=3)
    assert [r[0] for r in told(x)] == ["a", "b", "e"] and x.pruned == 1
    assert [r[0] for r in told(exploration.selective(e, names, "c", None, depth=1, types=["uses"]))] == ["x", "a", "b"]
    scoped = names.withColumn("scope", F.when(F.col("id") == "a", "tenant:z").otherwise("global"))
    assert [r[0] for r in told(exploration.selective(e, scoped, "c", None, scopes=["global"]))] == ["x", "b", "e"]
    alone = exploration.selective(e.filter("source = 'none'"), names, "c", score)
    assert told(alone) == [] and alone.links.count() == 0 and alone.pruned == 0


def test_temporal_patterns_are_all_of_them(spark):
    week = 7 * 86400
    e = spark.createDataFrame([(f"e{i}", f"n{i}", 10 * week + (0 if i < 9 else i * week), 11 * week, 3) for i in range(12)], "id string, name string, first_seen long, last_seen long, mention_count long")
    c = spark.createDataFrame([(1, "c1", f"e{i}") for i in range(4)] + [(2, "c1", f"e{i}") for i in range(6)] + [(2, "c2", "e9")], "generation long, cluster_id string, entity_id string")
    b = spark.createDataFrame([("e1", 1, 1.0), ("e1", 2, 1.0), ("e2", 2, 3.0)], "entity_id string, generation long, bridge_score double")
    now = 60 * week
    got = temporal.patterns(e, c, b, now).collect()
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("entity_burst", "topic_emergence", "topic_decay", "community_evolution", "bridge_formation")}
    assert len(kinds["entity_burst"]) == temporal.bursts(e).count() == 1
    assert len(kinds["topic_emergence"]) == temporal.emergence(e).count() and len(kinds["topic_decay"]) == temporal.decay(e, now).count() == 1
    assert {r["subject"] for r in kinds["community_evolution"]} == {"growth:c1", "birth:c2"}
    assert [(r["n"], r["subject"], r["confidence"]) for r in kinds["bridge_formation"]] == [(1, "e2", 0.6)]
    assert [r["confidence"] for r in got] == sorted((r["confidence"] for r in got), reverse=True)
    assert {r["kind"] for r in temporal.patterns(e, c, b, now, kind="topic_decay").collect()} == {"topic_decay"}


def test_query_terms_are_cut_as_texts_are():
    from loam.functions.columns import query_terms

    assert query_terms("state-of-the-art re-ranking node.js") == ["state", "of", "the", "art", "re", "ranking", "node", "js"]
    assert query_terms("The 'clown' and the idiot") == ["clown", "idiot"] and query_terms("the of") == ["the", "of"] and query_terms("  ") == []


def test_informativeness_fills_gaps_by_the_upper_median(spark):
    from loam.operators.graph import informativeness

    e = spark.createDataFrame([("a", 500, 10), ("b", 50, 2), ("c", 200, 5), ("d", 7, 0)], "id string, mention_count long, conversation_count long")
    b = spark.createDataFrame([("b", 4.0, 2), ("c", 2.0, 2), ("a", 99.0, 1)], "id string, bridge_score double, generation long")
    got = {r["id"]: r["informativeness"] for r in informativeness(e, b, 10).collect()}
    want = {"a": 0.0, "b": np.log(51) * np.log(11 / 3) * 2, "c": np.log(201) * np.log(11 / 6) * 1.5, "d": np.log(8) * np.log(11 / 6)}
    assert all(np.isclose(got[x], want[x], atol=1e-5) for x in want)


def test_commitment_subjects(spark):
    from pyspark.sql import functions as F

    from loam.operators.extraction import subject

    want = {"The User": "self", None: "self", " Bob Smith!": "bob", "ann-marie": "ann-marie", "!!": "self"}
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", subject(F.col("s")).alias("got"))
    assert {r["s"]: r["got"] for r in df.collect()} == want
