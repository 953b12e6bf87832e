"""Selective exploration: a neighbourhood that grows only through nodes that matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.columns import visible
from loam.sources.scratch import save


@dataclass
class Exploration:
    nodes: DataFrame  # (id, name, hop, relevance, path), at most `most`, in the order they were found
    links: DataFrame  # (source, target, type, weight), names
    pruned: int


def selective(edges: DataFrame, entities: DataFrame, centre: str, relevance: DataFrame | None, depth: int = 3, most: int = 50, threshold: float = 0.3, types: list[str] | None = None, scopes: list[str] | None = None) -> Exploration:
    """Level by level from the centre, on through nodes that are relevant enough. relevance: (id, score), 0 where a node has none; without it all nodes are. At most `most` nodes; the edges by which nodes were met, as long as the names at both ends are shown; and how many nodes were met and left out.

    A level is one table of meetings: each neighbour that isn't known yet, by the first of the level's nodes next to it and the strongest edge between the two. Its relevant ones, in the order of that node, the edge's weight and their ids, are numbered up to what is left of `most`; the node that fills the number is the last that meets anyone. Only the shown nodes, at most `most`, are held by the driver; everybody that was met is a written table. Types limit the edges that are walked; nodes outside the scopes are met, but neither shown nor counted."""
    spark = edges.sparkSession
    known = entities.select("id", "name", *(["scope"] if scopes else []))
    ways = _ways(edges)
    if types:
        ways = ways.filter(F.col("type").isin(*types))
    start = known.filter(F.col("id") == centre).first()["name"]
    met = spark.createDataFrame([(centre,)], "id string")
    shown, level, links, pruned = [], [(centre, start, [start])], None, 0
    for hop in range(1, min(max(depth, 1), 5) + 1):
        room = most - len(shown)
        if not level or room <= 0:
            break
        front = spark.createDataFrame([(i, n, name) for n, (i, name, _) in enumerate(level)], "node string, place long, own string")
        beside = ways.join(F.broadcast(front), "node").groupBy("place", "own", "other").agg(F.max_by(F.struct("weight", "type", "out"), F.struct("weight", "type")).alias("e"))
        first = beside.groupBy(F.col("other").alias("id")).agg(F.min_by(F.struct("place", "own", "e"), "place").alias("m")).join(met, "id", "left_anti")
        score = F.lit(1.0)
        rows = first.join(known, "id", "left")
        if relevance is not None:
            rows, score = rows.join(relevance.select("id", "score"), "id", "left"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))
        seen = F.col("name").isNotNull() & (visible(F.col("scope"), scopes) if scopes else F.lit(True))
        rows = save(rows.select("id", "name", seen.alias("counts"), score.alias("relevance"), "m.place", "m.own", F.col("m.e.type").alias("type"), F.col("m.e.weight").alias("weight"), F.col("m.e.out").alias("out")))
        kept = rows.filter(F.col("counts") & ((F.col("relevance") >= threshold) if relevance is not None else F.lit(True))).orderBy("place", F.desc("weight"), "id").limit(room).collect()
        last = kept[-1]["place"] if len(kept) == room else len(level)
        rows = rows.filter(F.col("place") <= last)
        pruned += rows.filter("counts").count() - len(kept)
        met = met.unionByName(rows.select("id"))
        side = lambda a, b: F.when(F.col("out"), F.col(a)).otherwise(F.col(b))
        told = rows.filter("counts").select(side("own", "name").alias("source"), side("name", "own").alias("target"), "type", "weight")
        links = told if links is None else links.unionByName(told)
        paths = {n: path for n, (*_, path) in enumerate(level)}
        level = [(r["id"], r["name"], [*paths[r["place"]], r["name"]]) for r in kept]
        shown += [(i, name, hop, float(r["relevance"]), path) for (i, name, path), r in zip(level, kept, strict=True)]
    names = [start, *(x[1] for x in shown)]
    schema = "source string, target string, type string, weight double"
    links = links.filter(F.col("source").isin(names) & F.col("target").isin(names)) if links is not None else spark.createDataFrame([], schema)
    return Exploration(spark.createDataFrame(shown, "id string, name string, hop long, relevance double, path array<string>"), links, pruned)


def _ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: (node, other, type, weight, out)."""
    forth = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", "weight", F.lit(True).alias("out"))
    return forth.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "type", "weight", F.lit(False).alias("out")))
