"""Property-graph operators: projection, traversal, communities, bridges, weights, merges and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import DAY, edge_weight
from loam.sources.scratch import dealt, save


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Every edge from either end: (node, other, ...)."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *more).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *more))


def projection(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Undirected simple graph: edges whose ends exist, no loops; of the edges between two nodes the first by (source, target, type) keeps its weight."""
    ids = entities.select("id").distinct()
    live = edges.filter("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return live.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min_by("weight", F.struct("source", "target", "type")).alias("weight"))


def coherence(graph: DataFrame, members: DataFrame) -> DataFrame:
    """members: (node, community). internal / (internal + external) of each community's edges."""
    ends = graph.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a", "left").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b", "left")
    inside = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    parts = ends.select(F.explode(F.when(inside, F.array(F.struct(F.col("ca").alias("community"), F.lit(1).alias("i"), F.lit(0).alias("e")))).otherwise(F.filter(F.array(F.struct(F.col("ca").alias("community"), F.lit(0).alias("i"), F.lit(1).alias("e")), F.struct(F.col("cb").alias("community"), F.lit(0).alias("i"), F.lit(1).alias("e"))), lambda x: x["community"].isNotNull()))).alias("x"))
    out = parts.groupBy("x.community").agg(F.sum("x.i").alias("internal"), F.sum("x.e").alias("external"))
    return out.select("community", "internal", "external", F.round(F.col("internal") / (F.col("internal") + F.col("external")), 6).alias("coherence"))


def bridge_span(graph: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct communities of each node and its neighbours."""
    near = both_ways(graph.select(F.col("a").alias("source"), F.col("b").alias("target"))).select("node", "other")
    near = near.unionByName(near.select("node", F.col("node").alias("other")).distinct())
    return near.join(members.select(F.col("node").alias("other"), "community"), "other").groupBy("node").agg(F.countDistinct("community").alias("community_span"))


def modularity(graph: DataFrame, members: DataFrame) -> DataFrame:
    ends = graph.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = graph.agg(F.sum("weight").alias("m"))
    inside = ends.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w_in"))
    degree = ends.select(F.col("ca").alias("community"), "weight").unionByName(ends.select(F.col("cb").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("deg"))
    rows = degree.join(inside, "community", "left").join(F.broadcast(total))
    return rows.agg(F.round(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))), 6).alias("modularity"))


def edge_weights(edges: DataFrame, entities: DataFrame, memories: DataFrame, now: int) -> DataFrame:
    """Weights from mentions of both ends, the target's last sight, and the averages of the cited memories (0.5 where none is known)."""
    n, key = edges.count(), ["source", "target", "type"]
    cites = edges.select(*key, F.explode("source_memories").alias("id"))
    known = memories.select("id", "confidence", "importance").join(cites.select("id").distinct(), "id", "left_semi")
    cited = dealt(dealt(cites, n, "id").join(known, "id"), n, *key).groupBy(*key).agg(F.avg("confidence").alias("conf"), F.avg("importance").alias("imp"))
    ends = dealt(edges.drop("source_memories"), n, "target").join(entities.select(F.col("id").alias("target"), "last_seen"), "target", "left")
    ends = dealt(ends, n, *key).join(cited, key, "left")
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce("last_seen", F.lit(now))) / DAY)
    return ends.select("source", "target", "type", F.round(edge_weight(F.col("weight"), days, F.coalesce("conf", F.lit(0.5)), F.coalesce("imp", F.lit(0.5))), 6).alias("weight"))


def informativeness(entities: DataFrame, bridges: DataFrame, conversations: int) -> DataFrame:
    """ln(1 + mentions) * ln((N + 1) / (n + 1)) * (1 + bridge / largest bridge), where N is the number of conversations and n those of the entity; an entity without any takes the upper median of the others' (1 without others). bridges: (id, bridge_score, generation), of which the latest generation counts."""
    latest = bridges.join(F.broadcast(bridges.agg(F.max("generation").alias("generation"))), "generation")
    top = latest.agg(F.coalesce(F.max("bridge_score"), F.lit(1.0)).alias("_top"))
    # The upper median from a histogram: a row per distinct count.
    hist = entities.filter("conversation_count > 0").groupBy("conversation_count").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    hist = hist.select("conversation_count", F.sum("n").over(w.orderBy("conversation_count")).alias("upto"), F.sum("n").over(w).alias("all"))
    median = hist.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.coalesce(F.min("conversation_count"), F.lit(1)).alias("_median"))
    rows = entities.join(latest.select("id", "bridge_score"), "id", "left").join(F.broadcast(median)).join(F.broadcast(top))
    lift = 1 + F.when(F.col("_top") > 0, F.coalesce("bridge_score", F.lit(0.0)) / F.col("_top")).otherwise(F.lit(0.0))
    n = F.when(F.col("conversation_count") > 0, F.col("conversation_count")).otherwise(F.col("_median"))
    idf = F.lit(0.0) if conversations == 0 else F.log((F.lit(conversations) + 1) / (n + 1))
    return rows.select("id", F.round(F.log1p("mention_count") * idf * lift, 6).alias("informativeness"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    linked = dealt(edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))), 2 * edges.count(), "id").distinct()
    return entities.join(linked, "id", "left_anti").select("id", "name", "type")


def health(entities: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans, stale entities, communities of the latest generation, generations."""
    n = entities.agg(F.count("*").alias("n_nodes"), F.count("stale_since").alias("n_stale"))
    e = edges.agg(F.count("*").alias("n_edges"))
    o = orphans(entities, edges).agg(F.count("*").alias("n_orphans"))
    latest = communities.agg(F.max(F.struct("generation")).alias("g"), F.countDistinct("generation").alias("n_generations"))
    c = communities.groupBy("generation").agg(F.countDistinct("cluster_id").alias("n_communities")).agg(F.max_by("n_communities", "generation").alias("n_communities"))
    return n.join(F.broadcast(e)).join(F.broadcast(o)).join(F.broadcast(c)).join(F.broadcast(latest.select("n_generations")))


def merge_same_names(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with one name but for case become the most mentioned (then smallest id); edges follow, parallel ones keep the largest weight."""
    key = F.lower("name")
    best = entities.groupBy(key.alias("key"), "type").agg(F.min_by("id", F.struct(-F.col("mention_count"), "id")).alias("keep"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("n_merged"))
    moved = entities.select("id", key.alias("key"), "type").join(best.select("key", "type", "keep"), ["key", "type"]).select("id", "keep")
    ends = edges.join(moved.select(F.col("id").alias("source"), F.col("keep").alias("s")), "source").join(moved.select(F.col("id").alias("target"), F.col("keep").alias("t")), "target")
    joined = ends.filter("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "type").agg(F.max("weight").alias("weight"))
    return best.select(F.col("keep").alias("id"), "type", "mention_count", "first_seen", "last_seen", "n_merged"), joined


def visibility(entities: DataFrame, edges: DataFrame, low: int = 1500, high: int = 4000) -> DataFrame:
    """For every mention count as a threshold, the share of nodes and of edges (by their less mentioned end) that remain, from histograms and running sums."""
    m = entities.select("id", "mention_count")
    ends = edges.select("source", "target").join(m.select(F.col("id").alias("source"), F.col("mention_count").alias("ms")), "source").join(m.select(F.col("id").alias("target"), F.col("mention_count").alias("mt")), "target")
    nodes = m.groupBy(F.col("mention_count").alias("t")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("e"))
    links = ends.groupBy(F.least("ms", "mt").alias("t")).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("e"))
    hist = nodes.unionByName(links).groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("t"))  # a row per distinct count
    every = Window.partitionBy(F.lit(0))
    out = hist.select("t", F.sum("n").over(down).alias("nodes"), F.sum("e").over(down).alias("edges"), F.sum("n").over(every).alias("all_n"), F.sum("e").over(every).alias("all_e"))
    return out.filter("t >= 1").select(F.col("t").alias("threshold"), "nodes", "edges", F.round((F.col("edges") / F.col("all_e")) / (F.col("nodes") / F.col("all_n")), 6).alias("ratio"), F.col("nodes").between(low, high).alias("in_range"))


def explore(edges: DataFrame, centre: str, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """Nodes within `depth` hops, both ways, with the hop that first reports each. Types limit what is reported, not what is walked."""
    ways = both_ways(edges, "type", "weight")
    spark = edges.sparkSession
    front = spark.createDataFrame([(centre,)], "node string")
    walked, reported = front, None
    for hop in range(1, min(depth, 3) + 1):
        step = ways.join(F.broadcast(front) if hop == 1 else front, "node")
        told = step.filter(F.col("type").isin(*types)) if types else step
        new = told.groupBy(F.col("other").alias("node")).agg(F.max("weight").alias("weight")).filter(F.col("node") != centre).withColumn("hop", F.lit(hop).cast("long"))
        if reported is not None:
            new = new.join(reported.select("node"), "node", "left_anti")
        reported = new if reported is None else reported.unionByName(new)
        front = save(step.select(F.col("other").alias("node")).distinct().join(walked, "node", "left_anti"))
        walked = walked.unionByName(front)
    return reported.select("node", "hop", "weight")
