"""The graph's store: look-ups, resolution of names, upserts, cascades, pruning, bridges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import visible
from loam.operators.graph import explore


def by_name(entities: DataFrame, name: str) -> DataFrame:
    """The first entity (by id) with the name, but for case; without one, the first with such an alias. entities: (id, name, aliases, ...)."""
    wanted = name.lower()
    which = F.when(F.lower("name") == wanted, 0).when(F.exists("aliases", lambda a: F.lower(a) == wanted), 1)
    return entities.withColumn("_w", which).filter("_w IS NOT NULL").orderBy("_w", "id").limit(1).drop("_w")


def widened(scope: Column, seen_from: Column) -> Column:
    """A row seen from another scope than its own becomes global."""
    return F.when(scope.isNotNull() & (scope != "global") & seen_from.isNotNull() & (scope != seen_from), "global").otherwise(scope)


def upsert_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """edges: (source, target, type, weight, source_memories, scope[, stale_since]); seen: (source, target, type, memory_id, scope), a row per piece of evidence. The next edges: new ones weigh 1, known ones keep their weight; evidence is added once, in order, and clears `stale_since`; an edge seen from another scope becomes global."""
    key = ["source", "target", "type"]
    new = seen.groupBy(*key).agg(F.array_sort(F.collect_set("memory_id")).alias("more"), F.min("scope").alias("low"), F.max("scope").alias("high"))
    both = edges.join(new, key, "full_outer")
    own = F.coalesce("scope", F.when(F.col("weight").isNull(), F.col("low")))
    foreign = F.when(F.col("low") != own, F.col("low")).otherwise(F.col("high"))
    evidence = F.array_union(F.coalesce("source_memories", F.array().cast("array<long>")), F.coalesce("more", F.array().cast("array<long>")))
    stale = [F.when(F.col("more").isNull(), F.col("stale_since")).alias("stale_since")] if "stale_since" in edges.columns else []
    return both.select(*key, F.coalesce("weight", F.lit(1.0)).alias("weight"), evidence.alias("source_memories"), widened(own, foreign).alias("scope"), *stale)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of the new ones that aren't there yet."""
    key = ["source", "target", "type"]
    return edges.unionByName(new.dropDuplicates(key).join(edges.select(*key), key, "left_anti"))


def link_memory(entities: DataFrame, edges: DataFrame, names: list[str], memory_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """Up to ten named entities are mentioned once more and linked in pairs, in the order of their names: a known `related_to` edge gains 0.5 and the evidence, a new one weighs 1."""
    spark = entities.sparkSession
    wanted = spark.createDataFrame([(i, n.lower()) for i, n in enumerate(names[:10])], "pos long, key string")
    found = entities.select("id", F.lower("name").alias("key")).join(F.broadcast(wanted), "key").groupBy("pos").agg(F.min("id").alias("id"))
    ids = [r["id"] for r in found.orderBy("pos").collect()]  # ten at the most
    hit = F.col("id").isin(ids)
    bumped = entities.withColumn("mention_count", F.col("mention_count") + F.when(hit, ids_count(ids)).otherwise(0)).withColumn("last_seen", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_seen"))).withColumn("stale_since", F.when(~hit, F.col("stale_since")))
    pairs = [(a, b, "related_to") for i, a in enumerate(ids) for b in ids[i + 1 :] if a != b]
    new = F.broadcast(spark.createDataFrame(pairs, "source string, target string, type string").withColumn("_hit", F.lit(True)))
    both = edges.join(new, ["source", "target", "type"], "full_outer")
    evidence = F.when(F.col("_hit"), F.array_append(F.coalesce("source_memories", F.array().cast("array<long>")), F.lit(memory_id).cast("long"))).otherwise(F.col("source_memories"))
    weight = F.coalesce(F.col("weight") + F.when(F.col("_hit"), 0.5).otherwise(0.0), F.lit(1.0))
    return bumped, both.withColumn("source_memories", evidence).withColumn("weight", weight).drop("_hit")


def ids_count(ids: list[str]) -> Column:
    """How often each of a few ids is in the list."""
    return F.coalesce(*[F.when(F.col("id") == i, ids.count(i)) for i in dict.fromkeys(ids)], F.lit(0)) if ids else F.lit(0)


def mentions(entities: DataFrame, junction: DataFrame, seen: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """seen: (id, conversation_id), a row per mention. Entities with their mentions added, and the junction (id, conversation_id) with new pairs."""
    n = seen.groupBy("id").agg(F.count("*").alias("_n"))
    more = entities.join(n, "id", "left").withColumn("mention_count", F.col("mention_count") + F.coalesce("_n", F.lit(0))).withColumn("last_seen", F.when(F.col("_n").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_seen"))).drop("_n")
    return more, junction.unionByName(seen.select("id", "conversation_id").distinct().join(junction, ["id", "conversation_id"], "left_anti"))


def delete_cascade(gone: DataFrame, entities: DataFrame, edges: DataFrame, junction: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Without the entities (gone: id), their edges, conversations and bridge scores."""
    g = gone.select("id").distinct()
    left = edges.join(g.withColumnRenamed("id", "source"), "source", "left_anti").join(g.withColumnRenamed("id", "target"), "target", "left_anti")
    return entities.join(g, "id", "left_anti"), left, junction.join(g, "id", "left_anti"), bridges.join(g, "id", "left_anti")


def prune_orphans(entities: DataFrame, edges: DataFrame, now: int, least: int = 2, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Stale edges without evidence go; then, of the entities without an edge, stale ones without mentions, and old ones with few: (edges that go, entities that go with the reason)."""
    bare = F.col("stale_since").isNotNull() & (F.size("source_memories") <= 0)
    gone = edges.filter(bare)
    live = edges.filter(~bare)
    linked = live.select(F.col("source").alias("id")).unionByName(live.select(F.col("target").alias("id"))).distinct()
    alone = entities.join(linked, "id", "left_anti")
    why = F.when(F.col("stale_since").isNotNull() & (F.col("mention_count") <= 0), "stale").when((F.col("mention_count") < least) & (F.col("last_seen") < now - days * 86400), "orphan")
    return gone, alone.withColumn("reason", why).filter("reason IS NOT NULL").select("id", "reason")


def kept_generations(tables: dict[str, DataFrame], clusters: DataFrame, keep: int = 5) -> DataFrame:
    """(name, kept, pruned) of each table with a generation: below the latest of the clusters minus `keep` they go."""
    latest = clusters.agg(F.max("generation").alias("latest")).first()["latest"]
    cutoff = (latest or 0) - keep
    out = None
    for name, df in tables.items():
        old = (F.col("generation") < cutoff) & F.lit(cutoff >= 1)
        one = df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("pruned")).select(F.lit(name).alias("name"), "kept", "pruned")
        out = one if out is None else out.unionByName(one)
    return out


def persist_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters: (generation, cluster_id, entity_id) with the members (cluster_id, entity_id) of a new generation, one above the latest."""
    latest = clusters.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).cast("long").alias("generation"))
    return clusters.select("generation", "cluster_id", "entity_id").unionByName(members.join(F.broadcast(latest)).select("generation", "cluster_id", "entity_id"))


def groups(members: DataFrame) -> DataFrame:
    """members: (node, community). Each community's size and a digest of its members, largest first."""
    return members.groupBy("community").agg(F.count("*").alias("size"), F.md5(F.array_join(F.array_sort(F.collect_list("node")), ",")).alias("members")).orderBy(F.desc("size"), "community")


def fallback_names(members: DataFrame, entities: DataFrame, shown: int = 3) -> DataFrame:
    """members: (community, node). `Community <id>` and a preview: the first names and how many more."""
    named = members.join(entities.select(F.col("id").alias("node"), "name"), "node")
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("node")))
    out = first.groupBy("community").agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "name")))).alias("top"))
    more = F.when(F.col("size") > shown, F.concat(F.lit(" and "), (F.col("size") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return out.select("community", F.concat(F.lit("Community "), F.col("community").cast("string")).alias("name"), F.concat(F.array_join("top.name", ", "), more).alias("description"))


def explore_entity(edges: DataFrame, entities: DataFrame, clusters: DataFrame, name: str, depth: int = 1, types: list[str] | None = None, limit: int = 25, scopes: list[str] | None = None) -> DataFrame:
    """The neighbourhood of a named entity: strongest first, cut to the limit and then to the scopes, each with the centre's first community (by generation and id) and its size."""
    centre = by_name(entities, name)
    if scopes:
        centre = centre.filter(visible(F.col("scope"), scopes))
    found = centre.collect()
    if not found:
        raise ValueError(f"no entity {name!r}")
    near = explore(edges, found[0]["id"], min(max(depth, 1), 3), types).orderBy(F.desc("weight"), "hop", "node").limit(min(max(limit, 1), 50))
    mine = clusters.filter(F.col("entity_id") == found[0]["id"]).orderBy("generation", "cluster_id").limit(1)
    size = clusters.join(F.broadcast(mine.select("generation", "cluster_id")), ["generation", "cluster_id"]).agg(F.max("cluster_id").alias("community"), F.count("*").alias("community_size"))
    rows = F.broadcast(near).join(entities.select(F.col("id").alias("node"), "name", "type", "scope"), "node")
    if scopes:
        rows = rows.filter(visible(F.col("scope"), scopes))
    return rows.join(F.broadcast(size)).select("node", "name", "type", "hop", "weight", "community", "community_size")


def threshold(entities: DataFrame, edges: DataFrame, low: int = 1500, high: int = 4000) -> DataFrame:
    """The mention count from 1 to 100 at which a picture of the graph keeps the most edges for its nodes: of those that leave `low` to `high` nodes (or are 1) the one with the largest share of edges over share of nodes, if that is 1 or more, the later of equals; else all, or the first that leaves at most `high` nodes where all are more."""
    m = entities.select("id", "mention_count")
    ends = edges.select("source", "target").join(m.select(F.col("id").alias("source"), F.col("mention_count").alias("ms")), "source").join(m.select(F.col("id").alias("target"), F.col("mention_count").alias("mt")), "target")
    hist = m.groupBy(F.col("mention_count").alias("t")).agg(F.count("*").alias("n")).withColumn("e", F.lit(0).cast("long"))
    hist = hist.unionByName(ends.groupBy(F.least("ms", "mt").alias("t")).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("e"))).groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("t"))  # a row per distinct count
    rows = hist.select("t", F.col("n").alias("own"), F.sum("n").over(down).alias("nodes"), F.sum("e").over(down).alias("edges")).filter("own > 0 AND t BETWEEN 1 AND 100")
    total = entities.agg(F.count("*").alias("all_n")).join(edges.agg(F.count("*").alias("all_e")))
    rows = rows.join(F.broadcast(total)).withColumn("ratio", F.round((F.col("edges") / F.col("all_e")) / (F.col("nodes") / F.col("all_n")), 9))
    pick = F.struct(F.col("t").alias("threshold"), "nodes", "edges")
    fits = ((F.col("nodes") <= high) | (F.col("t") == 1)) & (F.col("nodes") >= low) & (F.col("ratio") >= 1)
    out = rows.agg(F.max_by(F.when(fits, pick), F.when(fits, F.struct("ratio", "t"))).alias("best"), F.min_by(F.when(F.col("nodes") <= high, pick), F.when(F.col("nodes") <= high, F.col("t"))).alias("fallback")).join(total)
    every = F.struct(F.lit(1).cast("long").alias("threshold"), F.col("all_n").alias("nodes"), F.col("all_e").alias("edges"))
    best = F.coalesce("best", every)
    chosen = F.when((best["nodes"] > high) & F.col("fallback").isNotNull(), F.col("fallback")).otherwise(best)
    return out.select(chosen.alias("c"), "all_e").select("c.*", F.when(F.col("all_e") > 0, F.floor(F.col("c.edges") / F.col("all_e") * 1000 + 0.5) / 10).otherwise(100.0).alias("edge_pct"))


def payload(entities: DataFrame, edges: DataFrame, clusters: DataFrame, bridge_scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the bridge score of the latest generation and their first community, and links."""
    from loam.operators.upkeep import first_cluster

    latest = bridge_scores.agg(F.max("generation").alias("generation"))
    scores = bridge_scores.join(F.broadcast(latest), "generation").select("id", "bridge_score")
    first = first_cluster(clusters).select(F.col("entity_id").alias("id"), F.col("cluster_id").alias("community"))
    nodes = entities.join(scores, "id", "left").join(first, "id", "left")
    return nodes.select("id", "name", "type", "mention_count", F.coalesce("bridge_score", F.lit(0.0)).alias("bridge_score"), "community"), edges.select("source", "target", "type", "weight")


def inside(edges: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """members: (community, node). The edges with both ends in one community, with the names of both: what a community's prompt tells."""
    m = members.select("community", "node").distinct()
    both = edges.join(m.withColumnRenamed("node", "source"), "source").join(m.withColumnRenamed("node", "target"), ["target", "community"])
    names = entities.select("id", "name")
    return both.join(names.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target").select("community", "source_name", "type", "target_name", "weight")


def bridge_listing(scores: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """scores: (generation, id, bridge_score). The best bridges of the latest generation with their names."""
    latest = scores.join(F.broadcast(scores.agg(F.max("generation").alias("generation"))), "generation")
    return latest.join(entities.select("id", "name", "type"), "id").orderBy(F.desc("bridge_score"), "id").limit(limit).select("id", "name", "type", "bridge_score")


def analysis(graph: DataFrame, members: DataFrame) -> DataFrame:
    """members: (node, community). Each community's size, coherence and share of the graph's nodes, largest first."""
    from loam.operators.graph import coherence

    size = members.groupBy("community").agg(F.count("*").alias("size"))
    total = members.agg(F.count("*").alias("all"))
    out = size.join(coherence(graph, members).select("community", "coherence"), "community", "left").join(F.broadcast(total))
    return out.select("community", "size", F.coalesce("coherence", F.lit(0.0)).alias("coherence"), F.round(F.col("size") / F.col("all"), 6).alias("share")).orderBy(F.desc("size"), "community")


def reflection(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """What the latest generation says, in one row: its number, communities, members, the largest community, bridges and the best of them."""
    g = clusters.agg(F.max("generation").alias("generation"))
    c = clusters.join(F.broadcast(g), "generation").groupBy("generation", "cluster_id").agg(F.count("*").alias("n"))
    c = c.groupBy("generation").agg(F.count("*").alias("n_communities"), F.sum("n").alias("n_members"), F.max_by("cluster_id", F.struct("n", "cluster_id")).alias("largest"))
    b = scores.join(F.broadcast(scores.agg(F.max("generation").alias("generation"))), "generation").agg(F.count("*").alias("n_bridges"), F.max_by("id", F.struct("bridge_score", "id")).alias("best_bridge"))
    return c.join(F.broadcast(b))
