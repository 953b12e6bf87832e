"""Queries of the graph's store, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.columns import visible
from loam.operators import centrality, exploration, graph, graph_store, louvain, resolution, temporal
from loam.plans import tables as t
from loam.plans.queries import INFORM, MEMBERS, ORACLES, bridge_table, graph_projection, nation_members, query
from loam.plans.tables import NOW, with_tables
from loam.sources.scratch import save

ALIASED = "al AS (SELECT *, [concat('aka ', lower(name)), concat('no ', id)] AS aliases FROM entities)"


def aliased(spark, d):
    return t.entities(spark, d).withColumn("aliases", F.array(F.concat(F.lit("aka "), F.lower("name")), F.concat(F.lit("no "), F.col("id"))))


@query(ALIASED + """, q AS (SELECT unnest(['supplier#000000003', 'AKA RED WIDGET', 'no p7', 'nothing', 'Small Ring']) AS q), m AS (SELECT q, al.*, CASE WHEN lower(name) = lower(q) THEN 0 WHEN list_contains(aliases, lower(q)) THEN 1 END AS w FROM q, al)
SELECT q, arg_min(id, (w, id)) AS id, arg_min(name, (w, id)) AS name FROM m WHERE w IS NOT NULL GROUP BY q""", "entities")
def entity_lookup(spark, d):
    e, out = aliased(spark, d), None
    for q in ("supplier#000000003", "AKA RED WIDGET", "no p7", "nothing", "Small Ring"):
        one = graph_store.by_name(e, q).select(F.lit(q).alias("q"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, name FROM entities WHERE type = 'person'", "entities")
def entities_of_type(spark, d):
    return t.entities(spark, d).filter("type = 'person'").select("id", "name")


@query("SELECT id, CASE WHEN scope IS NOT NULL AND scope <> 'global' AND scope <> 'tenant:b' THEN 'global' ELSE scope END AS scope FROM entities", "entities")
def scope_widening(spark, d):
    return t.entities(spark, d).select("id", graph_store.widened(F.col("scope"), F.lit("tenant:b")).alias("scope"))


EXTRACTED = """x AS (SELECT vec_id AS pos, CASE vec_id % 4 WHEN 0 THEN concat('SUPPLIER#', lpad(CAST(vec_id AS VARCHAR), 9, '0')) WHEN 1 THEN concat('Aka Supplier#', lpad(CAST(vec_id AS VARCHAR), 9, '0')) WHEN 2 THEN concat('thing ', vec_id // 100) ELSE concat('other ', vec_id) END AS name,
  CASE WHEN vec_id % 100 = 50 THEN 'tool' ELSE 'person' END AS type, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 25 IN (0, 1))"""


RESOLVED = ALIASED + ", " + EXTRACTED + """, y AS (SELECT *, min(pos) OVER (PARTITION BY lower(name)) AS leader FROM x), ld AS (SELECT * FROM y WHERE pos = leader),
n AS (SELECT pos, min(id) AS named FROM ld JOIN al ON lower(al.name) = lower(ld.name) GROUP BY pos), a AS (SELECT pos, min(id) AS alias FROM ld JOIN al ON list_contains(al.aliases, lower(ld.name)) GROUP BY pos),
v AS (SELECT concat('p', vec_id) AS id, e.type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN entities e ON e.id = concat('p', vec_id) WHERE vec_id % 25 NOT IN (0, 1)),
rs AS (SELECT ld.*, row_number() OVER (ORDER BY pos) AS k FROM ld ANTI JOIN n USING (pos) ANTI JOIN a USING (pos)),
c AS (SELECT pos, id, v.type, round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) AS c FROM v, rs),
kn AS (SELECT pos, list({'c': -c, 'id': id, 't': type}) AS near FROM c WHERE c >= 0.85 GROUP BY pos),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS entity_id, CAST([] AS STRUCT(id VARCHAR, t VARCHAR, q DOUBLE[])[]) AS s
  UNION ALL
  SELECT k, pos, CASE WHEN hit IS NULL THEN 'created' ELSE 'embedding' END, coalesce(hit.id, concat('new-', pos)), CASE WHEN hit IS NULL THEN list_append(s, {'id': concat('new-', pos), 't': type, 'q': q}) ELSE s END
  FROM (
    SELECT rs.k, rs.pos, rs.type, rs.q, f.s, list_filter(list_sort(list_concat(coalesce(near, CAST([] AS STRUCT(c DOUBLE, id VARCHAR, t VARCHAR)[])), list_filter(list_transform(f.s, lambda m: {'c': -round(list_cosine_similarity(m.q, rs.q), 6), 'id': m.id, 't': m.t}), lambda m: m.c <= -0.85)))[1:5], lambda m: m.c <= -0.95 OR m.t = rs.type)[1] AS hit
    FROM f JOIN rs ON rs.k = f.k + 1 LEFT JOIN kn ON kn.pos = rs.pos
  )
),
r AS (SELECT ld.pos AS leader, CASE WHEN named IS NOT NULL THEN 'exact_name' WHEN alias IS NOT NULL THEN 'alias' ELSE f.stage END AS stage, coalesce(named, alias, f.entity_id) AS entity_id FROM ld LEFT JOIN n USING (pos) LEFT JOIN a USING (pos) LEFT JOIN f ON f.pos = ld.pos),
rv AS (SELECT y.pos, y.name, y.type, CASE WHEN y.pos = y.leader THEN stage WHEN stage = 'created' THEN 'exact_name' WHEN stage = 'embedding' THEN 'alias' ELSE stage END AS stage, entity_id FROM y JOIN r USING (leader))"""


def extracted_names(spark, d):
    v = t.vectors(spark, d)
    asked = F.col("id") % 25
    lead = F.lpad(F.col("id").cast("string"), 9, "0")
    name = F.expr("CASE id % 4 WHEN 0 THEN concat('SUPPLIER#', l) WHEN 1 THEN concat('Aka Supplier#', l) WHEN 2 THEN concat('thing ', id div 100) ELSE concat('other ', id) END")
    batch = v.filter(asked.isin(0, 1)).withColumn("l", lead).select(F.col("id").alias("pos"), name.alias("name"), F.when(F.col("id") % 100 == 50, "tool").otherwise("person").alias("type"), "embedding")
    known = v.filter(~asked.isin(0, 1)).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "embedding")
    return batch, known.join(t.entities(spark, d).select("id"), "id", "left_semi")


@query(RESOLVED + " SELECT pos, stage, entity_id FROM rv", "entities", True)
def resolve_entities(spark, d):
    batch, known = extracted_names(spark, d)
    return resolution.resolve(batch, aliased(spark, d), known)


@query(RESOLVED + f""", m AS (SELECT entity_id AS id, count(*) AS n, max(CASE WHEN stage = 'created' THEN name END) AS made, max(CASE WHEN stage = 'created' THEN type END) AS kind FROM rv GROUP BY 1),
ap AS (SELECT entity_id AS id, list(name ORDER BY pos) AS more FROM (SELECT entity_id, min(pos) AS pos, arg_min(name, pos) AS name FROM rv WHERE stage = 'embedding' GROUP BY entity_id, lower(name)) GROUP BY 1)
SELECT m.id, coalesce(al.name, made) AS name, coalesce(al.type, kind) AS type, len(coalesce(al.aliases, [])) + len(list_filter(coalesce(more, []), lambda x: NOT list_contains(coalesce(al.aliases, []), lower(x)) AND lower(x) <> lower(coalesce(al.name, made)))) AS n_aliases, coalesce(al.mention_count, 0) + n AS mention_count, coalesce(al.first_seen, {NOW}) AS first_seen
FROM m LEFT JOIN al USING (id) LEFT JOIN ap USING (id)""", "entities", True)
def resolved_entities(spark, d):
    batch, known = extracted_names(spark, d)
    e = aliased(spark, d)
    found = resolution.resolve(batch, e, known)
    out = resolution.applied(batch.withColumn("scope", F.lit("global")), found, e, NOW)
    return out.join(found.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi").select("id", "name", "type", F.size("aliases").alias("n_aliases"), "mention_count", "first_seen")


SEEN = "sn AS (SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, CASE WHEN l_linenumber = 1 THEN 'uses' ELSE 'made_by' END AS type, l_orderkey AS memory_id, CASE WHEN l_orderkey % 2 = 0 THEN 'tenant:a' ELSE 'tenant:b' END AS scope FROM lineitem WHERE l_returnflag = 'R')"


@query(SEEN + """, nw AS (SELECT source, target, type, list_sort(list(DISTINCT memory_id)) AS more, min(scope) AS lo, max(scope) AS hi FROM sn GROUP BY ALL),
u AS (SELECT coalesce(r.source, nw.source) AS source, coalesce(r.target, nw.target) AS target, coalesce(r.type, nw.type) AS type, weight, coalesce(source_memories, []) AS old, coalesce(more, []) AS more, CASE WHEN r.source IS NULL THEN lo ELSE 'tenant:a' END AS own, lo, hi, CASE WHEN nw.source IS NULL AND weight > 2 THEN 5 END AS stale_since
  FROM relationships r FULL JOIN nw ON r.source = nw.source AND r.target = nw.target AND r.type = nw.type), w AS (SELECT *, CASE WHEN lo <> own THEN lo ELSE hi END AS f FROM u)
SELECT source, target, type, coalesce(weight, 1.0) AS weight, array_to_string(list_concat(old, list_filter(more, lambda x: NOT list_contains(old, x))), ',') AS evidence, CASE WHEN own <> 'global' AND f IS NOT NULL AND f <> own THEN 'global' ELSE own END AS scope, CAST(stale_since AS BIGINT) AS stale_since FROM w""", "relationships")
def upsert_edges(spark, d):
    line = t.given(spark, d, "lineitem").filter("l_returnflag = 'R'")
    seen = line.selectExpr("concat('s', l_suppkey) AS source", "concat('p', l_partkey) AS target", "CASE WHEN l_linenumber = 1 THEN 'uses' ELSE 'made_by' END AS type", "l_orderkey AS memory_id", "CASE WHEN l_orderkey % 2 = 0 THEN 'tenant:a' ELSE 'tenant:b' END AS scope")
    known = t.relationships(spark, d).withColumn("scope", F.lit("tenant:a")).withColumn("stale_since", F.when(F.col("weight") > 2, F.lit(5).cast("long")))
    out = graph_store.upsert_edges(known, seen)
    return out.select("source", "target", "type", "weight", F.array_join("source_memories", ",").alias("evidence"), "scope", "stale_since")


@query("""n AS (SELECT concat('n', c_nationkey) AS source, concat('c', c_custkey) AS target, 'has' AS type, 2.0 AS weight FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'part_of', 9.0 FROM supplier)
SELECT source, target, type, weight FROM relationships UNION ALL SELECT * FROM n WHERE NOT EXISTS (FROM relationships r WHERE r.source = n.source AND r.target = n.target AND r.type = n.type)""", "relationships")
def insert_edges(spark, d):
    new = t.given(spark, d, "customer").selectExpr("concat('n', c_nationkey) AS source", "concat('c', c_custkey) AS target", "'has' AS type", "2.0D AS weight")
    known = t.given(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS source", "concat('n', s_nationkey) AS target", "'part_of' AS type", "9.0D AS weight")
    return graph_store.insert_edges(t.relationships(spark, d).select("source", "target", "type", "weight"), new.unionByName(known))


@query("""i AS (SELECT id, pos FROM (SELECT min(id) AS id, pos FROM entities JOIN (SELECT unnest(['supplier#000000001', 'SUPPLIER#000000004', 'nation_2', 'unknown']) AS n, unnest([0, 1, 2, 3]) AS pos) ON lower(name) = lower(n) GROUP BY pos)),
p AS (SELECT a.id AS source, b.id AS target FROM i a JOIN i b ON a.pos < b.pos)
SELECT 'entity' AS kind, id AS a, '' AS b, CAST(mention_count + 1 AS DOUBLE) AS value FROM entities WHERE id IN (SELECT id FROM i) UNION ALL SELECT 'edge', source, target, 1.0 FROM p""", "entities")
def link_memory(spark, d):
    e, r = graph_store.link_memory(t.entities(spark, d), t.relationships(spark, d), ["supplier#000000001", "SUPPLIER#000000004", "nation_2", "unknown"], 7, NOW)
    one = e.filter(F.col("last_seen") == NOW).select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("mention_count").cast("double").alias("value"))
    return one.unionByName(r.filter("type = 'related_to'").select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").alias("value")))


@query("s AS (SELECT concat('p', l_partkey) AS id, l_orderkey AS c FROM lineitem WHERE l_linenumber <= 2), j AS (SELECT DISTINCT concat('p', l_partkey) AS id, l_orderkey AS c FROM lineitem WHERE l_linenumber = 1), u AS (SELECT * FROM j UNION SELECT * FROM s) SELECT e.id, mention_count + coalesce(n, 0) AS mention_count, coalesce(k, 0) AS conversations FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM s GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(*) AS k FROM u GROUP BY 1) USING (id)", "entities")
def record_mentions(spark, d):
    line = t.given(spark, d, "lineitem").selectExpr("concat('p', l_partkey) AS id", "l_orderkey AS conversation_id", "l_linenumber AS n")
    e, j = graph_store.mentions(t.entities(spark, d), line.filter("n = 1").select("id", "conversation_id").distinct(), line.filter("n <= 2"), NOW)
    k = j.groupBy("id").agg(F.count("*").alias("k"))
    return e.join(k, "id", "left").select("id", "mention_count", F.coalesce("k", F.lit(0)).alias("conversations"))


@query("""g AS (SELECT id FROM entities WHERE stale_since IS NOT NULL) SELECT 'entities' AS name, count(*) AS n FROM entities WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edges', count(*) FROM relationships WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)
UNION ALL SELECT 'junction', count(*) FROM (SELECT DISTINCT concat('p', l_partkey) AS id, l_orderkey FROM lineitem) WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'bridges', count(*) FROM (SELECT DISTINCT source AS id FROM relationships) WHERE id NOT IN (SELECT id FROM g)""", "entities relationships")
def delete_cascade(spark, d):
    e = t.entities(spark, d)
    junction = t.given(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_orderkey").alias("conversation_id")).distinct()
    bridges = t.relationships(spark, d).select(F.col("source").alias("id")).distinct()
    left = graph_store.delete_cascade(e.filter("stale_since IS NOT NULL"), e, t.relationships(spark, d), junction, bridges)
    out = None
    for name, df in zip(("entities", "edges", "junction", "bridges"), left, strict=True):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""r AS (SELECT *, CASE WHEN type = 'part_of' AND substr(source, 1, 1) = 'n' THEN 1 END AS stale FROM relationships), live AS (SELECT * FROM r WHERE NOT (stale IS NOT NULL AND len(source_memories) = 0)),
x AS (SELECT id, stale_since, CASE WHEN type = 'project' THEN 0 ELSE mention_count END AS m, CASE WHEN type = 'project' AND id <> 'r1' THEN 900000000 ELSE last_seen END AS ls FROM entities)
SELECT 'edge' AS kind, concat(source, '>', target) AS id, 'stale' AS reason FROM r WHERE stale IS NOT NULL AND len(source_memories) = 0
UNION ALL SELECT 'entity', id, CASE WHEN stale_since IS NOT NULL AND m <= 0 THEN 'stale' ELSE 'orphan' END FROM x WHERE id NOT IN (SELECT source FROM live UNION SELECT target FROM live) AND ((stale_since IS NOT NULL AND m <= 0) OR (m < 2 AND ls < {NOW} - 90 * 86400))""", "entities relationships")
def prune_orphans(spark, d):
    e = t.entities(spark, d).withColumn("last_seen", F.expr("CASE WHEN type = 'project' AND id <> 'r1' THEN 900000000 ELSE last_seen END"))
    r = t.relationships(spark, d).withColumn("stale_since", F.expr("CASE WHEN type = 'part_of' AND substr(source, 1, 1) = 'n' THEN 1 END"))
    edges, gone = graph_store.prune_orphans(e, r, NOW)
    return edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), F.lit("stale").alias("reason")).unionByName(gone.select(F.lit("entity").alias("kind"), "id", "reason"))


@query("SELECT 'clusters' AS name, count(*) FILTER (generation >= 2) AS kept, count(*) FILTER (generation < 2) AS pruned FROM clusters UNION ALL SELECT 'bridges', count(*) FILTER (generation >= 2), count(*) FILTER (generation < 2) FROM b".replace("SELECT 'clusters'", INFORM.split(",\nlt AS")[0] + " SELECT 'clusters'"), "relationships clusters")
def prune_generations(spark, d):
    c = t.clusters(spark, d)
    return graph_store.kept_generations({"clusters": c, "bridges": bridge_table(spark, d)}, c, 0)


@query("SELECT generation, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters FROM (SELECT * FROM clusters UNION ALL SELECT 3, concat('x', s_nationkey), concat('s', s_suppkey) FROM supplier) GROUP BY 1", "clusters")
def persist_clusters(spark, d):
    new = t.given(spark, d, "supplier").selectExpr("concat('x', s_nationkey) AS cluster_id", "concat('s', s_suppkey) AS entity_id")
    return graph_store.persist_clusters(t.clusters(spark, d), new).groupBy("generation").agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("n_clusters"))


@query(MEMBERS.split(", g AS")[0] + " SELECT community, count(*) AS size, md5(string_agg(node, ',' ORDER BY node)) AS members FROM mem GROUP BY 1", "clusters")
def community_groups(spark, d):
    return graph_store.groups(nation_members(spark, d))




@query("c AS (SELECT cluster_id AS community, entity_id AS node FROM clusters WHERE generation = 2), n AS (SELECT c.*, name, row_number() OVER (PARTITION BY community ORDER BY node) AS k, count(*) OVER (PARTITION BY community) AS z FROM c JOIN entities e ON e.id = node) SELECT community, concat('Community ', community) AS name, concat(string_agg(name, ', ' ORDER BY k) FILTER (k <= 3), CASE WHEN max(z) > 3 THEN concat(' and ', max(z) - 3, ' more') ELSE '' END) AS description FROM n GROUP BY community", "clusters entities")
def community_names(spark, d):
    c = t.clusters(spark, d).filter("generation = 2").select(F.col("cluster_id").alias("community"), F.col("entity_id").alias("node"))
    return graph_store.fallback_names(c, t.entities(spark, d))


@query(None)
def bridge_entities(spark, d):
    """No SQL form: weighted shortest paths from every node. Tests hold it against brute force. The communities are those of the graph itself, so any node may be a bridge."""
    g, nodes = save(graph_projection(spark, d)), save(t.entities(spark, d).select(F.col("id").alias("node")))
    return centrality.bridges(g, louvain.communities(g, nodes), nodes)


@query("""y AS (SELECT source AS n, target AS o, type, weight FROM relationships UNION ALL SELECT target, source, type, weight FROM relationships),
a1 AS (SELECT o AS node, max(weight) AS weight, 1 AS hop FROM y WHERE n = 's3' GROUP BY o), a2 AS (SELECT o AS node, max(weight) AS weight, 2 AS hop FROM y WHERE n IN (SELECT node FROM a1) AND o <> 's3' AND o NOT IN (SELECT node FROM a1) GROUP BY o),
k AS (SELECT * FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) ORDER BY weight DESC, hop, node LIMIT 25), c AS (SELECT cluster_id AS community, generation FROM clusters WHERE entity_id = 's3' ORDER BY generation, cluster_id LIMIT 1),
z AS (SELECT max(community) AS community, count(*) AS community_size FROM clusters JOIN c ON c.community = cluster_id AND c.generation = clusters.generation)
SELECT node, name, type, CAST(hop AS BIGINT) AS hop, weight, community, community_size FROM k JOIN entities e ON e.id = node, z WHERE coalesce(scope, 'global') = 'global'""", "entities relationships clusters")
def explore_entity(spark, d):
    return graph_store.explore_entity(t.relationships(spark, d), aliased(spark, d), t.clusters(spark, d), "aka supplier#000000003", 2, scopes=["global"])


@query(None)
def explore_selective(spark, d):
    """No SQL form: nodes are taken in order until there are enough. Tests hold it against a plain walk."""
    e = t.entities(spark, d)
    score = e.select("id", (F.coalesce(F.col("mention_count"), F.lit(0)) % 10 / 10.0).alias("score"))
    return exploration.selective(t.relationships(spark, d), e, "s1", score).nodes.select("id", "hop", "relevance", F.array_join("path", " / ").alias("path"))


@query("""h AS (SELECT DISTINCT mention_count AS t FROM entities WHERE mention_count BETWEEN 1 AND 100), a AS (SELECT (SELECT count(*) FROM entities) AS an, (SELECT count(*) FROM relationships) AS ae),
k AS (SELECT t, (SELECT count(*) FROM entities WHERE mention_count >= t) AS nodes, (SELECT count(*) FROM relationships r JOIN entities x ON x.id = source JOIN entities y ON y.id = target WHERE least(x.mention_count, y.mention_count) >= t) AS edges FROM h),
s AS (SELECT *, round((edges / ae) / (nodes / an), 9) AS ratio FROM k, a), f AS (SELECT * FROM s WHERE (nodes <= 4000 OR t = 1) AND nodes >= 1500 AND ratio >= 1 ORDER BY ratio DESC, t DESC LIMIT 1),
o AS (SELECT coalesce((SELECT t FROM f), 1) AS t, coalesce((SELECT nodes FROM f), an) AS nodes, coalesce((SELECT edges FROM f), ae) AS edges, ae FROM a), b AS (SELECT * FROM s WHERE nodes <= 4000 ORDER BY t LIMIT 1),
c AS (SELECT CASE WHEN o.nodes > 4000 AND (SELECT count(*) FROM b) > 0 THEN (SELECT t FROM b) ELSE t END AS t, CASE WHEN o.nodes > 4000 AND (SELECT count(*) FROM b) > 0 THEN (SELECT nodes FROM b) ELSE nodes END AS nodes, CASE WHEN o.nodes > 4000 AND (SELECT count(*) FROM b) > 0 THEN (SELECT edges FROM b) ELSE edges END AS edges, ae FROM o)
SELECT CAST(t AS BIGINT) AS threshold, nodes, edges, floor(edges / ae * 1000 + 0.5) / 10 AS edge_pct FROM c""", "entities relationships")
def optimal_threshold(spark, d):
    return graph_store.threshold(t.entities(spark, d), t.relationships(spark, d))


@query(INFORM + ", c1 AS (SELECT entity_id AS id, arg_min(cluster_id, (generation, cluster_id)) AS community FROM clusters GROUP BY 1) SELECT e.id, name, type, mention_count, CAST(coalesce(bridge_score, 0) AS DOUBLE) AS bridge_score, community FROM entities e LEFT JOIN lt USING (id) LEFT JOIN c1 USING (id)", "entities relationships clusters")
def graph_payload(spark, d):
    return graph_store.payload(t.entities(spark, d), t.relationships(spark, d), t.clusters(spark, d), bridge_table(spark, d))[0]


@query("s AS (SELECT id, name, stale_since, count(*) OVER () AS n FROM entities WHERE stale_since IS NOT NULL) SELECT id, name, stale_since, n FROM s ORDER BY stale_since DESC, name, id LIMIT 10", "entities")
def stale_summary(spark, d):
    stale = t.entities(spark, d).filter("stale_since IS NOT NULL")
    return stale.orderBy(F.desc("stale_since"), "name", "id").limit(10).join(F.broadcast(stale.agg(F.count("*").alias("n")))).select("id", "name", "stale_since", "n")


@query(f"SELECT 'node' AS kind, id, CASE WHEN first_seen > 950000000 THEN 'new' ELSE 'updated' END AS change FROM entities WHERE first_seen > 950000000 OR (last_seen > 950000000 AND first_seen <= 950000000) UNION ALL SELECT 'link', concat(r.source, '>', r.target), CASE WHEN f > 950000000 THEN 'new' ELSE 'updated' END FROM (SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, min(CAST(epoch(l_shipdate) AS BIGINT)) AS f, max(CAST(epoch(l_shipdate) AS BIGINT)) AS z FROM lineitem GROUP BY 1, 2) r WHERE f > 950000000 OR (z > 950000000 AND f <= 950000000)", "entities")
def graph_changes(spark, d):
    links = t.given(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey"), F.lit(">p"), F.col("l_partkey")).alias("id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts")).groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return temporal.changes(t.entities(spark, d), "node", 950_000_000).unionByName(temporal.changes(links, "link", 950_000_000))


@query(MEMBERS + """, p AS (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i FROM j WHERE ca IS NOT NULL UNION ALL SELECT cb, 0 FROM j WHERE cb IS NOT NULL AND (ca IS NULL OR ca <> cb)), co AS (SELECT avg(x) AS a FROM (SELECT c, round(sum(i) / count(*), 6) AS x FROM p GROUP BY c)),
k AS (SELECT * FROM j WHERE ca IS NOT NULL AND cb IS NOT NULL), m AS (SELECT sum(weight) AS m FROM k), w AS (SELECT ca AS c, sum(weight) AS w FROM k WHERE ca = cb GROUP BY 1), dg AS (SELECT c, sum(weight) AS dg FROM (SELECT ca AS c, weight FROM k UNION ALL SELECT cb, weight FROM k) GROUP BY c)
SELECT (SELECT count(*) FROM entities) AS n_nodes, (SELECT count(*) FROM relationships) AS n_edges, (SELECT round(sum(coalesce(w, 0) / m - pow(dg / (2 * m), 2)), 6) FROM dg LEFT JOIN w USING (c), m) AS modularity, (SELECT round(a, 6) FROM co) AS coherence, (SELECT count(DISTINCT community) FROM mem) AS n_communities""", "entities relationships")
def graph_report(spark, d):
    g, m = graph_projection(spark, d), nation_members(spark, d)
    inside = g.join(m.select(F.col("node").alias("a")), "a", "left_semi").join(m.select(F.col("node").alias("b")), "b", "left_semi")
    return (
        t.entities(spark, d).agg(F.count("*").alias("n_nodes")).join(t.relationships(spark, d).agg(F.count("*").alias("n_edges"))).join(graph.modularity(inside, m))
        .join(graph.coherence(g, m).agg(F.round(F.avg("coherence"), 6).alias("coherence"))).join(m.agg(F.countDistinct("community").alias("n_communities")))
    )


# Temporal patterns


@query("w AS (SELECT CAST(floor(first_seen / 604800) AS BIGINT) AS w, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, string_agg(name, '|' ORDER BY id) AS names FROM entities WHERE first_seen IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT w * 604800 AS time_start, n, md5(ids) AS ids, md5(names) AS names FROM w", "entities")
def window_members(spark, d):
    w = temporal.window_members(t.entities(spark, d), 7, 3)
    return w.select("time_start", "n", F.md5(F.array_join("entity_ids", ",")).alias("ids"), F.md5(F.array_join("names", "|")).alias("names"))


@query("""a AS (SELECT cluster_id AS c, list(DISTINCT entity_id) AS m FROM clusters WHERE generation = 2 GROUP BY 1), b AS (SELECT cluster_id AS c, list(DISTINCT entity_id) AS m FROM clusters WHERE generation = 1 GROUP BY 1)
SELECT a.c AS cluster_id, len(list_filter(a.m, lambda x: NOT list_contains(b.m, x))) AS gained, len(list_filter(b.m, lambda x: NOT list_contains(a.m, x))) AS lost FROM a JOIN b USING (c)""", "clusters")
def members_gained_lost(spark, d):
    c = t.clusters(spark, d)
    return temporal.gained_lost(c.filter("generation = 1"), c.filter("generation = 2"))


PATTERNS = ", ".join(f"p{i} AS ({ORACLES[name]})" for i, name in enumerate(("entity_bursts", "topic_emergence", "topic_decay", "community_evolution"), 1))


@query(f"""WITH {PATTERNS}, br AS ({with_tables("clusters", "SELECT entity_id, generation FROM clusters WHERE CAST(substr(cluster_id, 2) AS BIGINT) % 5 = generation")}), g AS (SELECT max(generation) AS z FROM br),
y AS (SELECT max(generation) AS y FROM br, g WHERE generation < z), nb AS (SELECT list(DISTINCT entity_id ORDER BY entity_id) AS ids FROM br, g WHERE generation = z AND entity_id NOT IN (SELECT entity_id FROM br, y WHERE generation = y))
SELECT 'entity_burst' AS kind, CAST(time_start AS VARCHAR) AS subject, n, CAST(confidence AS DOUBLE) AS confidence FROM p1 UNION ALL SELECT 'topic_emergence', CAST(time_start AS VARCHAR), n, confidence FROM p2 UNION ALL SELECT 'topic_decay', CAST(time_start AS VARCHAR), n, confidence FROM p3
UNION ALL SELECT 'community_evolution', concat(change, ':', cluster_id), coalesce(current_size, previous_size), confidence FROM p4 UNION ALL SELECT 'bridge_formation', array_to_string(ids[1:3], ', '), len(ids), round(least(0.9, 0.5 + len(ids) * 0.1), 6) FROM nb WHERE len(ids) > 0""")
def temporal_patterns(spark, d):
    """All five kinds in one list, best first; each kind has a query with SQL of its own."""
    c = t.clusters(spark, d)
    scores = c.filter(F.substring("cluster_id", 2, 9).cast("long") % 5 == F.col("generation")).select("entity_id", "generation", (F.substring("entity_id", 2, 9).cast("long") * 1.5).alias("bridge_score"))
    return temporal.patterns(t.entities(spark, d), c, scores, NOW)


@query("br AS (SELECT entity_id, generation FROM clusters WHERE CAST(substr(cluster_id, 2) AS BIGINT) % 5 = generation), g AS (SELECT max(generation) AS z, (SELECT max(generation) FROM br WHERE generation < (SELECT max(generation) FROM br)) AS y FROM br), n AS (SELECT DISTINCT entity_id FROM br, g WHERE generation = z AND entity_id NOT IN (SELECT entity_id FROM br, g WHERE generation = y)) SELECT 'bridge_formation' AS kind, count(*) AS n, md5(string_agg(entity_id, ',' ORDER BY entity_id)) AS ids, CAST(round(least(0.9, 0.5 + count(*) * 0.1), 6) AS DOUBLE) AS confidence FROM n HAVING count(*) > 0", "clusters")
def bridge_pattern(spark, d):
    scores = t.clusters(spark, d).filter(F.substring("cluster_id", 2, 9).cast("long") % 5 == F.col("generation")).select("entity_id", "generation", F.lit(1.0).alias("bridge_score"))
    p = temporal.bridge_pattern(scores)
    return p.select("kind", "n", F.md5(F.array_join("entity_ids", ",")).alias("ids"), "confidence")


@query("""m AS (SELECT cluster_id AS community, entity_id AS node FROM clusters WHERE generation = 2 UNION SELECT cluster_id, concat('n', substr(cluster_id, 2)) FROM clusters WHERE generation = 2)
SELECT x.community, a.name AS source_name, r.type, b.name AS target_name, weight FROM relationships r JOIN m x ON x.node = source JOIN m y ON y.node = target AND y.community = x.community JOIN entities a ON a.id = source JOIN entities b ON b.id = target""", "entities relationships clusters")
def community_edges(spark, d):
    c = t.clusters(spark, d).filter("generation = 2")
    m = c.select(F.col("cluster_id").alias("community"), F.col("entity_id").alias("node")).unionByName(c.select(F.col("cluster_id").alias("community"), F.concat(F.lit("n"), F.substring("cluster_id", 2, 9)).alias("node")))
    return graph_store.inside(t.relationships(spark, d), m, t.entities(spark, d))


@query(INFORM + " SELECT id, name, type, CAST(bridge_score AS DOUBLE) AS bridge_score FROM lt JOIN entities USING (id) ORDER BY bridge_score DESC, id LIMIT 20", "entities relationships")
def bridge_listing(spark, d):
    return graph_store.bridge_listing(bridge_table(spark, d), t.entities(spark, d))


@query(MEMBERS + ", p AS (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i FROM j WHERE ca IS NOT NULL UNION ALL SELECT cb, 0 FROM j WHERE cb IS NOT NULL AND (ca IS NULL OR ca <> cb)), co AS (SELECT c AS community, round(sum(i) / count(*), 6) AS coherence FROM p GROUP BY c) SELECT community, count(*) AS size, coalesce(max(coherence), 0.0) AS coherence, round(count(*) / (SELECT count(*) FROM mem), 6) AS share FROM mem LEFT JOIN co USING (community) GROUP BY community", "entities relationships")
def community_analysis(spark, d):
    return graph_store.analysis(graph_projection(spark, d), nation_members(spark, d))


@query(INFORM + ", c2 AS (SELECT cluster_id, count(*) AS n FROM clusters WHERE generation = (SELECT max(generation) FROM clusters) GROUP BY 1) SELECT (SELECT max(generation) FROM clusters) AS generation, count(*) AS n_communities, CAST(sum(n) AS BIGINT) AS n_members, arg_max(cluster_id, (n, cluster_id)) AS largest, (SELECT count(*) FROM lt) AS n_bridges, (SELECT arg_max(id, (bridge_score, id)) FROM lt) AS best_bridge FROM c2", "relationships clusters entities")
def reflection(spark, d):
    return graph_store.reflection(t.clusters(spark, d), bridge_table(spark, d))
