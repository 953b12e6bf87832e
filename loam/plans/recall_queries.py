"""Queries of recall over all sources, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.columns import iso, visible
from loam.operators import lifecycle, recall, search
from loam.plans import tables as t
from loam.plans.memory_queries import cited
from loam.plans.queries import EXC_WEIGHTS, MEM_WEIGHTS, R, STABLE, TERMS, TEXT_QUERY, bm25_sql, exchange_vectors, floored_sql, inlined, knn_sql, multi_source_recall, q_vector, query
from loam.plans.queries import SEMANTIC, episodic_sql
from loam.plans.tables import NOW

NAME_TERMS = ["the", "red", "widget", "of", "nation"]


def names_bm25(k: int) -> str:
    """bm25_sql over the entities' names, with the words above."""
    sql = bm25_sql("eb", "entities", {"name": 1.0}, k)
    for i, (old, new) in enumerate(zip(TERMS, NAME_TERMS)):
        sql = sql.replace(f"w = '{old}'", f"w = '{new}'")
    extra = f"CAST(1.0 * len(list_filter(w_name, lambda w: w = '{NAME_TERMS[4]}')) AS DOUBLE)"
    return sql.replace(f"w = '{NAME_TERMS[3]}')) AS DOUBLE))", f"w = '{NAME_TERMS[3]}')) AS DOUBLE), {extra})").replace("count(*) FILTER (tf[4] > 0))", "count(*) FILTER (tf[4] > 0), count(*) FILTER (tf[5] > 0))").replace("range(1, 5)", "range(1, 6)")


GRAPH = (
    "ev AS (SELECT concat('p', vec_id) AS id, embedding FROM embeddings WHERE concat('p', vec_id) IN (SELECT id FROM entities)), " + knn_sql("k", "ev", 10) + ", " + names_bm25(10)
    + f""", f AS (SELECT id, sum(1 / (60 + rank)) AS score, min(which * 1000 + rank) AS o FROM (SELECT id, rank, 0 AS which FROM k UNION ALL SELECT id, rank, 1 FROM eb) GROUP BY id), n AS (SELECT id, round(score, 6) AS score, o FROM {floored_sql('f')}),
gs AS (SELECT e.id, e.name, e.type, score FROM n JOIN entities e USING (id) WHERE coalesce(scope, 'global') = 'global' ORDER BY score DESC, o LIMIT 10),
y AS (SELECT source AS id, target AS other, type, weight, true AS out FROM relationships UNION ALL SELECT target, source, type, weight, false FROM relationships), top AS (SELECT y.*, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other, type, out) AS n FROM y SEMI JOIN gs USING (id)),
rl AS (SELECT top.id, string_agg(concat(CASE WHEN out THEN '-> ' ELSE '<- ' END, top.type, ' ', coalesce(e.name, other)), ', ' ORDER BY n) AS rels FROM top LEFT JOIN entities e ON e.id = other WHERE n <= 10 GROUP BY 1),
gr AS (SELECT id, name, type, score, concat(name, ' (', type, '): No description', CASE WHEN rels IS NULL THEN '' ELSE concat(chr(10), 'Relationships: ', rels) END) AS content FROM gs LEFT JOIN rl USING (id))"""
)


def graph_rows(spark, d):
    e = t.entities(spark, d)
    v = t.vectors(spark, d).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "embedding").join(e.select("id"), "id", "left_semi")
    return recall.graph_search(e, v, t.text_index(spark, d, "entities"), t.relationships(spark, d), NAME_TERMS, q_vector(spark, d), scopes=["global"])


@query(GRAPH + " SELECT id, name, type, score, md5(content) AS content_md5 FROM gr", "entities relationships")
def graph_search(spark, d):
    return graph_rows(spark, d).select("id", "name", "type", "score", F.md5("content").alias("content_md5"))


MULTI = (
    inlined(SEMANTIC, "sem") + ", " + inlined(episodic_sql("hybrid"), "ep") + """,
m AS (SELECT CAST(id AS VARCHAR) AS id, token_estimate, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM sem), e2 AS (SELECT id, token_estimate, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ep),
u AS (SELECT id, sum(1 / (60 + rank)) AS score FROM (SELECT id, rank FROM e2 UNION ALL SELECT id, rank FROM m) GROUP BY id),
ms AS (SELECT u.id, CASE WHEN m.id IS NULL THEN 'episodic' ELSE 'semantic' END AS source, round(u.score, 6) AS score, coalesce(m.token_estimate, e2.token_estimate) AS token_estimate FROM """ + floored_sql("u") + """ u LEFT JOIN m ON m.id = u.id LEFT JOIN e2 ON e2.id = u.id ORDER BY score DESC, source, u.id LIMIT 20)"""
)
ALL = MULTI + ", " + inlined(GRAPH, "gr") + ", al AS (SELECT * FROM ms UNION ALL SELECT id, 'graph', score, CAST(ceil(length(content) / 4 * CAST(1.1 AS DOUBLE)) AS BIGINT) FROM gr)"


@query(ALL + " SELECT * FROM al", "memories exchanges entities relationships")
def recall_all_sources(spark, d):
    return recall.appended(multi_source_recall(spark, d), graph_rows(spark, d))


@query(ALL + """, z AS (SELECT id, source, token_estimate, round(score * CASE source WHEN 'semantic' THEN 1.3 WHEN 'graph' THEN 1.1 ELSE 1.0 END, 6) AS boosted FROM al), zn AS (SELECT *, row_number() OVER (ORDER BY boosted DESC, id) AS n FROM z),
g AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS id UNION ALL SELECT zn.n, CASE WHEN g.used + token_estimate <= 2000 THEN g.used + token_estimate ELSE g.used END, CASE WHEN g.used + token_estimate <= 2000 THEN zn.id END FROM g JOIN zn ON zn.n = g.n + 1)
SELECT zn.id, zn.source, token_estimate, boosted FROM g JOIN zn ON zn.id = g.id""", "memories exchanges entities relationships", True)
def recall_packed(spark, d):
    return search.pack_budget(recall_all_sources(spark, d), 2000)


@query(ALL + f", hit AS (SELECT CAST(id AS BIGINT) AS id FROM al WHERE source = 'semantic') SELECT m.id, round({STABLE} * (1 + 0.2 * (1 - ({R}))), 6) AS stability, access_count + 1 AS access_count FROM memories m SEMI JOIN hit ON hit.id = m.id WHERE is_active", "memories exchanges entities relationships")
def recall_reinforced(spark, d):
    found = recall_all_sources(spark, d).filter("source = 'semantic'").select(F.col("id").cast("long").alias("id"))
    return lifecycle.reinforce(t.memories(spark, d), found, NOW).select("id", "stability", "access_count")


@query(
    "xs AS (SELECT * FROM exchanges WHERE coalesce(scope, 'global') = 'global' AND strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') >= '2023-11-16'), ev AS (SELECT e.id, v.embedding FROM xs e JOIN embeddings v ON v.vec_id = e.conversation_id * 5 + e.exchange_index), "
    + knn_sql("k", "ev", 20) + ", " + bm25_sql("b", "xs", EXC_WEIGHTS, 20) + f""", f AS (SELECT id, sum(1 / (60 + rank)) AS score, min(which * 1000 + rank) AS o FROM (SELECT id, rank, 0 AS which FROM k UNION ALL SELECT id, rank, 1 FROM b) GROUP BY id),
epi AS (SELECT id, round(score, 6) AS score, o FROM {floored_sql('f')} ORDER BY score DESC, o LIMIT 10) SELECT e.id, conversation_id, score, token_estimate FROM epi JOIN exchanges e USING (id)""", "exchanges")  # fmt: skip
def episodic_recall_filtered(spark, d):
    where = visible(F.col("scope"), ["global"]) & (iso(F.col("ts")) >= "2023-11-16")
    return search.episodic(t.exchanges(spark, d), exchange_vectors(spark, d), t.text_index(spark, d, "exchanges"), TEXT_QUERY, q_vector(spark, d), where=where).select("id", "conversation_id", "score", "token_estimate")


@query(
    "act AS (SELECT * FROM memories WHERE is_active AND type IN ('fact', 'decision') AND coalesce(scope, 'global') = 'global'), v AS (SELECT vec_id AS id, embedding FROM embeddings SEMI JOIN act ON vec_id = id), " + knn_sql("k", "v", 20) + ", " + bm25_sql("b", "act", MEM_WEIGHTS, 20)
    + f""", f AS (SELECT id, sum(1 / (60 + rank)) AS rrf FROM (SELECT id, rank FROM k UNION ALL SELECT id, rank FROM b) GROUP BY id), c AS (SELECT id, type, round(0.55 * rrf + 0.25 * ({R}) + 0.20 * importance, 9) AS score FROM f JOIN memories USING (id))
SELECT id, type, round(score, 6) AS score FROM {floored_sql('c')} ORDER BY score DESC, id LIMIT 10""", "memories")  # fmt: skip
def semantic_recall_filtered(spark, d):
    return search.semantic(t.memories(spark, d), t.vectors(spark, d), t.text_index(spark, d, "memories"), TEXT_QUERY, q_vector(spark, d), NOW, kinds=["fact", "decision"], scopes=["global"]).select("id", "type", "score")


@query("v AS (SELECT vec_id AS id, embedding FROM embeddings SEMI JOIN memories ON vec_id = id), " + knn_sql("k", "v", 30) + """, h AS (SELECT k.id, cosine, rank, CAST(length(content) % 17 AS DOUBLE) AS s FROM k JOIN memories USING (id)), b AS (SELECT id, rank, round(CAST(0.7 AS DOUBLE) * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) + (1 - CAST(0.7 AS DOUBLE)) * cosine, 5) AS score FROM h WHERE rank <= 20)
SELECT id, score FROM (SELECT * FROM b ORDER BY score DESC, rank LIMIT 5) UNION ALL SELECT id, round(cosine, 5) FROM k WHERE rank > 20""", "memories")
def rerank(spark, d):
    m = t.memories(spark, d).select("id", "content")
    near = search.bounded(search.knn_topk(t.vectors(spark, d).join(m.select("id"), "id", "left_semi"), q_vector(spark, d), 30).select("id", F.col("cosine").alias("score"), "rank"))
    return recall.reranked(search.picked(m, near), lambda content: (F.length(content) % 17).cast("double"))


PICKED = "pk AS (SELECT id, conversation_id, exchange_index FROM exchanges ORDER BY exchange_index DESC, id LIMIT 1)"


@query(PICKED + " SELECT CASE WHEN e.exchange_index < pk.exchange_index THEN 'before' WHEN e.exchange_index > pk.exchange_index THEN 'after' ELSE 'content' END AS position, e.exchange_index, md5(concat('User: ', user_message, chr(10), chr(10), 'Assistant: ', assistant_message)) AS content_md5 FROM exchanges e JOIN pk USING (conversation_id) WHERE abs(e.exchange_index - pk.exchange_index) <= 5", "exchanges")
def drill_exchange(spark, d):
    e = t.exchanges(spark, d)
    ident = e.orderBy(F.desc("exchange_index"), "id").first()["id"]
    return recall.drill_exchange(e, ident).select("position", "exchange_index", F.md5("content").alias("content_md5"))


@query("mx AS (SELECT m.*, e.id AS source, e.exchange_index, user_message, assistant_message FROM memories m JOIN exchanges e ON e.conversation_id = m.id % (SELECT max(conversation_id) + 1 FROM exchanges) WHERE m.id = (SELECT min(m2.id) FROM memories m2 JOIN exchanges e2 ON e2.conversation_id = m2.id % (SELECT max(conversation_id) + 1 FROM exchanges) WHERE is_active AND deleted_at IS NULL)) SELECT 'source' AS position, row_number() OVER (ORDER BY exchange_index, source) AS n, md5(concat('User: ', user_message, chr(10), chr(10), 'Assistant: ', assistant_message)) AS content_md5 FROM mx UNION ALL SELECT DISTINCT 'content', 0, md5(concat(content, chr(10), chr(10), 'Context: ', context)) FROM mx", "memories exchanges")
def drill_memory(spark, d):
    links, e = cited(spark, d)
    m = t.memories(spark, d).join(links.select("id", "sources"), "id")
    known = e.select(F.col("id").alias("s")).distinct()
    first = m.filter("is_active AND deleted_at IS NULL").select("id", F.explode("sources").alias("s")).join(known, "s").agg(F.min("id")).first()[0]
    return recall.drill_memory(m, e, first).select("position", "n", F.md5("content").alias("content_md5"))


@query("y AS (SELECT target AS other, type, weight FROM relationships WHERE source = 's3' UNION ALL SELECT source, type, weight FROM relationships WHERE target = 's3'), b AS (SELECT other, arg_max(type, (weight, type)) AS relation, max(weight) AS weight FROM y GROUP BY 1) SELECT row_number() OVER (ORDER BY weight DESC, other) AS n, other, name, type, relation, weight FROM b JOIN entities ON id = other", "entities relationships")
def drill_entity(spark, d):
    return recall.drill_entity(t.entities(spark, d), t.relationships(spark, d), "s3")


@query("b AS (SELECT id, content FROM memories WHERE is_active ORDER BY created_at DESC, id LIMIT 10) SELECT id FROM b WHERE id = (SELECT max(id) FROM b) AND (SELECT count(*) FROM b x WHERE trim(regexp_replace(lower(x.content), '[^\\p{L}\\p{N}]+', ' ', 'g')) = (SELECT trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM b WHERE id = (SELECT max(id) FROM b))) = 1", "memories")
def forget_by_query(spark, d):
    last = search.bounded(t.memories(spark, d).filter("is_active").orderBy(F.desc("created_at"), "id").limit(10).select("id", "content"))
    said = last.orderBy(F.desc("id")).first()["content"]
    return recall.forget_match(last, f"-- {said} !")
