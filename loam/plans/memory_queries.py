"""Queries on facts and memories, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.columns import content_hash
from loam.operators import consolidation, near_facts
from loam.plans import tables as t
from loam.plans.queries import NORMAL, STABLE, query

COSINE = "round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6)"


@query(f"SELECT id, round({STABLE} * 0.8, 6) AS stability FROM memories WHERE id % 5 = 1", "memories")
def contradiction(spark, d):
    from loam.functions.columns import stability

    m = t.memories(spark, d).withColumn("stability", stability(F.col("type"), F.col("stability")))
    return consolidation.contradicted(m, m.filter("id % 5 = 1"))


@query(f"""f AS (SELECT id % 20 AS batch, id AS pos, content, confidence, importance, CASE WHEN id % 3 = 0 THEN NULL ELSE context END AS context, concat('x', id % 13) AS source FROM memories), k AS (SELECT *, CASE WHEN {NORMAL} = '' THEN content ELSE {NORMAL} END AS key FROM f),
b AS (SELECT key, min((batch, pos)) AS a, arg_max((content, confidence, importance, context), (round(confidence, 6), round(importance, 6), -batch, -pos)) AS w, arg_min(context, (batch, pos)) FILTER (context IS NOT NULL) AS said, count(*) AS n_merged FROM k GROUP BY key),
s AS (SELECT key, string_agg(source, ',' ORDER BY o) AS sources FROM (SELECT key, source, min((batch, pos)) AS o FROM k GROUP BY key, source) GROUP BY key)
SELECT a[1] AS batch, a[2] AS pos, md5(w[1]) AS content_md5, round(w[2], 6) AS confidence, coalesce(w[4], said) AS context, sources, n_merged FROM b JOIN s USING (key)""", "memories")
def cross_batch_collapse(spark, d):
    f = t.memories(spark, d).selectExpr("id % 20 AS batch", "id AS pos", "content", "confidence", "importance", "CASE WHEN id % 3 = 0 THEN NULL ELSE context END AS context", "array(concat('x', id % 13)) AS sources")
    out = consolidation.collapse_batches(f)
    return out.select("batch", "pos", F.md5("content").alias("content_md5"), F.round("confidence", 6).alias("confidence"), "context", F.array_join("sources", ",").alias("sources"), "n_merged")


FACTS = """fx AS (SELECT e.label AS batch, m.id AS pos, row_number() OVER (PARTITION BY e.label ORDER BY m.id) AS n, m.confidence AS c, m.importance AS i, CAST(embedding AS DOUBLE[]) AS v FROM memories m JOIN embeddings e ON vec_id = m.id),
fold AS (
  SELECT batch, 0 AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS survivor, false AS rep, CAST([] AS STRUCT(g BIGINT, c DOUBLE, i DOUBLE, v DOUBLE[])[]) AS s FROM (SELECT DISTINCT batch FROM fx)
  UNION ALL
  SELECT batch, n, pos, coalesce(hit.g, pos), hit IS NULL OR c > hit.c OR (c = hit.c AND i > hit.i),
    CASE WHEN hit IS NULL THEN list_append(s, {'g': pos, 'c': c, 'i': i, 'v': v}) WHEN c > hit.c OR (c = hit.c AND i > hit.i) THEN list_transform(s, lambda y: CASE WHEN y.g = hit.g THEN {'g': y.g, 'c': c, 'i': i, 'v': v} ELSE y END) ELSE s END
  FROM (SELECT f.batch, x.n, x.pos, x.c, x.i, x.v, f.s, list_filter(f.s, lambda y: list_cosine_similarity(y.v, x.v) >= 0.95)[1] AS hit FROM fold f JOIN fx x ON x.batch = f.batch AND x.n = f.n + 1)
),
nr AS (SELECT batch, pos, survivor, rep FROM fold WHERE n > 0)"""


def near_facts_(spark, d):
    m = t.memories(spark, d).selectExpr("id", "content", "confidence", "importance", "CASE WHEN id % 3 = 0 THEN NULL ELSE context END AS context", "array(concat('x', id % 13), concat('y', id % 7)) AS sources")
    return m.join(t.given(spark, d, "embeddings").selectExpr("vec_id AS id", "CAST(label AS BIGINT) AS batch", "embedding"), "id").withColumnRenamed("id", "pos")


@query(FACTS + " SELECT CAST(batch AS BIGINT) AS batch, pos, survivor FROM nr", "memories", True)
def near_duplicate_collapse(spark, d):
    return near_facts.collapse_near(near_facts_(spark, d)).select("batch", "pos", "survivor")


@query(FACTS + """, j AS (SELECT nr.*, content, confidence, importance, CASE WHEN id % 3 = 0 THEN NULL ELSE context END AS context, [concat('x', id % 13), concat('y', id % 7)] AS src FROM nr JOIN memories ON id = pos),
so AS (SELECT batch, survivor, source, min(pos * 10 + k) AS o FROM (SELECT batch, survivor, pos, unnest(src) AS source, unnest([0, 1]) AS k FROM j) GROUP BY ALL), sl AS (SELECT batch, survivor, string_agg(source, ',' ORDER BY o) AS sources FROM so GROUP BY ALL)
SELECT CAST(batch AS BIGINT) AS batch, survivor AS pos, md5(arg_max(content, (confidence, importance, -pos))) AS content_md5, coalesce(arg_max(context, pos) FILTER (rep AND context IS NOT NULL), arg_min(context, pos) FILTER (context IS NOT NULL)) AS context, max(sources) AS sources, count(*) AS n_merged
FROM j JOIN sl USING (batch, survivor) GROUP BY batch, survivor""", "memories", True)
def near_duplicates_merged(spark, d):
    f = near_facts_(spark, d)
    return near_facts.merged(f, near_facts.collapse_near(f)).select("batch", "pos", F.md5("content").alias("content_md5"), "context", F.array_join("sources", ",").alias("sources"), "n_merged")


def asked(spark, d):
    """The memories with vectors whose id is divisible by 50, as facts, and all others."""
    m = t.memories(spark, d).select("id", "scope", "content").join(t.vectors(spark, d), "id")
    return m.filter("id % 50 = 0").withColumnRenamed("id", "fact_id"), m.filter("id % 50 <> 0")


ASKED = f"""mv AS (SELECT m.id, coalesce(scope, 'global') AS scope, content, CAST(embedding AS DOUBLE[]) AS v FROM memories m JOIN embeddings ON vec_id = m.id), fa AS (SELECT id AS fact_id, scope, content AS fact, v AS q FROM mv WHERE id % 50 = 0),
nb AS (SELECT fact_id, id, {COSINE} AS c, fact, content, row_number() OVER (PARTITION BY fact_id ORDER BY {COSINE} DESC, id) AS n FROM mv JOIN fa USING (scope) WHERE id % 50 <> 0), n5 AS (SELECT * FROM nb WHERE n <= 5)"""


@query(ASKED + """, w AS (SELECT *, CASE WHEN c >= 0.9 THEN 'merge' WHEN c >= 0.2 AND length(content) > 2 * length(fact) THEN 'merge' WHEN c >= 0.2 AND length(content) % 3 = 0 THEN 'conflict' END AS action FROM n5), f AS (SELECT fact_id, arg_min((action, id, c), n) AS x FROM w WHERE action IS NOT NULL GROUP BY fact_id)
SELECT fact_id, coalesce(x[1], 'insert') AS action, x[2] AS memory_id, x[3] AS similarity FROM fa LEFT JOIN f USING (fact_id)""", "memories")
def consolidate_facts(spark, d):
    facts, known = asked(spark, d)
    entails = lambda old, new: F.when(F.length(old) > 2 * F.length(new), 0.9).otherwise(0.1)
    contradicts = lambda old, new: F.when(F.length(old) % 3 == 0, 0.8).otherwise(0.0)
    return consolidation.consolidate(facts, known, entails, contradicts, merge=0.9, ask=0.2)


CHAIN = "ch AS (SELECT id, content, CASE WHEN id % 4 <> 0 THEN id + 1 END AS superseded_by FROM memories)"


@query(CHAIN + ", st AS (SELECT superseded_by AS id, id AS ancestor, 1 AS hop FROM ch WHERE superseded_by IS NOT NULL UNION ALL SELECT st.id, ch.id, hop + 1 FROM st JOIN ch ON ch.superseded_by = st.ancestor WHERE hop < 5) SELECT id, ancestor, CAST(min(hop) AS BIGINT) AS hop FROM st WHERE id <> ancestor GROUP BY 1, 2", "memories", True)
def superseded_chain(spark, d):
    return consolidation.superseded_ancestors(t.memories(spark, d).selectExpr("id", "CASE WHEN id % 4 <> 0 THEN id + 1 END AS superseded_by"))


@query(CHAIN + f""", st AS (SELECT superseded_by AS id, id AS ancestor, 1 AS hop FROM ch WHERE superseded_by IS NOT NULL UNION ALL SELECT st.id, ch.id, hop + 1 FROM st JOIN ch ON ch.superseded_by = st.ancestor WHERE hop < 5),
ve AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM memories LEFT JOIN embeddings ON vec_id = id), ca AS (SELECT id + 1000000 AS fact_id, id + 2 AS memory_id, sha256({NORMAL}) AS h, v FROM memories JOIN ve USING (id)), m AS (SELECT id AS ancestor, sha256({NORMAL}) AS h, v AS q FROM memories JOIN ve USING (id))
SELECT fact_id, arg_min(ancestor, (hop, ancestor)) AS ancestor, CAST(min(hop) AS BIGINT) AS hop FROM ca JOIN st ON st.id = memory_id JOIN m USING (ancestor) WHERE ca.h = m.h OR {COSINE} >= 0.3 GROUP BY fact_id""", "memories", True)
def ping_pong_guard(spark, d):
    """Vectors count as near from 0.3 on here, so that some are."""
    m = t.memories(spark, d).join(t.vectors(spark, d), "id", "left")
    return consolidation.ping_pong(m.selectExpr("id + 1000000 AS fact_id", "id + 2 AS memory_id", "content", "embedding"), m.selectExpr("id", "content", "CASE WHEN id % 4 <> 0 THEN id + 1 END AS superseded_by", "embedding"), near=0.3)


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE is_active END AS is_active, CASE WHEN id % 3 = 0 THEN id + 1000000 END AS superseded_by, round({STABLE} * 0.8, 6) AS stability FROM memories WHERE id % 3 <> 2", "memories")
def resolve_conflicts(spark, d):
    from loam.functions.columns import stability

    m = t.memories(spark, d).withColumn("stability", stability(F.col("type"), F.col("stability")))
    return consolidation.resolved_conflicts(m.selectExpr("id AS memory_id", "CASE id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'keep_both' ELSE 'noop' END AS decision", "id + 1000000 AS new_id"), m)


@query(ASKED + r""", f AS (SELECT fact_id, arg_min((id, content), n) AS x FROM n5 WHERE c >= 0.3 GROUP BY fact_id), r AS (SELECT fact_id, fact, x[1] AS id, x[2] AS known, regexp_replace(lower(trim(x[2])), '\s+', ' ', 'g') AS a, regexp_replace(lower(trim(fact)), '\s+', ' ', 'g') AS b FROM fa LEFT JOIN f USING (fact_id)),
w AS (SELECT *, CASE WHEN id IS NULL THEN 'created' WHEN NOT contains(a, b) AND length(fact) > length(known) THEN 'merged' ELSE 'updated' END AS action FROM r)
SELECT fact_id, action, id AS memory_id, md5(CASE WHEN action = 'merged' THEN concat(known, ' / ', fact) ELSE fact END) AS content_md5 FROM w""", "memories")
def remember_facts(spark, d):
    facts, known = asked(spark, d)
    merged = lambda old, new: F.when(F.length(new) > F.length(old), F.concat(old, F.lit(" / "), new))
    return consolidation.remember(facts, known, merged, 0.3).select("fact_id", "action", "memory_id", F.md5("content").alias("content_md5"))


@query(f"h AS (SELECT id, sha256({NORMAL}) AS content_hash, coalesce(scope, 'global') AS scope FROM memories) SELECT DISTINCT content_hash, scope FROM h WHERE id % 2 = 0 AND NOT EXISTS (FROM h b WHERE b.id % 7 = 0 AND b.content_hash = h.content_hash AND b.scope = h.scope)", "memories")
def cleared_suppressions(spark, d):
    m = t.memories(spark, d)
    stops = m.filter("id % 2 = 0").select(content_hash(F.col("content")).alias("content_hash"), F.coalesce("scope", F.lit("global")).alias("scope")).distinct()
    return consolidation.cleared(stops, m.filter("id % 7 = 0"))


@query("c AS (SELECT id, CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN content ELSE concat('new ', id) END AS after FROM memories WHERE id % 2 = 0 OR id % 4 = 1 UNION ALL SELECT -1, 'nobody'), r AS (SELECT c.id, trim(after) AS after, content AS before, is_active, deleted_at FROM c LEFT JOIN memories m USING (id)) SELECT id, CASE WHEN after = '' THEN 'empty' WHEN before IS NULL THEN 'unknown' WHEN deleted_at IS NOT NULL THEN 'forgotten' WHEN NOT is_active THEN 'inactive' WHEN before = after THEN 'same' ELSE 'edited' END AS outcome FROM r", "memories")
def edit_memories(spark, d):
    m = t.memories(spark, d)
    new = m.filter("id % 2 = 0 OR id % 4 = 1").selectExpr("id", "CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN content ELSE concat('new ', id) END AS content")
    return consolidation.edit(m, new.unionByName(spark.createDataFrame([(-1, "nobody")], "id long, content string"))).select("id", "outcome")


@query("SELECT id, CAST(true AS BOOLEAN) AS is_active FROM memories WHERE deleted_at IS NOT NULL AND id % 2 = 1", "memories")
def restore_memories(spark, d):
    m = t.memories(spark, d)
    return consolidation.restore(m, m.filter("id % 2 = 1"))[0].select("id", "is_active")


CITES = "ci AS (SELECT m.id, created_at, e.id AS source FROM memories m JOIN exchanges e ON e.conversation_id = m.id % (SELECT max(conversation_id) + 1 FROM exchanges) UNION ALL SELECT id, created_at, CAST((id * 7) % 40 AS VARCHAR) FROM memories WHERE id % 9 = 0)"


def cited(spark, d):
    """Memories cite all exchanges of a conversation, and one in nine names a conversation itself."""
    m, e = t.memories(spark, d), t.exchanges(spark, d)
    most = e.agg(F.max("conversation_id") + 1).first()[0]
    one = m.select("id", "created_at", (F.col("id") % most).alias("conversation_id")).join(e.select("conversation_id", F.col("id").alias("source")), "conversation_id").select("id", "created_at", "source")
    two = m.filter("id % 9 = 0").select("id", "created_at", ((F.col("id") * 7) % 40).cast("string").alias("source"))
    return one.unionByName(two).groupBy("id", "created_at").agg(F.collect_list("source").alias("sources")), e


@query(CITES + " SELECT DISTINCT id, created_at FROM ci WHERE source = '14' OR source IN (SELECT id FROM exchanges WHERE conversation_id = 14)", "memories exchanges")
def conversation_memories(spark, d):
    m, e = cited(spark, d)
    return consolidation.of_conversation(m, e, "14")


@query("""x AS (SELECT id, CASE id % 4 WHEN 0 THEN concat('["a', id, '", "b"]') WHEN 1 THEN concat('["a", ["b', id, '", "c"], "d"]') WHEN 2 THEN 'not json' ELSE '[]' END AS e FROM memories)
SELECT id, CASE id % 4 WHEN 0 THEN concat('a', id, ',b') WHEN 1 THEN concat('a,b', id, ',c,d') ELSE '' END AS evidence FROM x""", "memories")
def evidence_parse(spark, d):
    e = F.expr("""CASE id % 4 WHEN 0 THEN concat('["a', id, '", "b"]') WHEN 1 THEN concat('["a", ["b', id, '", "c"], "d"]') WHEN 2 THEN 'not json' ELSE '[]' END""")
    return t.memories(spark, d).select("id", F.array_join(consolidation.evidence(e), ",").alias("evidence"))


@query("""g AS (SELECT id FROM memories WHERE deleted_at IS NOT NULL), c AS (SELECT source, target, type, unnest(source_memories) AS id FROM relationships), h AS (SELECT source, target, type FROM c SEMI JOIN g USING (id) GROUP BY 1, 2, 3), x AS (SELECT i AS id, count(*) AS n FROM (SELECT source AS i FROM h UNION ALL SELECT target FROM h) GROUP BY 1)
SELECT id, greatest(0, mention_count - n) AS mention_count FROM entities JOIN x USING (id)""", "memories relationships entities")
def detached_mentions(spark, d):
    return consolidation.detach(t.relationships(spark, d), t.entities(spark, d), t.memories(spark, d).filter("deleted_at IS NOT NULL"))[1]


@query("SELECT id, md5(content) AS content_md5, type FROM memories WHERE id = 42", "memories")
def memory_by_id(spark, d):
    return t.memories(spark, d).filter("id = 42").select("id", F.md5("content").alias("content_md5"), "type")


@query("SELECT id, conversation_id, exchange_index, md5(user_message) AS user_md5 FROM exchanges WHERE id = (SELECT min(id) FROM exchanges)", "exchanges")
def exchange_by_id(spark, d):
    e = t.exchanges(spark, d)
    return e.join(F.broadcast(e.agg(F.min("id").alias("id"))), "id").select("id", "conversation_id", "exchange_index", F.md5("user_message").alias("user_md5"))


@query("m AS (SELECT CAST(id AS VARCHAR) AS k, id, coalesce(scope, 'global') AS scope FROM memories), p AS (SELECT unnest(['12', '1', '100001', '99999999']) AS prefix), h AS (SELECT prefix, id FROM p JOIN m ON k = prefix OR (length(prefix) >= 6 AND starts_with(k, prefix))) SELECT prefix, CASE WHEN count(id) = 1 THEN min(id) END AS id, CASE count(id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM p LEFT JOIN h USING (prefix) GROUP BY prefix", "memories")
def ids_by_prefix(spark, d):
    from loam.operators.upkeep import by_prefix

    m, out = t.memories(spark, d), None
    for p in ("12", "1", "100001", "99999999"):
        one = by_prefix(m, p).limit(3).agg(F.count("*").alias("n"), F.min("id").alias("low"))
        one = one.select(F.lit(p).alias("prefix"), F.when(F.col("n") == 1, F.col("low")).alias("id"), F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def remember_batches(spark, d):
    """Batches of facts, collapsed among themselves in order, then remembered. No SQL form: an ordered fold."""
    facts, known = asked(spark, d)
    near = near_facts.collapse_near(facts.join(t.memories(spark, d).selectExpr("id AS fact_id", "confidence", "importance"), "fact_id").selectExpr("fact_id div 500 AS batch", "fact_id AS pos", "confidence", "importance", "embedding"))
    kept = facts.join(near.filter("pos = survivor").select(F.col("pos").alias("fact_id")), "fact_id", "left_semi")
    return consolidation.remember(kept, known).select("fact_id", "action", "memory_id")
