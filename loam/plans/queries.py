"""Every query of the engine over the given tables, with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import fixed
from loam.functions.columns import content_hash, noise_name, token_estimate, visible
from loam.operators import corpus, episodes, graph, ledger, lifecycle, louvain, search, temporal
from loam.plans import tables as t
from loam.plans.tables import NOW, with_tables
from loam.sources.scratch import save

TEXT_QUERY = "The clown and the idiot for every trash"
TERMS = ("clown", "idiot", "every", "trash")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs: str = "", recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(needs, sql, recursive) if needs else sql
        return f

    return add


def q_vector(spark: SparkSession, d: str) -> DataFrame:
    return t.vectors(spark, d).filter("id = 0").select(F.col("embedding").alias("q"))


# Pieces of oracle SQL.
WORDS = r"list_filter(string_split(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
R = f"CASE WHEN ({NOW} - coalesce(last_accessed, created_at)) <= 0 THEN 1.0 ELSE pow(CAST(0.9 AS DOUBLE), ({NOW} - coalesce(last_accessed, created_at)) / CAST(86400 AS DOUBLE) / coalesce(stability, CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.STABILITY.items()) + " END)) END"
NORMAL = r"trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g'))"


def bm25_sql(name: str, source: str, cols: dict[str, float], k: int) -> str:
    tf = "list_value(" + ", ".join("CAST(" + " + ".join(f"{w} * len(list_filter(w_{c}, lambda w: w = '{x}'))" for c, w in cols.items()) + " AS DOUBLE)" for x in TERMS) + ")"
    made = ", ".join(WORDS.format(c=f"coalesce({c}, '')") + f" AS w_{c}" for c in cols)
    return f"""{name}_w AS (SELECT id, {made} FROM {source}),
{name}_t AS (SELECT id, {tf} AS tf, {' + '.join(f'len(w_{c})' for c in cols)} AS dl FROM {name}_w),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avg, list_value({', '.join(f'count(*) FILTER (tf[{i + 1}] > 0)' for i in range(len(TERMS)))}) AS df FROM {name}_t),
{name}_b AS (SELECT id, round(list_sum(list_transform(range(1, {len(TERMS) + 1}), lambda i: greatest(CAST(1e-6 AS DOUBLE), ln((n - df[i] + 0.5) / (df[i] + 0.5))) * tf[i] * 2.2 / (tf[i] + 1.2 * (1 - 0.75 + 0.75 * dl / avg)))), 6) AS bm25 FROM {name}_t, {name}_s WHERE list_sum(tf) > 0),
{name} AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM {name}_b ORDER BY rank LIMIT {k})"""


def knn_sql(name: str, source: str, k: int) -> str:
    return f"""{name}_c AS (SELECT v.id, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS cosine
  FROM {source} v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
{name} AS (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM {name}_c ORDER BY rank LIMIT {k})"""


def floored_sql(rows: str) -> str:
    return f"(SELECT * EXCLUDE (score), CASE WHEN count(*) OVER () = 1 THEN 0.85 WHEN max(score) OVER () = min(score) OVER () THEN 0.5 ELSE 0.1 + 0.9 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM {rows})"


MEM_WEIGHTS, EXC_WEIGHTS = {"content": 1.0, "context": 0.25}, {"user_message": 1.0, "assistant_message": 1.0}


# Text, vectors and fusion


@query(bm25_sql("b", "memories", MEM_WEIGHTS, 20) + " SELECT id, bm25, rank FROM b", "memories")
def bm25_topk(spark, d):
    return search.bm25_topk(t.text_index(spark, d, "memories"), TEXT_QUERY, 20)


@query("WITH v AS (SELECT vec_id AS id, embedding FROM embeddings), " + knn_sql("k", "v", 20) + " SELECT id, cosine, rank FROM k")
def knn_topk(spark, d):
    return search.knn_topk(t.vectors(spark, d), q_vector(spark, d), 20)


@query("v AS (SELECT vec_id AS id, embedding FROM embeddings SEMI JOIN memories ON vec_id = id AND is_active AND coalesce(scope, 'global') = 'global'), " + knn_sql("k", "v", 10) + " SELECT id, cosine, rank FROM k", "memories")
def knn_scoped(spark, d):
    inside = t.memories(spark, d).filter(F.col("is_active") & visible(F.col("scope"), ["global"])).select("id")
    return search.knn_topk(t.vectors(spark, d).join(inside, "id", "left_semi"), q_vector(spark, d), 10)


SEMANTIC = (
    "v AS (SELECT vec_id AS id, embedding FROM embeddings SEMI JOIN memories ON vec_id = id), act AS (SELECT * FROM memories WHERE is_active), " + knn_sql("k", "v", 20) + ", " + bm25_sql("b", "act", MEM_WEIGHTS, 20) + f""",
f AS (SELECT id, sum(1 / (60 + rank)) AS rrf FROM (SELECT id, rank FROM k UNION ALL SELECT id, rank FROM b) GROUP BY id),
c AS (SELECT id, type, content, round(0.55 * rrf + 0.25 * ({R}) + 0.20 * importance, 9) AS score FROM f JOIN memories USING (id) WHERE is_active),
sem AS (SELECT id, type, round(score, 6) AS score, CAST(ceil(length(content) / 4) + 10 AS BIGINT) AS token_estimate FROM {floored_sql('c')} ORDER BY score DESC, id LIMIT 10)"""
)


@query(SEMANTIC + " SELECT * FROM sem", "memories")
def semantic_recall(spark, d):
    return search.semantic(t.memories(spark, d), t.vectors(spark, d), t.text_index(spark, d, "memories"), TEXT_QUERY, q_vector(spark, d), NOW)


def exchange_vectors(spark, d):
    return t.exchanges(spark, d).select("id", (F.col("conversation_id") * 5 + F.col("exchange_index")).alias("v")).join(t.vectors(spark, d).withColumnRenamed("id", "v"), "v").select("id", "embedding")


def episodic_sql(mode: str) -> str:
    lists = [knn_sql("k", "ev", 20)] * (mode != "text") + [bm25_sql("b", "exchanges", EXC_WEIGHTS, 20)] * (mode != "vector")
    every = " UNION ALL ".join(["SELECT id, rank, 0 AS which FROM k"] * (mode != "text") + [f"SELECT id, rank, {int(mode == 'hybrid')} FROM b"] * (mode != "vector"))
    if mode == "text":
        every = "SELECT id, rank, 0 AS which FROM b"
    return (
        "ev AS (SELECT e.id, v.embedding FROM exchanges e JOIN embeddings v ON v.vec_id = e.conversation_id * 5 + e.exchange_index), " + ", ".join(lists)
        + f""", f AS (SELECT id, sum(1 / (60 + rank)) AS score, min(which * 1000 + rank) AS o FROM ({every}) GROUP BY id),
epi AS (SELECT id, round(score, 6) AS score, o FROM {floored_sql('f')} ORDER BY score DESC, o LIMIT 10),
ep AS (SELECT e.id, conversation_id, score, token_estimate, trim(regexp_replace(substr(user_message, 1, 200), '\\s+', ' ', 'g')) AS snippet FROM epi JOIN exchanges e USING (id))"""
    )


@query(episodic_sql("hybrid") + " SELECT * FROM ep", "exchanges")
def episodic_recall_hybrid(spark, d):
    return search.episodic(t.exchanges(spark, d), exchange_vectors(spark, d), t.text_index(spark, d, "exchanges"), TEXT_QUERY, q_vector(spark, d))


@query(episodic_sql("text") + " SELECT * FROM ep", "exchanges")
def episodic_recall_text(spark, d):
    return search.episodic(t.exchanges(spark, d), exchange_vectors(spark, d), t.text_index(spark, d, "exchanges"), TEXT_QUERY, q_vector(spark, d), "text")


@query(episodic_sql("vector") + " SELECT * FROM ep", "exchanges")
def episodic_recall_vector(spark, d):
    return search.episodic(t.exchanges(spark, d), exchange_vectors(spark, d), t.text_index(spark, d, "exchanges"), TEXT_QUERY, q_vector(spark, d), "vector")


@query("v AS (SELECT vec_id AS id, embedding FROM embeddings), " + knn_sql("k", "v", 50) + ", " + bm25_sql("b", "memories", MEM_WEIGHTS, 50) + " SELECT id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM k UNION ALL SELECT id, rank FROM b) GROUP BY id", "memories")
def rrf_fusion(spark, d):
    a = search.knn_topk(t.vectors(spark, d), q_vector(spark, d), 50)
    b = search.bm25_topk(t.text_index(spark, d, "memories"), TEXT_QUERY, 50)
    return search.rrf(a, b).select("id", F.round("score", 9).alias("score"))


@query("WITH v AS (SELECT vec_id AS id, embedding FROM embeddings), " + knn_sql("k", "v", 30) + f" SELECT id, round(score, 6) AS score FROM {floored_sql('(SELECT id, cosine AS score FROM k)')}")
def floored_minmax(spark, d):
    return search.floored(search.knn_topk(t.vectors(spark, d), q_vector(spark, d), 30).select("id", F.col("cosine").alias("score"))).select("id", F.round("score", 6).alias("score"))


@query(SEMANTIC + """,
z AS (SELECT id, token_estimate, round(score * 1.3, 6) AS boosted, row_number() OVER (ORDER BY round(score * 1.3, 6) DESC, id) AS n FROM sem),
g AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS id UNION ALL SELECT z.n, CASE WHEN g.used + token_estimate <= 1500 THEN g.used + token_estimate ELSE g.used END, CASE WHEN g.used + token_estimate <= 1500 THEN z.id END FROM g JOIN z ON z.n = g.n + 1)
SELECT z.id, 'semantic' AS source, token_estimate, boosted FROM g JOIN z ON z.id = g.id""", "memories", True)
def budget_pack(spark, d):
    return search.pack_budget(semantic_recall(spark, d).withColumn("source", F.lit("semantic")), 1500)


def inlined(sql: str, last: str) -> str:
    """A chain of tables as one, so that its names stay apart from another chain's."""
    return f"{last} AS (WITH {sql} SELECT * FROM {last})"


@query(inlined(SEMANTIC, "sem") + ", " + inlined(episodic_sql("hybrid"), "ep") + """,
m AS (SELECT CAST(id AS VARCHAR) AS id, token_estimate, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM sem),
e2 AS (SELECT id, token_estimate, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ep),
u AS (SELECT id, sum(1 / (60 + rank)) AS score FROM (SELECT id, rank FROM e2 UNION ALL SELECT id, rank FROM m) GROUP BY id)
SELECT u.id, CASE WHEN m.id IS NULL THEN 'episodic' ELSE 'semantic' END AS source, round(u.score, 6) AS score, coalesce(m.token_estimate, e2.token_estimate) AS token_estimate FROM """ + floored_sql("u") + """ u LEFT JOIN m ON m.id = u.id LEFT JOIN e2 ON e2.id = u.id ORDER BY score DESC, source, u.id LIMIT 20""", "memories exchanges")
def multi_source_recall(spark, d):
    return search.multi_source(episodic_recall_hybrid(spark, d), semantic_recall(spark, d))


@query("SELECT id, CAST(ceil(length(content) / 4 * CAST(1.1 AS DOUBLE)) AS BIGINT) AS tokens FROM memories", "memories")
def token_estimates(spark, d):
    return t.memories(spark, d).select("id", token_estimate(F.col("content")).alias("tokens"))


# Episodes


@query("SELECT id, conversation_id, exchange_index, first_line, last_line, md5(user_message) AS user_md5, md5(assistant_message) AS answer_md5, token_estimate FROM exchanges", "exchanges")
def exchange_pairing(spark, d):
    return t.exchanges(spark, d).select("id", "conversation_id", "exchange_index", "first_line", "last_line", F.md5("user_message").alias("user_md5"), F.md5("assistant_message").alias("answer_md5"), "token_estimate")


@query("SELECT conversation_id, count(*) AS exchange_count, min(ts) AS started_at, max(ts) AS ended_at FROM exchanges GROUP BY 1", "exchanges")
def conversation_rollup(spark, d):
    return episodes.rollup(t.exchanges(spark, d))


@query("SELECT id, min(exchange_index) OVER w AS from_index, max(exchange_index) OVER w AS to_index, count(*) OVER w AS n_around, CAST(sum(token_estimate) OVER w AS BIGINT) AS tokens_around FROM exchanges WINDOW w AS (PARTITION BY conversation_id ORDER BY exchange_index RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)", "exchanges")
def exchange_window(spark, d):
    return episodes.neighbourhood(t.exchanges(spark, d))


@query("""WITH c AS (SELECT user_id AS conversation_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT conversation_id, n, unnest(CASE WHEN n <= 100 THEN [0] ELSE range(0, n, 20) END) AS start FROM c)
SELECT conversation_id, CAST(start AS BIGINT) AS start, CAST(CASE WHEN n <= 100 THEN n ELSE least(start + 25, n) END AS BIGINT) AS "end" FROM s""")
def chunk_plan(spark, d):
    return episodes.chunk_plan(t.given(spark, d, "events").groupBy(F.col("user_id").alias("conversation_id")).agg(F.count("*").alias("n")))


@query("SELECT conversation_id, sha256(string_agg(concat_ws('|', user_message, assistant_message), chr(10) ORDER BY exchange_index)) AS fingerprint FROM exchanges GROUP BY 1", "exchanges")
def conversation_fingerprint(spark, d):
    return episodes.fingerprint(t.exchanges(spark, d))


# Filters and lists


@query("SELECT id, scope FROM memories WHERE coalesce(scope, 'global') IN ('global', 'tenant:de')", "memories")
def scope_filter(spark, d):
    return t.memories(spark, d).filter(visible(F.col("scope"), ["global", "tenant:de"])).select("id", "scope")


@query("SELECT id, coalesce(event_ts, created_at) AS at FROM memories WHERE coalesce(event_ts, created_at) BETWEEN 1700100000 AND 1701000000", "memories")
def date_filter_epoch(spark, d):
    return lifecycle.date_filter(t.memories(spark, d), "event", 1_700_100_000, 1_701_000_000)


@query("SELECT id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM exchanges WHERE strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') >= '2023-12-01' AND strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') <= '2024-01-01'", "exchanges")
def date_filter_iso(spark, d):
    from loam.functions.columns import iso

    return t.exchanges(spark, d).select("id", iso(F.col("ts")).alias("iso")).filter((F.col("iso") >= "2023-12-01") & (F.col("iso") <= "2024-01-01"))


@query("SELECT id, created_at AS at FROM memories WHERE strftime(make_timestamp(created_at * 1000000), '%m-%d') = '11-20'", "memories")
def anniversary(spark, d):
    return lifecycle.date_filter(t.memories(spark, d), "filed", anniversary="11-20")


@query("SELECT id, type, created_at FROM memories WHERE deleted_at IS NULL AND is_active AND type = 'decision' AND coalesce(scope, 'global') IN ('global') AND created_at >= 1700050000 AND contains(lower(content), 'the') ORDER BY created_at DESC, id LIMIT 20 OFFSET 5", "memories")
def memory_list_page(spark, d):
    return lifecycle.listing(t.memories(spark, d), "decision", ["global"], 1_700_050_000, "The", limit=20, offset=5)


NOISE_SQL = fixed.NOISE_PATTERN.replace("'", "''")


@query("SELECT id, name FROM entities WHERE length(trim(name)) > 1 AND NOT regexp_matches(trim(name), '" + NOISE_SQL + "') AND lower(trim(name)) NOT IN (" + ", ".join(f"'{x}'" for x in fixed.NOISE_NAMES) + ")", "entities")
def entity_names(spark, d):
    return t.entities(spark, d).filter(~noise_name(F.col("name"))).select("id", "name")


# Lifecycle


@query(f"SELECT id, round({R}, 6) AS retrievability, round(confidence * least(1.0, 0.5 + 0.1 * access_count) * ({R}), 6) AS confidence, round(confidence * least(1.0, 0.5 + 0.1 * access_count) * ({R}), 6) < 0.1 AS prune_eligible FROM memories", "memories")
def decay_health(spark, d):
    return lifecycle.health(t.memories(spark, d), NOW)


@query(f"SELECT id, round(confidence * least(1.0, 0.5 + 0.1 * access_count) * ({R}), 6) AS confidence FROM memories WHERE is_active AND round(confidence * least(1.0, 0.5 + 0.1 * access_count) * ({R}), 6) < 0.1", "memories")
def prune_candidates(spark, d):
    return lifecycle.prune(t.memories(spark, d), NOW)


STABLE = "coalesce(stability, CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.STABILITY.items()) + " END)"


@query(SEMANTIC + f" SELECT m.id, round({STABLE} * (1 + 0.2 * (1 - ({R}))), 6) AS stability, round(least(1.0, importance + 0.02), 6) AS importance, access_count + 1 AS access_count, CAST({NOW} AS BIGINT) AS last_accessed FROM memories m SEMI JOIN sem ON sem.id = m.id WHERE is_active", "memories")
def reinforce(spark, d):
    return lifecycle.reinforce(t.memories(spark, d), semantic_recall(spark, d), NOW)


TRANSIENT_SQL = " OR ".join("regexp_matches(trim(content), '{}')".format(p.replace("'", "''")) for p in fixed.TRANSIENT)


@query(f"x AS (SELECT *, ({TRANSIENT_SQL}) AS transient FROM memories) SELECT id, transient, round(CASE WHEN transient THEN least(importance, 0.3) ELSE importance END, 6) AS importance, CASE WHEN transient THEN 7.0 ELSE {STABLE} END AS stability FROM x", "memories")
def transient_policy(spark, d):
    return lifecycle.transient_policy(t.memories(spark, d))


@query(f"k AS (SELECT *, {NORMAL} AS k FROM memories) SELECT sha256(k) AS content_hash, arg_max(id, (round(confidence, 6), round(importance, 6), -id)) AS id, max(round(confidence, 6)) AS confidence, count(*) AS n_merged, string_agg(DISTINCT context, ',' ORDER BY context) AS sources, length(k) AS key_length FROM k GROUP BY k", "memories")
def exact_collapse(spark, d):
    return lifecycle.collapse_exact(t.memories(spark, d))


@query(f"h AS (SELECT id, sha256({NORMAL}) AS content_hash, coalesce(scope, 'global') AS scope, deleted_at FROM memories), s AS (SELECT DISTINCT content_hash, scope FROM h WHERE deleted_at IS NOT NULL) SELECT id, content_hash, scope FROM h WHERE NOT EXISTS (FROM s WHERE s.content_hash = h.content_hash AND s.scope IN (h.scope, 'global'))", "memories")
def content_hash_suppression(spark, d):
    m = t.memories(spark, d)
    gone = m.filter("deleted_at IS NOT NULL").select(content_hash(F.col("content")).alias("content_hash"), F.coalesce("scope", F.lit("global")).alias("scope"))
    return lifecycle.suppressed(m.select("id", "content", "scope"), gone)


@query("SELECT id AS memory_id, 'forget' AS op, md5(content) AS before_md5, 'user' AS actor, CAST(1750000000 AS BIGINT) AS at FROM memories WHERE type = 'pattern' AND deleted_at IS NULL", "memories")
def forget_log(spark, d):
    m = t.memories(spark, d)
    log = lifecycle.forget(m, m.filter("type = 'pattern'"), "user", NOW)[1]
    return log.select("memory_id", "op", F.md5("before").alias("before_md5"), "actor", "at")


TWICE = "nc AS (SELECT max(conversation_id) + 1 AS n FROM exchanges), tw AS (SELECT m.id, e.id AS x, e.ts, e.conversation_id FROM memories m, nc JOIN exchanges e ON e.conversation_id = m.id % nc.n UNION SELECT m.id, e.id, e.ts, e.conversation_id FROM memories m, nc JOIN exchanges e ON e.conversation_id = (m.id * 3) % nc.n)"


def cites_twice(spark, d):
    """Memories cite all exchanges of two conversations, and one in thirteen an exchange that is gone."""
    m, e = t.memories(spark, d), t.exchanges(spark, d)
    n = e.agg(F.max("conversation_id") + 1).first()[0]
    rows = m.select("id", F.explode(F.array_distinct(F.array(F.col("id") % n, (F.col("id") * 3) % n))).alias("conversation_id")).join(e.select("conversation_id", F.col("id").alias("exchange_id")), "conversation_id", "right").filter("id IS NOT NULL").select("id", "exchange_id")
    rows = rows.unionByName(m.filter("id % 13 = 0").select("id", F.lit("gone").alias("exchange_id")))
    return m.select("id").join(rows.groupBy("id").agg(F.collect_list("exchange_id").alias("source_exchanges")), "id", "left"), e


@query(TWICE + " SELECT m.id, min(tw.ts) AS event_ts FROM memories m LEFT JOIN tw USING (id) GROUP BY m.id", "memories exchanges")
def memory_event_ts(spark, d):
    return lifecycle.reached_events(*cites_twice(spark, d))



# Graph


@query("SELECT least(source, target) AS a, greatest(source, target) AS b, arg_min(weight, (source, target, type)) AS weight FROM relationships r SEMI JOIN entities x ON x.id = r.source SEMI JOIN entities y ON y.id = r.target WHERE source <> target GROUP BY 1, 2".replace("r SEMI JOIN entities x ON x.id = r.source SEMI JOIN entities y ON y.id = r.target WHERE", "WHERE source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities) AND"), "entities relationships")
def graph_projection(spark, d):
    return graph.projection(t.relationships(spark, d), t.entities(spark, d))


def nation_members(spark, d):
    """Suppliers by nation, each nation with its suppliers."""
    s = t.given(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").cast("long").alias("community")).unionByName(t.given(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_nationkey").cast("long").alias("community")))


MEMBERS = "mem AS (SELECT concat('s', s_suppkey) AS node, CAST(s_nationkey AS BIGINT) AS community FROM supplier UNION ALL SELECT concat('n', n_nationkey), n_nationkey FROM nation), g AS (SELECT least(source, target) AS a, greatest(source, target) AS b, arg_min(weight, (source, target, type)) AS weight FROM relationships WHERE source <> target AND source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities) GROUP BY 1, 2), j AS (SELECT g.*, x.community AS ca, y.community AS cb FROM g LEFT JOIN mem x ON x.node = a LEFT JOIN mem y ON y.node = b)"


@query(MEMBERS + ", p AS (SELECT ca AS community, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i, CASE WHEN ca = cb THEN 0 ELSE 1 END AS e FROM j WHERE ca IS NOT NULL UNION ALL SELECT cb, 0, 1 FROM j WHERE cb IS NOT NULL AND (ca IS NULL OR ca <> cb)) SELECT community, CAST(sum(i) AS BIGINT) AS internal, CAST(sum(e) AS BIGINT) AS external, round(sum(i) / (sum(i) + sum(e)), 6) AS coherence FROM p GROUP BY 1", "entities relationships")
def coherence(spark, d):
    return graph.coherence(graph_projection(spark, d), nation_members(spark, d))


@query(MEMBERS + ", n AS (SELECT a AS node, b AS other FROM g UNION ALL SELECT b, a FROM g UNION ALL (SELECT DISTINCT x, x FROM (SELECT a AS x FROM g UNION ALL SELECT b FROM g))) SELECT n.node, count(DISTINCT community) AS community_span FROM n JOIN mem ON mem.node = n.other GROUP BY 1", "entities relationships")
def bridge_span(spark, d):
    return graph.bridge_span(graph_projection(spark, d), nation_members(spark, d))


@query(MEMBERS + """, k AS (SELECT * FROM j WHERE ca IS NOT NULL AND cb IS NOT NULL), m AS (SELECT sum(weight) AS m FROM k), w AS (SELECT ca AS c, sum(weight) AS w FROM k WHERE ca = cb GROUP BY 1), dg AS (SELECT c, sum(weight) AS dg FROM (SELECT ca AS c, weight FROM k UNION ALL SELECT cb, weight FROM k) GROUP BY c)
SELECT round(sum(coalesce(w, 0) / m - pow(dg / (2 * m), 2)), 6) AS modularity FROM dg LEFT JOIN w USING (c), m""", "entities relationships")
def modularity(spark, d):
    members = nation_members(spark, d)
    inside = graph_projection(spark, d).join(members.select(F.col("node").alias("a")), "a", "left_semi").join(members.select(F.col("node").alias("b")), "b", "left_semi")
    return graph.modularity(inside, members)


@query(f"""cited AS (SELECT source, target, r.type, avg(m.confidence) AS conf, avg(m.importance) AS imp FROM (SELECT source, target, type, unnest(source_memories) AS id FROM relationships) r JOIN memories m ON m.id = r.id GROUP BY 1, 2, 3)
SELECT r.source, r.target, r.type, round(greatest(0.01, 0.35 * least(1.0, log2(1 + r.weight) / log2(11)) + 0.25 * pow(CAST(0.9 AS DOUBLE), greatest(0.0, ({NOW} - coalesce(last_seen, {NOW})) / 86400) / 90) + 0.20 * coalesce(conf, 0.5) + 0.20 * coalesce(imp, 0.5)), 6) AS weight
FROM relationships r LEFT JOIN entities e ON e.id = r.target LEFT JOIN cited c ON c.source = r.source AND c.target = r.target AND c.type = r.type""", "memories entities relationships")
def edge_weights(spark, d):
    return graph.edge_weights(save(t.relationships(spark, d)), t.entities(spark, d), t.memories(spark, d), NOW)


INFORM = """b AS (SELECT source AS id, count(*) * 0.5 AS bridge_score, 1 AS generation FROM relationships GROUP BY 1 UNION ALL SELECT source, count(*) * 0.25, 2 FROM relationships WHERE type = 'uses' GROUP BY 1),
lt AS (SELECT * FROM b WHERE generation = 2), z AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT coalesce(max(bridge_score), 1) FROM lt) AS top,
  (SELECT list_sort(list(conversation_count))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM entities WHERE conversation_count > 0) AS med)"""


def bridge_table(spark, d):
    """Two generations of made-up bridge scores."""
    e = t.relationships(spark, d)
    one = e.groupBy(F.col("source").alias("id")).agg((F.count("*") * 0.5).alias("bridge_score")).withColumn("generation", F.lit(1))
    two = e.filter("type = 'uses'").groupBy(F.col("source").alias("id")).agg((F.count("*") * 0.25).alias("bridge_score")).withColumn("generation", F.lit(2))
    return one.unionByName(two)


@query(INFORM + " SELECT e.id, round(ln(1 + mention_count) * ln((n + 1) / (CASE WHEN conversation_count > 0 THEN conversation_count ELSE med END + 1)) * (1 + coalesce(bridge_score, 0) / top), 6) AS informativeness FROM entities e LEFT JOIN lt USING (id), z", "entities relationships")
def informativeness(spark, d):
    return graph.informativeness(t.entities(spark, d), bridge_table(spark, d), t.given(spark, d, "orders").count())


@query("SELECT id, name, type FROM entities WHERE id NOT IN (SELECT source FROM relationships UNION ALL SELECT target FROM relationships)", "entities relationships")
def orphans(spark, d):
    return graph.orphans(t.entities(spark, d), save(t.relationships(spark, d).select("source", "target")))


@query("SELECT (SELECT count(*) FROM entities) AS n_nodes, (SELECT count(stale_since) FROM entities) AS n_stale, (SELECT count(*) FROM relationships) AS n_edges, (SELECT count(*) FROM entities WHERE id NOT IN (SELECT source FROM relationships UNION ALL SELECT target FROM relationships)) AS n_orphans, (SELECT count(DISTINCT cluster_id) FROM clusters WHERE generation = 2) AS n_communities, (SELECT count(DISTINCT generation) FROM clusters) AS n_generations", "entities relationships clusters")
def graph_health(spark, d):
    return graph.health(t.entities(spark, d), save(t.relationships(spark, d).select("source", "target")), t.clusters(spark, d))


MERGED = "best AS (SELECT lower(name) AS k, type, arg_min(id, (-mention_count, id)) AS keep, CAST(sum(mention_count) AS BIGINT) AS mention_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS n_merged FROM entities GROUP BY 1, 2), mv AS (SELECT id, keep FROM entities e JOIN best b ON lower(e.name) = b.k AND e.type = b.type)"


@query(MERGED + " SELECT keep AS id, type, mention_count, first_seen, last_seen, n_merged FROM best", "entities")
def merge_entities(spark, d):
    return graph.merge_same_names(t.entities(spark, d), t.relationships(spark, d))[0]


@query(MERGED + " SELECT x.keep AS source, y.keep AS target, type, max(weight) AS weight FROM relationships r JOIN mv x ON x.id = r.source JOIN mv y ON y.id = r.target WHERE x.keep <> y.keep GROUP BY 1, 2, 3", "entities relationships")
def merge_edges(spark, d):
    return graph.merge_same_names(t.entities(spark, d), t.relationships(spark, d))[1]


@query("""h AS (SELECT t, sum(n) AS n, sum(e) AS e FROM (SELECT mention_count AS t, 1 AS n, 0 AS e FROM entities UNION ALL SELECT least(x.mention_count, y.mention_count), 0, 1 FROM relationships r JOIN entities x ON x.id = r.source JOIN entities y ON y.id = r.target) GROUP BY t),
w AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS nodes, sum(e) OVER (ORDER BY t DESC) AS edges, sum(n) OVER () AS an, sum(e) OVER () AS ae FROM h)
SELECT t AS threshold, CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, round((edges / ae) / (nodes / an), 6) AS ratio, nodes BETWEEN 1500 AND 4000 AS in_range FROM w WHERE t >= 1""", "entities relationships")
def visibility_threshold(spark, d):
    return graph.visibility(t.entities(spark, d), t.relationships(spark, d))


@query("""y AS (SELECT source AS n, target AS o, type, weight FROM relationships UNION ALL SELECT target, source, type, weight FROM relationships),
a1 AS (SELECT o AS node, max(weight) AS weight FROM y WHERE n = 's1' AND o <> 's1' AND type = 'part_of' GROUP BY o), f1 AS (SELECT DISTINCT o FROM y WHERE n = 's1' AND o <> 's1'),
a2 AS (SELECT o AS node, max(weight) AS weight FROM y WHERE n IN (SELECT o FROM f1) AND o <> 's1' AND type = 'part_of' AND o NOT IN (SELECT node FROM a1) GROUP BY o)
SELECT node, CAST(1 AS BIGINT) AS hop, weight FROM a1 UNION ALL SELECT node, 2, weight FROM a2""", "relationships")
def explore_bfs(spark, d):
    return graph.explore(t.relationships(spark, d), "s1", 2, ["part_of"])


@query(None)
def communities(spark, d):
    """Rows only: tests hold its modularity against that of plain sequential moves."""
    return louvain.communities(graph_projection(spark, d), t.entities(spark, d).select(F.col("id").alias("node")))


# Temporal patterns


@query("w AS (SELECT CAST(floor(first_seen / 604800) AS BIGINT) AS w, count(*) AS n FROM entities WHERE first_seen IS NOT NULL GROUP BY 1), a AS (SELECT avg(n) AS a, count(*) AS c FROM w) SELECT w * 604800 AS time_start, (w + 1) * 604800 AS time_end, n, round(n / a, 6) AS ratio, round(least(0.9, 0.5 + (n / (a * 2) - 1) * 0.2), 6) AS confidence FROM w, a WHERE c >= 2 AND a * 2 >= 2 AND n >= a * 2", "entities")
def entity_bursts(spark, d):
    return temporal.bursts(t.entities(spark, d))


@query("w AS (SELECT CAST(floor(first_seen / 604800) AS BIGINT) AS w, count(*) AS n FROM entities WHERE first_seen IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT w * 604800 AS time_start, (w + 1) * 604800 AS time_end, n, CAST(round(least(0.9, 0.4 + n * 0.05), 6) AS DOUBLE) AS confidence FROM w", "entities")
def topic_emergence(spark, d):
    return temporal.emergence(t.entities(spark, d))


@query(f"w AS (SELECT CAST(floor(last_seen / 2592000) AS BIGINT) AS w, count(*) AS n, min(last_seen) AS lo, max(last_seen) AS hi FROM entities WHERE last_seen < {NOW} - 2592000 AND mention_count >= 2 GROUP BY 1 HAVING count(*) >= 3), x AS (SELECT *, CAST(floor(({NOW} - (lo + hi) / 2) / 86400 + 0.5) AS BIGINT) AS s FROM w) SELECT w * 2592000 AS time_start, (w + 1) * 2592000 AS time_end, n, s AS days_stale, round(least(0.9, 0.5 + s / 60 * 0.3), 6) AS confidence FROM x", "entities")
def topic_decay(spark, d):
    return temporal.decay(t.entities(spark, d), NOW)


@query("""cc AS (SELECT DISTINCT cluster_id AS c, entity_id FROM clusters WHERE generation = 2), oo AS (SELECT DISTINCT cluster_id AS o, entity_id FROM clusters WHERE generation = 1),
nc AS (SELECT c, count(*) AS n FROM cc GROUP BY 1), no AS (SELECT o, count(*) AS n FROM oo GROUP BY 1),
pp AS (SELECT c, o, nc.n AS n1, no.n AS n2, round(count(*) / (nc.n + no.n - count(*)), 6) AS j FROM cc JOIN oo USING (entity_id) JOIN nc USING (c) JOIN no USING (o) GROUP BY c, o, nc.n, no.n),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY j DESC, o) AS k FROM pp) WHERE k = 1 AND j > 0.1),
mm AS (SELECT nc.c, nc.n AS n1, bb.o, bb.n2, bb.j FROM nc LEFT JOIN bb USING (c))
SELECT c AS cluster_id, CASE WHEN o IS NULL THEN 'birth' WHEN n1 > n2 THEN 'growth' ELSE 'contraction' END AS change, n2 AS previous_size, n1 AS current_size, CASE WHEN o IS NULL THEN 0.7 ELSE round(least(0.9, j + 0.1), 6) END AS confidence FROM mm WHERE o IS NULL OR n1 <> n2
UNION ALL SELECT o, 'death', n, NULL, 0.6 FROM no WHERE o NOT IN (SELECT o FROM bb)""", "clusters")
def community_evolution(spark, d):
    return temporal.evolution(t.clusters(spark, d), 1, 2)


BRIDGES = "br AS (SELECT entity_id, generation, 1.5 * CAST(substr(entity_id, 2) AS BIGINT) AS bridge_score FROM clusters WHERE CAST(substr(cluster_id, 2) AS BIGINT) % 5 = generation)"


@query(BRIDGES + " SELECT entity_id, CAST(round(bridge_score, 6) AS DOUBLE) AS bridge_score FROM br WHERE generation = 2 AND entity_id NOT IN (SELECT entity_id FROM br WHERE generation = 1)", "clusters")
def bridge_formation(spark, d):
    scores = t.clusters(spark, d).filter(F.substring("cluster_id", 2, 9).cast("long") % 5 == F.col("generation")).select("entity_id", "generation", (F.substring("entity_id", 2, 9).cast("long") * 1.5).alias("bridge_score"))
    return temporal.new_bridges(scores, 1, 2)


# Corpus


@query("""w AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+')) AS word FROM memories) SELECT word, count(*) AS n FROM w WHERE length(word) > 2 AND length(word) < 25 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.QUERY_STOP_WORDS) + """) AND NOT regexp_full_match(word, '[0-9]+') AND NOT regexp_full_match(word, '[0-9a-f]{8,}') GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 100""", "memories")
def word_frequencies(spark, d):
    return corpus.word_frequencies(t.memories(spark, d))


PATTERNS = {"number": "[0-9]{3,}", "shout": "[A-Z]{4,}", "none": "zzzzz"}
SCAN = "ln AS (SELECT id, string_split(content, chr(10)) AS ls FROM memories), l AS (SELECT id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, unnest(ls) AS text FROM ln), hit AS (" + " UNION ALL ".join(f"SELECT id, line, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM l" for n, p in PATTERNS.items()) + ")"


@query(SCAN + " SELECT id, line, pattern, n, greatest(greatest(1, line - 2), coalesce(lag(line) OVER (PARTITION BY id ORDER BY line, pattern) + 3, 1)) AS context_from, least(line + 2, (SELECT len(ls) FROM ln WHERE ln.id = hit.id)) AS context_to FROM hit WHERE n > 0", "memories")
def regex_scan(spark, d):
    return corpus.scan(t.memories(spark, d), PATTERNS)


@query(SCAN + " SELECT pattern, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY 1", "memories")
def pattern_matches(spark, d):
    return corpus.pattern_counts(t.memories(spark, d), PATTERNS)


@query(SCAN + """, r AS (SELECT id, greatest(1, line - 3) AS s, line + 3 AS e FROM hit WHERE n > 0), m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM m) SELECT id, min(s) AS start, max(e) AS "end" FROM i GROUP BY id, island""", "memories")
def snippet_ranges(spark, d):
    hits = corpus.scan(t.memories(spark, d), PATTERNS).select("id", F.col("line").alias("start"), F.col("line").alias("end"))
    return corpus.merge_ranges(hits, 3)


@query(SCAN + ", x AS (SELECT id, line, text, sum(CASE WHEN regexp_matches(text, 'License') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS g, nullif(regexp_extract(text, '^([A-Z]\\w+) ', 1), '') AS name FROM l), y AS (SELECT id, line, last_value(name IGNORE NULLS) OVER (PARTITION BY id, g ORDER BY line) AS enclosing FROM x) SELECT * FROM y WHERE enclosing IS NOT NULL", "memories")
def enclosing_name(spark, d):
    return corpus.enclosing(t.memories(spark, d), r"^([A-Z]\w+) ", "License")


@query(SCAN + ", x AS (SELECT id, line, regexp_extract(text, '^(The|This|Of) ', 1) AS name, max(line) OVER (PARTITION BY id) AS z FROM l), y AS (SELECT * FROM x WHERE name <> '') SELECT id, name, line AS start, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line) - 1, z) AS \"end\" FROM y", "memories")
def symbol_ranges(spark, d):
    return corpus.symbols(t.memories(spark, d), "^(The|This|Of) ")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_dims, count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.05) AS not_unit, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings")
def embedding_validation(spark, d):
    return corpus.embedding_check(t.vectors(spark, d), 64)


@query("v AS (SELECT DISTINCT vec_id AS id FROM embeddings) SELECT 'not_indexed' AS problem, id FROM memories WHERE deleted_at IS NULL AND id NOT IN (SELECT id FROM v) UNION ALL SELECT 'no_row', id FROM v WHERE id NOT IN (SELECT id FROM memories) UNION ALL SELECT 'deleted', id FROM memories WHERE deleted_at IS NOT NULL AND id IN (SELECT id FROM v)", "memories")
def index_audit(spark, d):
    return corpus.index_audit(t.memories(spark, d), t.vectors(spark, d))


@query("SELECT type, count(*) AS n FROM entities GROUP BY 1", "entities")
def entity_type_counts(spark, d):
    return t.entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_memories, count(*) FILTER (is_active) AS n_active, count(deleted_at) AS n_deleted, count(event_ts) AS n_dated, max(created_at) AS newest FROM memories", "memories")
def store_stats(spark, d):
    return t.memories(spark, d).agg(F.count("*").alias("n_memories"), F.count_if("is_active").alias("n_active"), F.count("deleted_at").alias("n_deleted"), F.count("event_ts").alias("n_dated"), F.max("created_at").alias("newest"))


@query("SELECT lower(name) AS name, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) > 1", "entities")
def duplicate_names(spark, d):
    return t.entities(spark, d).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT user_id AS item_id, max(event_id) AS checkpoint, arg_max(event_type, event_id) AS fingerprint FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_checkpoint(spark, d):
    return t.given(spark, d, "events").filter("event_type <> 'error'").groupBy(F.col("user_id").alias("item_id")).agg(F.max("event_id").alias("checkpoint"), F.max_by("event_type", "event_id").alias("fingerprint"))


@query("SELECT DISTINCT conversation_id FROM exchanges WHERE conversation_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)", "exchanges")
def unprocessed(spark, d):
    done = t.given(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("conversation_id"))
    return t.exchanges(spark, d).select("conversation_id").distinct().join(done, "conversation_id", "left_anti")


@query("SELECT id, CASE WHEN first_seen >= 1000000000 THEN 'new' ELSE 'updated' END AS change FROM entities WHERE last_seen >= 1000000000", "entities")
def graph_diff(spark, d):
    return t.entities(spark, d).filter("last_seen >= 1000000000").select("id", F.when(F.col("first_seen") >= 1_000_000_000, "new").otherwise("updated").alias("change"))


# Ledger


@query(f"SELECT id, due_at, created_at, scope FROM commitments WHERE status = 'pending' AND due_at <= {NOW} + 7 * 86400 ORDER BY CASE WHEN due_at < {NOW} THEN 0 ELSE 1 END, due_at IS NULL, due_at, created_at DESC, id LIMIT 50", "commitments")
def commitments_list(spark, d):
    return ledger.listing(t.commitments(spark, d), NOW, within_days=7, limit=50)


@query(f"SELECT count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'pending' AND due_at < {NOW}) AS n_overdue, count(*) FILTER (status = 'pending' AND due_at BETWEEN {NOW} AND {NOW} + 604800) AS n_due_soon FROM commitments", "commitments")
def commitments_digest(spark, d):
    return ledger.digest(t.commitments(spark, d), NOW)


@query(r"""o AS (SELECT subject, content, min(id) AS id FROM commitments WHERE status = 'pending' GROUP BY 1, 2), k AS (SELECT subject, id, list_distinct(list_transform(list_filter(string_split(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.COMMITMENT_STOP_WORDS) + r""")), lambda w: CASE WHEN length(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END)) AS tk FROM o)
SELECT a.subject, a.id AS first_id, b.id AS second_id, round(len(list_intersect(a.tk, b.tk)) / least(len(a.tk), len(b.tk)), 6) AS overlap FROM k a JOIN k b ON a.subject = b.subject AND a.id < b.id WHERE len(a.tk) > 0 AND len(b.tk) > 0 AND len(list_intersect(a.tk, b.tk)) / least(len(a.tk), len(b.tk)) >= 0.75""", "commitments")
def commitment_overlap(spark, d):
    return ledger.duplicates(t.commitments(spark, d).filter("status = 'pending'"), 0.75)


# Streaming


def ingested(spark, d):
    """The conversations in two arrivals: two turns of three, then all turns of every other conversation, of which one in three says more."""
    from loam.sources.scratch import folder
    from loam.streaming.turns import TurnStore, ingest

    at, c = folder(spark), t.given(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    arrive = lambda df, n: df.write.parquet(f"{at}/arrived/part={n}")
    arrive(c.filter("turn % 3 <> 2"), 0)
    ingest(spark, f"{at}/arrived/part=*", f"{at}/store", f"{at}/checkpoint")
    arrive(c.filter("conv_id % 2 = 0").withColumn("text", F.expr("CASE WHEN turn % 3 = 0 THEN concat(text, ' more') ELSE text END")), 1)
    ingest(spark, f"{at}/arrived/part=*", f"{at}/store", f"{at}/checkpoint")
    return TurnStore.open(spark, f"{at}/store"), at


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, count(DISTINCT role) AS n_roles FROM conversations WHERE turn % 3 <> 2 OR conv_id % 2 = 0 GROUP BY 1")
def turn_stream_upsert(spark, d):
    from loam.streaming.turns import conversations

    return conversations(ingested(spark, d)[0]).drop("updated_at")


@query("""x AS (SELECT 0 AS version, 'insert' AS change, conv_id, turn, text FROM conversations WHERE turn % 3 <> 2 UNION ALL SELECT 1, 'insert', conv_id, turn, text FROM conversations WHERE turn % 3 = 2 AND conv_id % 2 = 0 UNION ALL SELECT 1, 'update', conv_id, turn, concat(text, ' more') FROM conversations WHERE turn % 3 = 0 AND conv_id % 2 = 0)
SELECT CAST(version AS BIGINT) AS version, change, concat(conv_id, ':', turn) AS id, md5(trim(text)) AS text_md5 FROM x""".replace("x AS", "WITH x AS", 1))
def turn_changes(spark, d):
    """The log of both arrivals, as a stream of versions tells it."""
    from loam.streaming.turns import LOGGED, follow

    store, at = ingested(spark, d)
    follow(spark, store.path, f"{at}/followed", lambda changes, versions: changes.write.mode("append").parquet(f"{at}/told"))
    return spark.read.schema(LOGGED).parquet(f"{at}/told").select("version", "change", "id", F.md5("text").alias("text_md5"))


@query("""SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    """An extension: tumbling windows over the event stream's table."""
    e = t.given(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


# Upkeep


@query("""g AS (SELECT list(id) AS gone FROM memories WHERE deleted_at IS NOT NULL), h AS (SELECT r.*, len(list_filter(source_memories, lambda x: list_contains(gone, x))) AS n FROM relationships r, g)
SELECT source, target, type, greatest(1.0, weight - 0.5 * n) AS weight, len(source_memories) - n AS n_left, len(source_memories) - n <= 0 AS stale FROM h WHERE n > 0""", "memories relationships")
def detach_evidence(spark, d):
    from loam.operators import upkeep

    return upkeep.detach_evidence(t.relationships(spark, d), t.memories(spark, d).filter("deleted_at IS NOT NULL"))


@query(TWICE + " SELECT m.id, count(x) + max(CASE WHEN m.id % 13 = 0 THEN 1 ELSE 0 END) AS n_cited, count(x) AS n_resolved, count(DISTINCT conversation_id) AS n_conversations FROM memories m LEFT JOIN tw USING (id) GROUP BY m.id", "memories exchanges")
def memory_provenance(spark, d):
    from loam.operators import upkeep

    return upkeep.provenance(*cites_twice(spark, d))


@query(f"SELECT id, deleted_at FROM memories WHERE deleted_at <= {NOW} - 115 * 86400", "memories")
def retention_purge(spark, d):
    from loam.operators import upkeep

    return upkeep.purge(t.memories(spark, d), NOW, 115)


@query("SELECT generation, count(*) AS n FROM clusters WHERE generation < (SELECT max(generation) FROM clusters) - 0 GROUP BY 1", "clusters")
def stale_generations(spark, d):
    from loam.operators import upkeep

    return upkeep.stale_generations(t.clusters(spark, d), 0)


@query("SELECT entity_id, min(generation) AS generation, arg_min(cluster_id, (generation, cluster_id)) AS cluster_id FROM clusters GROUP BY 1", "clusters")
def first_cluster(spark, d):
    from loam.operators import upkeep

    return upkeep.first_cluster(t.clusters(spark, d))


@query("y AS (SELECT source AS n, target AS other, type, weight FROM relationships UNION ALL SELECT target, source, type, weight FROM relationships) SELECT other, type, weight FROM y WHERE n = 's3' ORDER BY weight DESC, other, type LIMIT 25", "relationships")
def neighbours_by_weight(spark, d):
    from loam.operators import upkeep

    return upkeep.neighbours(t.relationships(spark, d), "s3")


@query(f"""y AS (SELECT n AS id, count(*) AS degree FROM (SELECT source AS n FROM relationships UNION ALL SELECT target FROM relationships) GROUP BY 1), b AS (SELECT source AS id, count(*) * 0.25 AS s FROM relationships GROUP BY 1),
x AS (SELECT e.*, coalesce(degree, 0) AS dg, coalesce(s, 0) AS bs FROM entities e LEFT JOIN y USING (id) LEFT JOIN b USING (id)), z AS (SELECT max(mention_count) AS tm, max(dg) AS td, max(bs) AS tb FROM x)
SELECT id, round(0.30 * CASE WHEN last_seen IS NULL THEN 0 ELSE exp(-({NOW} - last_seen) / (86400 * CAST(30 AS DOUBLE))) END + 0.10 * CASE WHEN first_seen IS NULL THEN 0 ELSE exp(-({NOW} - first_seen) / (86400 * CAST(90 AS DOUBLE))) END + 0.25 * log2(1 + mention_count) / log2(1 + tm) + 0.15 * log2(1 + dg) / log2(1 + td) + 0.20 * bs / tb, 6) AS relevance FROM x, z""", "entities relationships")
def node_relevance(spark, d):
    from loam.operators import upkeep

    bridges = t.relationships(spark, d).groupBy(F.col("source").alias("id")).agg((F.count("*") * 0.25).alias("bridge_score"))
    return upkeep.node_relevance(t.entities(spark, d), t.relationships(spark, d), bridges, NOW)


@query("c AS (SELECT DISTINCT source AS entity_id, unnest(source_memories) AS memory_id FROM relationships) SELECT DISTINCT cluster_id, memory_id FROM clusters JOIN c USING (entity_id) WHERE generation = 2", "relationships clusters")
def cluster_memories(spark, d):
    from loam.operators import upkeep

    cites = t.relationships(spark, d).select(F.col("source").alias("entity_id"), F.explode("source_memories").alias("memory_id"))
    return upkeep.cluster_memories(t.clusters(spark, d).filter("generation = 2"), cites)


@query("SELECT user_id % 10 AS run_id, event_type AS phase, count(*) FILTER (value >= 20) AS n_success, count(*) FILTER (value < 20) AS n_error FROM events GROUP BY 1, 2")
def pipeline_progress(spark, d):
    from loam.operators import upkeep

    e = t.given(spark, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("phase"), F.when(F.col("value") >= 20, "success").when(F.col("value") < 20, "error").alias("status"))
    return upkeep.progress(e)


@query("s AS (SELECT id % 40 AS session_id, confidence AS score FROM memories), a AS (SELECT session_id, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS spread, round(max(score), 6) AS best FROM s GROUP BY 1) SELECT *, CASE WHEN best >= 0.7 AND spread < 0.3 THEN 'drill' ELSE 'refine' END AS action FROM a", "memories")
def session_metrics(spark, d):
    from loam.operators import upkeep

    return upkeep.session_metrics(t.memories(spark, d).select((F.col("id") % 40).alias("session_id"), F.col("confidence").alias("score")))


@query("SELECT conversation_id, max(ts) AS last_indexed, count(*) AS exchange_count FROM exchanges GROUP BY 1 ORDER BY last_indexed DESC, exchange_count DESC, conversation_id LIMIT 30", "exchanges")
def conversation_priority(spark, d):
    from loam.operators import upkeep

    return upkeep.priorities(t.exchanges(spark, d).groupBy("conversation_id").agg(F.max("ts").alias("last_indexed"), F.count("*").alias("exchange_count")), 30)


@query("w AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY conversation_id ORDER BY exchange_index), 151) > 150 THEN 1 ELSE 0 END AS n FROM exchanges), s AS (SELECT *, sum(n) OVER (PARTITION BY conversation_id ORDER BY exchange_index) AS session FROM w) SELECT conversation_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start, max(ts) AS \"end\" FROM s GROUP BY 1, session", "exchanges")
def conversation_sessions(spark, d):
    from loam.operators import upkeep

    return upkeep.lagged_gaps(t.exchanges(spark, d), 150)


@query(f"ch AS (SELECT id, CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'superseded' ELSE 'dropped' END AS s, CASE WHEN id % 2 = 0 THEN id + 1 END AS other FROM commitments WHERE id % 10 = 1), v AS (SELECT * FROM ch WHERE s IN ('done', 'dropped') OR other IS NOT NULL) SELECT id, coalesce(s, status) AS status, other AS superseded_by, CASE WHEN s IS NOT NULL THEN CAST({NOW} AS BIGINT) END AS resolved_at FROM commitments LEFT JOIN v USING (id)", "commitments")
def commitments_resolve(spark, d):
    from loam.operators import upkeep

    c = t.commitments(spark, d)
    changes = c.filter("id % 10 = 1").selectExpr("id", "CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'superseded' ELSE 'dropped' END AS status", "CASE WHEN id % 2 = 0 THEN id + 1 END AS superseded_by")
    return upkeep.resolve(c, changes, NOW).select("id", "status", "superseded_by", "resolved_at")


@query("SELECT id, stale_since FROM entities WHERE stale_since IS NOT NULL ORDER BY stale_since DESC, id LIMIT 10", "entities")
def stale_entities(spark, d):
    return t.entities(spark, d).filter("stale_since IS NOT NULL").orderBy(F.desc("stale_since"), "id").limit(10).select("id", "stale_since")


@query("SELECT source, target FROM relationships WHERE source IN (SELECT id FROM entities WHERE mention_count >= 30) AND target IN (SELECT id FROM entities WHERE mention_count >= 30)", "entities relationships")
def edges_above_threshold(spark, d):
    seen = t.entities(spark, d).filter("mention_count >= 30").select("id")
    e = t.relationships(spark, d).select("source", "target")
    return e.join(seen.withColumnRenamed("id", "source"), "source", "left_semi").join(seen.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


from loam.plans import graph_queries, memory_queries, recall_queries, text_queries  # noqa: E402, F401  (they register their queries)
