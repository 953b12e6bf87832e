"""The domain tables over the given ones. Only this module knows the given tables' names and columns.

Each derivation is one list of expressions in the SQL that Spark and DuckDB share, so that the oracles read the same tables.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.sources.files import fingerprint
from loam.sources.scratch import dealt, shared

NOW = 1_750_000_000

MEMORIES = [
    "doc_id AS id", "text AS content", "source AS context",
    "CASE doc_id % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'pattern' WHEN 4 THEN 'solution' ELSE 'convention' END AS type",
    "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN lang = 'en' THEN 'global' ELSE concat('tenant:', lang) END AS scope",
    "CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (doc_id % 7) AS confidence", "CAST(0.1 AS DOUBLE) + CAST(0.08 AS DOUBLE) * (doc_id % 11) AS importance",
    "doc_id % 9 AS access_count", "1700000000 + doc_id * 3600 AS created_at",
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1700000000 + doc_id * 3600 + (doc_id % 50) * 86400 END AS last_accessed",
    "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 1700000000 + doc_id * 3600 - (doc_id % 30) * 86400 END AS event_ts",
    "CASE WHEN doc_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(10 + doc_id % 40 AS DOUBLE) END AS stability",
    "doc_id % 10 <> 0 AS is_active", "CASE WHEN doc_id % 97 = 5 THEN 1740000000 + doc_id ELSE NULL END AS deleted_at",
]

EVENTS = [
    "event_id AS id", "concat('Send item ', CAST(event_id % 500 AS VARCHAR(20)), ' to user ', CAST(user_id AS VARCHAR(20))) AS content", "user_id AS subject",
    "CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'dropped' ELSE 'pending' END AS status",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1749000000 + (event_id % 60) * 86400 END AS due_at", "1700000000 + event_id AS created_at",
    "CASE WHEN event_id % 3 = 0 THEN 'global' ELSE 'tenant:a' END AS scope",
]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "documents").selectExpr(*MEMORIES)


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in EVENTS])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "conversations")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"))

    def seen(key: str) -> DataFrame:
        return line.groupBy(F.col(key).alias("key")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("mention_count"), F.countDistinct("l_orderkey").alias("conversation_count"))

    def rows(name: str, key: str, label: str, prefix: str, kind: str, use: DataFrame | None) -> DataFrame:
        base = given(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), F.col(label).alias("name"))
        base = base.join(use, "key", "left") if use is not None else base.select("*", *[F.lit(None).cast("long").alias(c) for c in ("first_seen", "last_seen", "mention_count", "conversation_count")])
        return base.select(
            F.concat(F.lit(prefix), F.col("key").cast("string")).alias("id"), "name", F.lit(kind).alias("type"), "first_seen", "last_seen", F.coalesce("mention_count", F.lit(0)).cast("long").alias("mention_count"),
            F.coalesce("conversation_count", F.lit(0)).cast("long").alias("conversation_count"), F.when(F.col("key") % 13 == 0, F.lit(1_740_000_000) + F.col("key")).alias("stale_since"),
            F.expr("CASE key % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tenant:a' ELSE 'global' END").alias("scope"),
        )

    out = rows("supplier", "s_suppkey", "s_name", "s", "person", seen("l_suppkey")).unionByName(rows("part", "p_partkey", "p_name", "p", "tool", seen("l_partkey")))
    return out.unionByName(rows("nation", "n_nationkey", "n_name", "n", "concept", None)).unionByName(rows("region", "r_regionkey", "r_name", "r", "project", None))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    line = given(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    uses = dealt(line, line.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    uses = uses.select(ident("s", "l_suppkey").alias("source"), ident("p", "l_partkey").alias("target"), F.lit("uses").alias("type"), "weight", F.array((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 997).alias("source_memories"))
    part_of = lambda n, a, pa, b, pb: given(spark, sf_dir, n).select(ident(pa, a).alias("source"), ident(pb, b).alias("target"), F.lit("part_of").alias("type"), F.lit(1.0).alias("weight"), F.array().cast("array<long>").alias("source_memories"))
    return uses.unionByName(part_of("supplier", "s_suppkey", "s", "s_nationkey", "n")).unionByName(part_of("nation", "n_nationkey", "n", "n_regionkey", "r"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of groups of suppliers, a row per member: by nation, and by nation with one in seven moved on."""
    s = given(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), "s_suppkey", F.col("s_nationkey").cast("long").alias("k"))
    first = s.select(F.lit(1).cast("long").alias("generation"), "k", "entity_id")
    second = s.filter("s_suppkey % 11 <> 0").select(F.lit(2).cast("long").alias("generation"), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN (k + 1) % 30 ELSE k END").alias("k"), "entity_id")
    return first.unionByName(second).select("generation", F.concat(F.lit("c"), F.col("k").cast("string")).alias("cluster_id"), "entity_id")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.operators.episodes import pair_turns

    out = pair_turns(turns(spark, sf_dir).select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("line"), "role", "text"))
    return out.withColumn("ts", F.lit(1_700_000_000) + F.col("conversation_id") * 86400 + F.col("first_line") * 60).withColumn("scope", F.expr("CASE WHEN conversation_id % 3 = 0 THEN 'tenant:a' ELSE 'global' END"))


_indexes: dict = {}
INDEXED = {
    "memories": (["documents"], lambda s, d: memories(s, d).select("id", "content", "context"), {"content": 1.0, "context": 0.25}),
    "exchanges": (["conversations"], lambda s, d: exchanges(s, d).select("id", "user_message", "assistant_message"), {"user_message": 1.0, "assistant_message": 1.0}),
    "entities": (["supplier", "part", "nation", "region"], lambda s, d: entities(s, d).select("id", "name"), {"name": 1.0}),
}


def text_index(spark: SparkSession, sf_dir: str, name: str):
    """The full-text index of memories, exchanges or entities. It is stored under spark.loam.index.dir, or else the folder for written tables, by the given files it was made from: an application that finds it there reads no text, and files that have changed get an index of their own."""
    from loam.operators.text_index import FORMAT, TextIndex, build

    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _indexes:
        given_, rows, weights = INDEXED[name]
        made_from = "|".join(f"{t}={fingerprint(spark, f'{sf_dir}/{t}.parquet')}" for t in given_)
        path = f"{spark.conf.get('spark.loam.index.dir', None) or shared(spark)}/text-index/{hashlib.md5(f'{FORMAT}|{sf_dir}|{name}|{weights}|{made_from}'.encode()).hexdigest()}"
        _indexes[key] = TextIndex.open(spark, path) or build(rows(spark, sf_dir), weights, path)
    return _indexes[key]


# The same tables for DuckDB.
SQL = {
    "memories": f"memories AS (SELECT {', '.join(MEMORIES)} FROM documents)",
    "commitments": f"commitments AS (SELECT {', '.join(EVENTS)} FROM events)",
    "exchanges": """t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations WHERE role IN ('user', 'assistant')),
x AS (SELECT conv_id, island, min(turn) AS first_line, max(CASE WHEN role = 'assistant' THEN turn END) AS last_line, max(CASE WHEN role = 'user' THEN text END) AS user_message,
  string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY turn) AS assistant_message FROM t WHERE island > 0 GROUP BY conv_id, island HAVING count(CASE WHEN role = 'assistant' THEN 1 END) > 0),
exchanges AS (SELECT md5(concat(conv_id, ':', first_line, '-', last_line)) AS id, conv_id AS conversation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_line) - 1 AS BIGINT) AS exchange_index, first_line, last_line,
  user_message, assistant_message, CAST(ceil((length(user_message) + length(assistant_message)) / 4) AS BIGINT) AS token_estimate, 1700000000 + conv_id * 86400 + first_line * 60 AS ts,
  CASE WHEN conv_id % 3 = 0 THEN 'tenant:a' ELSE 'global' END AS scope FROM x)""",
    "entities": """l AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT) AS ts FROM lineitem),
e AS (SELECT 's' AS p, 'person' AS type, s_suppkey AS key, s_name AS name, u.* EXCLUDE (l_suppkey) FROM supplier LEFT JOIN (SELECT l_suppkey, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS m, count(DISTINCT l_orderkey) AS c FROM l GROUP BY 1) u ON l_suppkey = s_suppkey
  UNION ALL SELECT 'p', 'tool', p_partkey, p_name, u.* EXCLUDE (l_partkey) FROM part LEFT JOIN (SELECT l_partkey, min(ts), max(ts), count(*), count(DISTINCT l_orderkey) FROM l GROUP BY 1) u ON l_partkey = p_partkey
  UNION ALL SELECT 'n', 'concept', n_nationkey, n_name, NULL, NULL, NULL, NULL FROM nation UNION ALL SELECT 'r', 'project', r_regionkey, r_name, NULL, NULL, NULL, NULL FROM region),
entities AS (SELECT concat(p, key) AS id, name, type, first_seen, last_seen, coalesce(m, 0) AS mention_count, coalesce(c, 0) AS conversation_count, CASE WHEN key % 13 = 0 THEN 1740000000 + key END AS stale_since,
  CASE key % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tenant:a' ELSE 'global' END AS scope FROM e)""",
    "relationships": """relationships AS (SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, 'uses' AS type, CAST(count(*) AS DOUBLE) AS weight, [(l_suppkey * 7 + l_partkey) % 997] AS source_memories FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'part_of', 1.0, [] FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'part_of', 1.0, [] FROM nation)""",
    "clusters": """clusters AS (SELECT CAST(1 AS BIGINT) AS generation, concat('c', s_nationkey) AS cluster_id, concat('s', s_suppkey) AS entity_id FROM supplier
  UNION ALL SELECT 2, concat('c', CASE WHEN s_suppkey % 7 = 0 THEN (s_nationkey + 1) % 30 ELSE s_nationkey END), concat('s', s_suppkey) FROM supplier WHERE s_suppkey % 11 <> 0)""",
}


def with_tables(names: str, sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names.split()) + (",\n" if sql.lstrip()[:6].upper() != "SELECT" else "\n") + sql
