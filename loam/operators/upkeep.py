"""Upkeep of the stores: evidence, provenance, retention, priorities and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import DAY, visible


def detach_evidence(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that cite forgotten memories (gone: id) lose those citations and half a point of weight for each, down to 1; without any left they are stale."""
    cited = edges.select("source", "target", "type", F.posexplode("source_memories").alias("at", "id"))
    hit = cited.join(gone.select("id").distinct(), "id", "left_semi").groupBy("source", "target", "type").agg(F.count("*").alias("n_lost"))
    left = F.size("source_memories") - F.col("n_lost")
    return edges.join(hit, ["source", "target", "type"]).select("source", "target", "type", F.greatest(F.lit(1.0), F.col("weight") - 0.5 * F.col("n_lost")).alias("weight"), left.cast("long").alias("n_left"), (left <= 0).alias("stale"))


def provenance(memories: DataFrame, exchanges: DataFrame) -> DataFrame:
    """memories: (id, source_exchanges). Per memory: cited, resolved and conversations behind it."""
    cite = memories.select("id", F.explode_outer("source_exchanges").alias("exchange_id"))
    known = cite.join(exchanges.select(F.col("id").alias("exchange_id"), "conversation_id"), "exchange_id", "left")
    return known.groupBy("id").agg(F.count("exchange_id").alias("n_cited"), F.count("conversation_id").alias("n_resolved"), F.countDistinct("conversation_id").alias("n_conversations"))


def purge(memories: DataFrame, now: int, keep_days: int) -> DataFrame:
    """Forgotten memories whose time of grace is over."""
    return memories.filter(F.col("deleted_at") <= now - keep_days * DAY).select("id", "deleted_at")


def stale_generations(rows: DataFrame, keep: int) -> DataFrame:
    """Generations below the latest minus `keep`: so keep + 1 of them stay."""
    latest = rows.agg((F.max("generation") - keep).alias("cutoff"))
    return rows.join(F.broadcast(latest), F.col("generation") < F.col("cutoff")).groupBy("generation").agg(F.count("*").alias("n"))


def first_cluster(members: DataFrame) -> DataFrame:
    """The first cluster of each entity, by generation and id."""
    return members.groupBy("entity_id").agg(F.min(F.struct("generation", "cluster_id")).alias("x")).select("entity_id", "x.generation", "x.cluster_id")


def neighbours(edges: DataFrame, node: str, limit: int = 25) -> DataFrame:
    from loam.operators.graph import both_ways

    return both_ways(edges, "type", "weight").filter(F.col("node") == node).orderBy(F.desc("weight"), "other", "type").limit(max(1, min(limit, 50))).select("other", "type", "weight")


def node_relevance(entities: DataFrame, edges: DataFrame, bridges: DataFrame, now: int) -> DataFrame:
    """0.30 recency + 0.10 age + 0.25 mentions + 0.15 degree + 0.20 bridge, each from 0 to 1 against the largest."""
    from loam.operators.graph import both_ways

    degree = both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    rows = entities.join(degree, "id", "left").join(bridges.select("id", "bridge_score"), "id", "left").fillna(0, ["degree", "bridge_score"])
    top = rows.agg(F.max("mention_count").alias("tm"), F.max("degree").alias("td"), F.max("bridge_score").alias("tb"))
    share = lambda c, t: F.when(F.col(t) > 0, F.log2(1 + F.col(c)) / F.log2(1 + F.col(t))).otherwise(F.lit(0.0))
    age = lambda c, days: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.exp(-(F.lit(now) - F.col(c)) / (DAY * days)))
    score = 0.30 * age("last_seen", 30.0) + 0.10 * age("first_seen", 90.0) + 0.25 * share("mention_count", "tm") + 0.15 * share("degree", "td") + 0.20 * F.when(F.col("tb") > 0, F.col("bridge_score") / F.col("tb")).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(top)).select("id", F.round(score, 6).alias("relevance"))


def cluster_memories(members: DataFrame, citations: DataFrame) -> DataFrame:
    """Memories linked to clusters through entities: members (cluster_id, entity_id), citations (entity_id, memory_id)."""
    return members.select("cluster_id", "entity_id").distinct().join(citations.distinct(), "entity_id").select("cluster_id", "memory_id").distinct()


def progress(checkpoints: DataFrame) -> DataFrame:
    """checkpoints: (run_id, phase, status)."""
    return checkpoints.groupBy("run_id", "phase").agg(F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "error").alias("n_error"))


def session_metrics(results: DataFrame) -> DataFrame:
    """results: (session_id, score). Quality and the advised next step."""
    high, spread = F.max("score"), F.max("score") - F.min("score")
    out = results.groupBy("session_id").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(spread, 6).alias("spread"), F.round(high, 6).alias("best"))
    return out.withColumn("action", F.when((F.col("best") >= 0.7) & (F.col("spread") < 0.3), "drill").otherwise("refine"))


def priorities(conversations: DataFrame, limit: int) -> DataFrame:
    """conversations: (conversation_id, last_indexed, exchange_count)."""
    return conversations.orderBy(F.desc("last_indexed"), F.desc("exchange_count"), "conversation_id").limit(limit)


def by_prefix(memories: DataFrame, prefix: str, scopes: list[str] | None = None) -> DataFrame:
    """Rows whose id is the prefix or, from six characters on, starts with it."""
    ident = F.col("id").cast("string")
    out = memories.filter((ident == prefix) | (F.lit(len(prefix) >= 6) & ident.startswith(prefix)))
    return out.filter(visible(F.col("scope"), scopes)) if scopes else out


def resolve(ledger: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes: (id, status, superseded_by). The ledger's next state; a row superseded needs its replacement, other changes of it are ignored."""
    valid = changes.filter(F.col("status").isin("done", "dropped") | ((F.col("status") == "superseded") & F.col("superseded_by").isNotNull()))
    c = valid.select("id", F.col("status").alias("_status"), "superseded_by")
    return ledger.join(c, "id", "left").withColumn("resolved_at", F.when(F.col("_status").isNotNull(), F.lit(now).cast("long"))).withColumn("status", F.coalesce("_status", "status")).drop("_status")


def lagged_gaps(exchanges: DataFrame, pause: int) -> DataFrame:
    """Sessions inside a conversation: a pause of over `pause` seconds starts a new one."""
    w = Window.partitionBy("conversation_id").orderBy("exchange_index")
    starts = exchanges.withColumn("new", F.when(F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(pause + 1)) > pause, 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return starts.groupBy("conversation_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
