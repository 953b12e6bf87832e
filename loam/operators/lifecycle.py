"""Memory lifecycle: filters, decay, reinforcement, collapse and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import fixed
from loam.functions.columns import confidence, content_hash, normalised, retrievability, stability, transient, visible


def _r(now: int) -> Column:
    return retrievability(now, F.col("last_accessed"), F.col("created_at"), stability(F.col("type"), F.col("stability")))


def health(memories: DataFrame, now: int) -> DataFrame:
    """Retrievability, effective confidence and whether it may be pruned (below 0.1)."""
    r = _r(now)
    c = confidence(F.col("confidence"), F.col("access_count"), r)
    return memories.select("id", F.round(r, 6).alias("retrievability"), F.round(c, 6).alias("confidence"), (F.round(c, 6) < 0.1).alias("prune_eligible"))


def prune(memories: DataFrame, now: int) -> DataFrame:
    """Active memories whose effective confidence has fallen below 0.1."""
    return health(memories.filter("is_active"), now).filter("prune_eligible").select("id", "confidence")


def reinforce(memories: DataFrame, returned: DataFrame, now: int) -> DataFrame:
    """The next state of the active memories that a search returned."""
    r, s = _r(now), stability(F.col("type"), F.col("stability"))
    rows = memories.filter("is_active").join(returned.select("id"), "id", "left_semi")
    return rows.select("id", F.round(s * (1 + 0.2 * (1 - r)), 6).alias("stability"), F.round(F.least(F.lit(1.0), F.col("importance") + 0.02), 6).alias("importance"), (F.col("access_count") + 1).alias("access_count"), F.lit(now).cast("long").alias("last_accessed"))


def transient_policy(memories: DataFrame) -> DataFrame:
    t = transient(F.col("content"))
    return memories.select("id", t.alias("transient"), F.round(F.when(t, F.least("importance", F.lit(fixed.TRANSIENT_IMPORTANCE))).otherwise(F.col("importance")), 6).alias("importance"), F.when(t, F.lit(fixed.TRANSIENT_STABILITY)).otherwise(stability(F.col("type"), F.col("stability"))).alias("stability"))


def collapse_exact(facts: DataFrame) -> DataFrame:
    """Facts with one normalised content become one: the most confident, then most important, then first; sources are united. The group's rows meet only as partial aggregates."""
    key = normalised(F.col("content"))
    best = F.max_by(F.struct("id", "confidence", "importance", "context"), F.struct(F.round("confidence", 6), F.round("importance", 6), -F.col("id")))
    out = facts.groupBy(content_hash(F.col("content")).alias("content_hash")).agg(best.alias("w"), F.count("*").alias("n_merged"), F.array_sort(F.collect_set("context")).alias("sources"), F.max(F.length(key)).alias("key_length"))
    return out.select("content_hash", F.col("w.id").alias("id"), F.round("w.confidence", 6).alias("confidence"), "n_merged", F.array_join("sources", ",").alias("sources"), F.col("key_length").cast("long").alias("key_length"))


def suppressed(facts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Facts that stay: their content's hash is suppressed neither in their scope nor globally. suppressions: (content_hash, scope)."""
    f = facts.withColumn("content_hash", content_hash(F.col("content"))).withColumn("scope", F.coalesce("scope", F.lit("global")))
    s = suppressions.select("content_hash", "scope").distinct()
    return f.join(s, ["content_hash", "scope"], "left_anti").join(s.filter("scope = 'global'").select("content_hash"), "content_hash", "left_anti").select("id", "content_hash", "scope")


def listing(memories: DataFrame, kind: str | None = None, scopes: list[str] | None = None, since: int | None = None, contains: str | None = None, inactive: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    out = memories.filter(F.col("deleted_at").isNull())
    if not inactive:
        out = out.filter("is_active")
    if kind:
        out = out.filter(F.col("type") == kind)
    if scopes:
        out = out.filter(visible(F.col("scope"), scopes))
    if since is not None:
        out = out.filter(F.col("created_at") >= since)
    if contains:
        out = out.filter(F.lower("content").contains(contains.lower()))
    return out.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).select("id", "type", "created_at")


def date_filter(memories: DataFrame, basis: str = "filed", after: int | None = None, before: int | None = None, anniversary: str | None = None) -> DataFrame:
    """Epoch bounds, both inclusive, or a month and day, on the filing time or the event's."""
    at = F.col("created_at") if basis == "filed" else F.coalesce("event_ts", "created_at")
    out = memories
    if after is not None:
        out = out.filter(at >= after)
    if before is not None:
        out = out.filter(at <= before)
    if anniversary:
        out = out.filter(F.date_format(F.timestamp_seconds(at), "MM-dd") == anniversary)
    return out.select("id", at.alias("at"))


def forget(memories: DataFrame, ids: DataFrame, actor: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next memories, the change log's new rows and the new suppressions of a soft forget."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    marked = memories.join(gone, "id", "left").withColumn("_hit", F.coalesce(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(False)))
    hit = F.col("_hit")
    hits = marked.filter(hit)
    log = hits.select(F.col("id").alias("memory_id"), F.lit("forget").alias("op"), F.col("content").alias("before"), F.lit(actor).alias("actor"), F.lit(now).cast("long").alias("at"))
    stops = hits.select(content_hash(F.col("content")).alias("content_hash"), F.coalesce("scope", F.lit("global")).alias("scope"), F.col("id").alias("memory_id"))
    after = marked.withColumn("deleted_at", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at"))).withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active"))).drop("_gone", "_hit")
    return after, log, stops


def upsert(old: DataFrame, new: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """Latest version of each key wins; ties go to the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def reached_events(memories: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Each memory's earliest source exchange; memories: (id, source_exchanges)."""
    src = memories.select("id", F.explode("source_exchanges").alias("exchange_id"))
    first = src.join(exchanges.select(F.col("id").alias("exchange_id"), "ts"), "exchange_id").groupBy("id").agg(F.min("ts").alias("event_ts"))
    return memories.select("id").join(first, "id", "left")
