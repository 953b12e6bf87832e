"""Temporal patterns over entities and generations of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import DAY


def windows(entities: DataFrame, days: int, least: int = 0, col: str = "first_seen") -> DataFrame:
    """Tumbling windows that hold at least `least` entities."""
    size = days * DAY
    out = entities.filter(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) / size).alias("window")).agg(F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).select((F.col("window") * size).alias("time_start"), ((F.col("window") + 1) * size).alias("time_end"), "n")


def bursts(entities: DataFrame, days: int = 7) -> DataFrame:
    """Windows with at least twice the average of the windows that aren't empty; there must be two, and a threshold of 2."""
    w = windows(entities, days)
    stats = w.agg(F.avg("n").alias("average"), F.count("*").alias("n_windows"))
    out = w.join(F.broadcast(stats)).withColumn("threshold", F.col("average") * 2).filter((F.col("n_windows") >= 2) & (F.col("threshold") >= 2) & (F.col("n") >= F.col("threshold")))
    return out.select("time_start", "time_end", "n", F.round(F.col("n") / F.col("average"), 6).alias("ratio"), F.round(F.least(F.lit(0.9), 0.5 + (F.col("n") / F.col("threshold") - 1) * 0.2), 6).alias("confidence"))


def emergence(entities: DataFrame, days: int = 7, least: int = 3) -> DataFrame:
    return windows(entities, days, least).withColumn("confidence", F.round(F.least(F.lit(0.9), 0.4 + F.col("n") * 0.05), 6))


def decay(entities: DataFrame, now: int, days: int = 30, least: int = 3) -> DataFrame:
    """Entities mentioned twice or more and not seen for `days`, by windows of that size."""
    size = days * DAY
    stale = entities.filter((F.col("last_seen") < now - size) & (F.col("mention_count") >= 2))
    out = stale.groupBy(F.floor(F.col("last_seen") / size).alias("window")).agg(F.count("*").alias("n"), F.min("last_seen").alias("low"), F.max("last_seen").alias("high")).filter(F.col("n") >= least)
    idle = F.floor((now - (F.col("low") + F.col("high")) / 2) / DAY + 0.5)
    return out.select((F.col("window") * size).alias("time_start"), ((F.col("window") + 1) * size).alias("time_end"), "n", idle.alias("days_stale"), F.round(F.least(F.lit(0.9), 0.5 + idle / (days * 2) * 0.3), 6).alias("confidence"))


def evolution(clusters: DataFrame, previous: int, current: int) -> DataFrame:
    """clusters: (generation, cluster_id, entity_id). Growth, contraction, birth and death between two generations by the best Jaccard match over 0.1; clusters meet only through shared members."""
    side = lambda g, c, n: clusters.filter(F.col("generation") == g).select(F.col("cluster_id").alias(c), "entity_id").distinct().withColumn(n, F.lit(1))
    cur, old = side(current, "cur", "one").drop("one"), side(previous, "old", "one").drop("one")
    n_cur, n_old = cur.groupBy("cur").agg(F.count("*").alias("n_cur")), old.groupBy("old").agg(F.count("*").alias("n_old"))
    pairs = cur.join(old, "entity_id").groupBy("cur", "old").agg(F.count("*").alias("shared")).join(n_cur, "cur").join(n_old, "old")
    pairs = pairs.withColumn("jaccard", F.round(F.col("shared") / (F.col("n_cur") + F.col("n_old") - F.col("shared")), 6))
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("cur").orderBy(F.desc("jaccard"), "old"))).filter("k = 1 AND jaccard > 0.1")
    matched = n_cur.join(best.select("cur", "old", "n_old", "jaccard"), "cur", "left")
    kind = F.when(F.col("old").isNull(), "birth").when(F.col("n_cur") > F.col("n_old"), "growth").when(F.col("n_cur") < F.col("n_old"), "contraction")
    sure = F.when(F.col("old").isNull(), F.lit(0.7)).otherwise(F.round(F.least(F.lit(0.9), F.col("jaccard") + 0.1), 6))
    changed = matched.select(F.col("cur").alias("cluster_id"), kind.alias("change"), F.col("n_old").alias("previous_size"), F.col("n_cur").alias("current_size"), sure.alias("confidence")).filter("change IS NOT NULL")
    dead = n_old.join(best.select("old"), "old", "left_anti")
    return changed.unionByName(dead.select(F.col("old").alias("cluster_id"), F.lit("death").alias("change"), F.col("n_old").alias("previous_size"), F.lit(None).cast("long").alias("current_size"), F.lit(0.6).alias("confidence")))


def new_bridges(scores: DataFrame, previous: int, current: int) -> DataFrame:
    """scores: (entity_id, generation, bridge_score). Bridges of the current generation that the previous one had not."""
    before = scores.filter(F.col("generation") == previous).select("entity_id")
    return scores.filter(F.col("generation") == current).join(before, "entity_id", "left_anti").select("entity_id", F.round("bridge_score", 6).alias("bridge_score"))


def window_members(entities: DataFrame, days: int, least: int = 0, col: str = "first_seen") -> DataFrame:
    """Tumbling windows with the ids and names of their entities, in the order of the ids."""
    size = days * DAY
    w = entities.filter(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) / size).alias("window")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("m")).filter(F.col("n") >= least)
    return w.select((F.col("window") * size).alias("time_start"), ((F.col("window") + 1) * size).alias("time_end"), "n", F.col("m.id").alias("entity_ids"), F.col("m.name").alias("names"))


def gained_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters of two generations by their ids: how many members each gained and lost."""
    a, b = (x.select("cluster_id", "entity_id").distinct().withColumn(n, F.lit(1)) for x, n in ((before, "_b"), (after, "_a")))
    both = a.join(b, ["cluster_id", "entity_id"], "full_outer").groupBy("cluster_id").agg(F.count_if(F.col("_b").isNull()).alias("gained"), F.count_if(F.col("_a").isNull()).alias("lost"), F.count("_a").alias("na"), F.count("_b").alias("nb"))
    return both.filter("na > 0 AND nb > 0").select("cluster_id", "gained", "lost")


def bridge_pattern(scores: DataFrame) -> DataFrame:
    """One row for the bridges of the latest generation that the one before had not, or none."""
    latest = [r[0] for r in scores.select("generation").distinct().orderBy(F.desc("generation")).limit(2).collect()]
    new = new_bridges(scores, latest[1] if len(latest) > 1 else -1, latest[0]) if latest else scores.limit(0).select("entity_id", "bridge_score")
    ids = F.array_sort(F.collect_set("entity_id"))
    return new.agg(F.countDistinct("entity_id").alias("n"), ids.alias("entity_ids")).filter("n > 0").select(F.lit("bridge_formation").alias("kind"), "n", "entity_ids", F.round(F.least(F.lit(0.9), 0.5 + F.col("n") * 0.1), 6).alias("confidence"))


def patterns(entities: DataFrame, clusters: DataFrame, scores: DataFrame, now: int, burst_days: int = 7, stale_days: int = 30, least: int = 3, kind: str | None = None) -> DataFrame:
    """All five kinds of patterns in one list: (kind, subject, n, confidence), best first; `kind` picks one."""
    when = F.col("time_start").cast("string").alias("subject")
    out = bursts(entities, burst_days).select(F.lit("entity_burst").alias("kind"), when, "n", "confidence")
    out = out.unionByName(emergence(entities, burst_days, least).select(F.lit("topic_emergence").alias("kind"), when, "n", "confidence"))
    out = out.unionByName(decay(entities, now, stale_days, least).select(F.lit("topic_decay").alias("kind"), when, "n", "confidence"))
    latest = [r[0] for r in clusters.select("generation").distinct().orderBy(F.desc("generation")).limit(2).collect()]
    if len(latest) == 2:
        changed = evolution(clusters, latest[1], latest[0])
        out = out.unionByName(changed.select(F.lit("community_evolution").alias("kind"), F.concat_ws(":", "change", "cluster_id").alias("subject"), F.coalesce("current_size", "previous_size").alias("n"), "confidence"))
    out = out.unionByName(bridge_pattern(scores).select("kind", F.array_join(F.slice("entity_ids", 1, 3), ", ").alias("subject"), "n", "confidence"))
    if kind:
        out = out.filter(F.col("kind") == kind)
    return out.orderBy(F.desc("confidence"), "kind", "subject")


def changes(rows: DataFrame, kind: str, since: int) -> DataFrame:
    """rows: (id, first_seen, last_seen). What is new since a time, and what was seen again."""
    new = F.col("first_seen") > since
    return rows.filter(new | ((F.col("last_seen") > since) & (F.col("first_seen") <= since))).select(F.lit(kind).alias("kind"), "id", F.when(new, "new").otherwise("updated").alias("change"))
