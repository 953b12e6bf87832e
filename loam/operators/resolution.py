"""Names resolved to entities in order: what a name finds includes what earlier names of the batch have made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.graph_store import widened
from loam.operators.ordered import WINDOW, placed, tiles, unit
from loam.sources.scratch import save, ship

HITS = "n long, cosine double, id string, type string"
FOLDED = "n long, stage string, entity_id string"


def resolve(extracted: DataFrame, entities: DataFrame, vectors: DataFrame, near: float = 0.95, same_type: float = 0.85, k: int = 5, window: int = WINDOW) -> DataFrame:
    """extracted: (pos, name, type, embedding), pos unique; entities: (id, name, type, aliases); vectors: (id, embedding). (pos, stage, entity_id) of every extracted name: the entity of that name, but for case, or with that alias (`exact_name`, `alias`; the smaller id of several); else of its k nearest, nearest first, the first that is near enough, or nearly so and of the type (`embedding`); else a new one (`created`). What a name has made, and the alias that it became of an entity it resembles, hold for all later names, whatever their number.

    A name counts once for its repeats, which find the entity it made by name, or the one it was merged with by alias. Names that no text finds go on by windows: each first meets all vectors, those of entities made so far too, in tiles of which only the k best come back; then the window's own new entities are told in one task. Cosines are taken to 6 digits. A name without a vector resembles nothing."""
    key = F.lower("name")
    lead = save(extracted.groupBy(key.alias("key")).agg(F.min_by(F.struct("pos", "type", "embedding"), "pos").alias("x")).select("key", "x.*"))
    names = entities.select("id", key.alias("key")).groupBy("key").agg(F.min("id").alias("named"))
    aliases = entities.select("id", F.explode("aliases").alias("alias")).groupBy(F.lower("alias").alias("key")).agg(F.min("id").alias("alias"))
    told = save(lead.join(names, "key", "left").join(aliases, "key", "left"))
    rest = placed(told.filter("named IS NULL AND alias IS NULL").select(F.lit(0).alias("g"), "key", "pos", "type", "embedding"), ["g"], ["pos"])
    known = vectors.select(F.lit(0).alias("g"), F.col("id").alias("key"), "embedding").join(entities.select(F.col("id").alias("key"), F.col("type").alias("is")), "key")
    last, done = rest.agg(F.max("n")).first()[0], None
    ship(rest.sparkSession)

    def close(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame(columns=["n", "cosine", "id", "type"])
        both = unit([*asked["embedding"], *there["embedding"]])
        cos = np.round(both[: len(asked)] @ both[len(asked) :].T, 6)
        i, j = np.nonzero(cos >= same_type)
        out = pd.DataFrame({"n": asked["n"].to_numpy()[i], "cosine": cos[i, j], "id": there["key"].to_numpy()[j], "type": there["is"].to_numpy()[j]})
        return out.sort_values(["n", "cosine", "id"], ascending=[True, False, True]).groupby("n").head(k)

    def fold(part: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        vec, there = unit(list(part["embedding"])), {}
        for n, *hit in zip(hits["n"], -hits["cosine"], hits["id"], hits["type"]):
            there.setdefault(n, []).append(tuple(hit))
        made, held, out = [], np.zeros_like(vec), []
        for i, (n, pos, kind) in enumerate(zip(part["n"], part["pos"], part["type"])):
            cos = np.round(held[: len(made)] @ vec[i], 6)
            found = sorted(there.get(n, []) + [(-cos[j], *made[j]) for j in np.flatnonzero(cos >= same_type)], key=lambda x: x[:2])[:k]
            hit = next((x[1] for x in found if -x[0] >= near or x[2] == kind), None)
            if hit is None:
                held[len(made)] = vec[i]
                made.append((f"new-{pos}", kind))
            out.append((n, "created" if hit is None else "embedding", hit or made[-1][0]))
        return pd.DataFrame(out, columns=["n", "stage", "entity_id"])

    for low in range(0, 0 if last is None else last + 1, window):
        part = rest.filter(F.col("n").between(low, low + window - 1))
        hits = tiles(part.select("g", "n", "embedding"), known, ["g"], close, HITS)
        best = Window.partitionBy("n").orderBy(F.desc("cosine"), "id")  # a few of each tile
        hits = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select(F.lit(0).alias("g"), "n", "cosine", "id", "type")
        folded = save(part.groupBy("g").cogroup(hits.groupBy("g")).applyInPandas(fold, FOLDED))
        done = folded if done is None else done.unionByName(folded)
        if low + window <= last:
            fresh = part.join(folded.filter("stage = 'created'"), "n").select(F.col("entity_id").alias("key"), "g", "embedding", F.col("type").alias("is"))
            known = known.unionByName(save(fresh))
    unseen = rest.join(done, "n").select("pos", "stage", "entity_id") if done is not None else rest.select("pos", F.lit("").alias("stage"), F.lit("").alias("entity_id"))
    out = told.select("key", F.col("pos").alias("leader"), "named", "alias").join(unseen.withColumnRenamed("pos", "leader"), "leader", "left")
    stage = F.when(F.col("named").isNotNull(), "exact_name").when(F.col("alias").isNotNull(), "alias").otherwise(F.col("stage"))
    out = save(out.select("key", "leader", stage.alias("stage"), F.coalesce("named", "alias", "entity_id").alias("entity_id")))
    again = F.when(F.col("stage") == "created", "exact_name").when(F.col("stage") == "embedding", "alias").otherwise(F.col("stage"))
    return extracted.select("pos", key.alias("key")).join(out, "key").select("pos", F.when(F.col("pos") == F.col("leader"), F.col("stage")).otherwise(again).alias("stage"), "entity_id")


def applied(extracted: DataFrame, resolved: DataFrame, entities: DataFrame, now: int) -> DataFrame:
    """extracted: (pos, name, type, scope), entities: (id, name, type, aliases, mention_count, first_seen, last_seen, scope). The next entities: each name is a mention; names merged by resemblance become aliases, in their order, unless they are the name or an alias already, but for case; an entity seen from another scope becomes global; created ones are added."""
    rows = extracted.select("pos", "name", "type", "scope").join(resolved, "pos")
    made = F.col("stage") == "created"
    seen = rows.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.min("scope").alias("low"), F.max("scope").alias("high"), F.max_by(F.when(made, F.struct("name", "type", "scope")), F.when(made, F.col("pos"))).alias("new"),
    )
    said = rows.filter("stage = 'embedding'").groupBy("entity_id", F.lower("name").alias("k")).agg(F.min(F.struct("pos", "name")).alias("x"))
    said = said.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("more"))
    both = entities.join(seen.join(said, "entity_id", "left").withColumnRenamed("entity_id", "id"), "id", "full_outer")
    own = F.coalesce("scope", F.when(F.col("new").isNotNull(), F.coalesce("new.scope", F.lit("global"))))
    foreign = F.when(F.col("low") != own, F.col("low")).otherwise(F.col("high"))
    none = F.array().cast("array<string>")
    name, aliases = F.coalesce("name", "new.name"), F.coalesce("aliases", none)
    taken = F.transform(F.concat(aliases, F.array(name)), F.lower)
    fresh = F.filter(F.coalesce("more", none), lambda x: ~F.array_contains(taken, F.lower(x)))
    hit = F.col("n").isNotNull()
    return both.select(
        "id", name.alias("name"), F.coalesce("type", "new.type").alias("type"), F.concat(aliases, fresh).alias("aliases"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("mention_count"),
        F.coalesce("first_seen", F.when(hit, F.lit(now).cast("long"))).alias("first_seen"), F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_seen")).alias("last_seen"), widened(own, foreign).alias("scope"),
    )
