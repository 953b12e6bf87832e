"""Facts into memories: collapse, consolidation, conflicts, remembering, editing and purging.

What a model decides (entailment, merged wording) is injected as a function from columns to a column.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import content_hash, dot, norm, normalised
from loam.sources.scratch import ship

MERGE, ASK, SURE, PENALTY = 0.95, 0.85, 0.7, 0.8
BLOCK, STRIP, PAIRS = 16_384, 256, 65_536  # rows of a tile's side, facts multiplied at a time, pairs looked at again at a time


def contradicted(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Contradicted memories (ids: id) are less stable: 0.8 of what they were."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.round(F.col("stability") * PENALTY, 6).alias("stability"))


def _key() -> Column:
    """Equal for facts that say the same; the bare content where nothing of it is a word."""
    k = normalised(F.col("content"))
    return F.when(k == "", F.col("content")).otherwise(k)


def collapse_batches(facts: DataFrame) -> DataFrame:
    """facts: (batch, pos, content, confidence, importance, context, sources). Facts that say the same become one, in the place (batch, pos) of the first of them, with the wording of the most confident, then most important, then first, the first known context and all sources in order. Groups meet only as partial aggregates and, for the sources, as their distinct ones."""
    rows = facts.withColumn("key", F.sha2(_key(), 256))
    place, better = F.struct("batch", "pos"), F.struct(F.round("confidence", 6), F.round("importance", 6), -F.col("batch"), -F.col("pos"))
    best = rows.groupBy("key").agg(F.min(place).alias("at"), F.max_by(F.struct("content", "confidence", "importance", "context"), better).alias("w"), F.min_by(F.when(F.col("context").isNotNull(), F.col("context")), F.when(F.col("context").isNotNull(), place)).alias("said"), F.count("*").alias("n_merged"))
    src = rows.select("key", "batch", "pos", F.posexplode("sources").alias("k", "source")).groupBy("key", "source").agg(F.min(F.struct("batch", "pos", "k")).alias("o"))
    src = src.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]).alias("sources"))
    return best.join(src, "key", "left").select("at.batch", "at.pos", "w.content", "w.confidence", "w.importance", F.coalesce("w.context", "said").alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "n_merged")


def nearest(facts: DataFrame, memories: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """facts: (fact_id, scope, content, embedding); memories: (id, scope, content, embedding). The k nearest memories of each fact in its scope: (fact_id, id, cosine, n, fact, content). Zero vectors and those with null or non-finite parts are near nothing.

    Every fact meets every memory of its scope, in tiles of at most about `block` facts and `block` memories. Only ids and vectors go to the tiles and only a tile's k best for each fact leave it; texts are joined to the k that are left."""
    ship(facts.sparkSession)
    scope = F.coalesce("scope", F.lit("global")).alias("scope")
    f = facts.select("fact_id", scope, F.col("embedding").alias("q"))
    m = memories.select("id", scope, F.col("embedding").alias("v"))
    count = lambda rows, name: rows.groupBy("scope").agg(F.ceil(F.count("*") / block).alias(name))
    blocks = count(f, "_f").join(count(m, "_m"), "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = f.join(blocks, "scope").withColumn("_f", of("fact_id", "_f")).withColumn("_m", every("_m"))
    right = m.join(blocks, "scope").withColumn("_m", of("id", "_m")).withColumn("_f", every("_f"))
    kinds = f"fact_id {facts.schema['fact_id'].dataType.simpleString()}, id {memories.schema['id'].dataType.simpleString()}, cosine double"
    near = left.groupBy("scope", "_f", "_m").cogroup(right.groupBy("scope", "_f", "_m")).applyInPandas(lambda q, v: _best(q, v, k), kinds)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("cosine"), "id"))).filter(F.col("n") <= k)
    return best.join(memories.select("id", "content"), "id").join(facts.select("fact_id", F.col("content").alias("fact")), "fact_id").select("fact_id", "id", "cosine", "n", "fact", "content")


def _usable(rows: pd.DataFrame, vector: str) -> dict[int, tuple[pd.DataFrame, np.ndarray]]:
    """By length of the vectors: the rows whose vector is near anything, and their vectors."""
    out = {}
    size = rows[vector].map(lambda x: 0 if x is None else len(x))
    for n, part in rows[size > 0].groupby(size[size > 0]):
        vec = np.array([[np.nan if y is None else y for y in x] if x.dtype == object else x for x in map(np.asarray, part[vector])], np.float64)
        fine = np.isfinite(vec).all(1) & (vec != 0).any(1)
        out[n] = part[fine], vec[fine]
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 6 digits as Spark rounds: halves of the shortest decimal form go up."""
    out = np.round(x, 6)
    for i in np.flatnonzero(np.abs(np.abs(x * 1e6) % 1 - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def _best(facts: pd.DataFrame, memories: pd.DataFrame, k: int) -> pd.DataFrame:
    """A tile's k nearest memories of each fact. A product of matrices leaves what is as near as the k-th but for its rounding; those cosines are summed again in the order of the components, as `dot` does. Of memories with one vector the first k are enough."""
    out = [pd.DataFrame({"fact_id": facts["fact_id"][:0], "id": memories["id"][:0], "cosine": np.zeros(0)})]
    known = _usable(memories.sort_values("id"), "v")
    for n, (f, q) in _usable(facts, "q").items():
        if n not in known or not len(f):
            continue
        m, v = known[n]
        if not len(m):
            continue
        same = pd.Series([x.tobytes() for x in v])
        few = (same.groupby(same).cumcount() < k).to_numpy()
        m, v = m[few], v[few]
        length = lambda x: np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])
        a, b = length(q), length(v)
        flat, ids, asked = (v / b[:, None]).T, m["id"].to_numpy(), f["fact_id"].to_numpy()
        for low in range(0, len(q), STRIP):
            near = (q[low : low + STRIP] / a[low : low + STRIP, None]) @ flat
            least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(near), -np.inf)
            i, j = np.nonzero(near >= least[:, None] - 2e-6)
            i += low
            c = np.zeros(len(i))
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                c[at : at + PAIRS] = np.add.accumulate(q[x] * v[y], axis=1)[:, -1] / (b[y] * a[x])
            rows = pd.DataFrame({"fact_id": asked[i], "id": ids[j], "cosine": _rounded(c)}).assign(i=i, j=j).sort_values(["i", "cosine", "j"], ascending=[True, False, True])
            out.append(rows.groupby("i").head(k)[["fact_id", "id", "cosine"]])
    return pd.concat(out)


def consolidate(facts: DataFrame, memories: DataFrame, entails: Callable[[Column, Column], Column], contradicts: Callable[[Column, Column], Column], merge: float = MERGE, ask: float = ASK, sure: float = SURE) -> DataFrame:
    """What becomes of each fact: (fact_id, action, memory_id, similarity). Its nearest memories are asked in order: near enough, or entailing it, is a merge; contradicting it is a conflict; without either it is new."""
    near = nearest(facts, memories)
    c = F.col("cosine")
    what = F.when(c >= merge, "merge").when((c >= ask) & (entails(F.col("content"), F.col("fact")) > sure), "merge").when((c >= ask) & (contradicts(F.col("content"), F.col("fact")) > sure), "conflict")
    first = near.withColumn("action", what).filter("action IS NOT NULL").groupBy("fact_id").agg(F.min_by(F.struct("action", "id", "cosine"), "n").alias("x"))
    out = facts.select("fact_id").join(first, "fact_id", "left")
    return out.select("fact_id", F.coalesce("x.action", F.lit("insert")).alias("action"), F.col("x.id").alias("memory_id"), F.col("x.cosine").alias("similarity"))


def superseded_ancestors(memories: DataFrame, hops: int = 5) -> DataFrame:
    """memories: (id, superseded_by). (id, ancestor, hop): the memories that each one replaced, and those they had replaced, in up to `hops` steps; a ring is walked once."""
    step = memories.filter("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"), F.col("id").alias("ancestor"))
    out = step.withColumn("hop", F.lit(1).cast("long"))
    front = out
    for hop in range(2, hops + 1):
        front = front.select("id", F.col("ancestor").alias("via")).join(step.withColumnRenamed("id", "via"), "via").select("id", "ancestor").filter("id <> ancestor").withColumn("hop", F.lit(hop).cast("long"))
        out = out.unionByName(front)
    return out.groupBy("id", "ancestor").agg(F.min("hop").alias("hop"))


def ping_pong(candidates: DataFrame, memories: DataFrame, hops: int = 5, near: float = MERGE) -> DataFrame:
    """candidates: (fact_id, memory_id, content, embedding), each to replace a memory; memories: (id, content, superseded_by, embedding). Those that restate, in words or with a vector near enough, what the memory, or one before it, already replaced: (fact_id, ancestor, hop), the nearest one. They are refused."""
    up = candidates.select("fact_id", F.col("memory_id").alias("id"), content_hash(F.col("content")).alias("h"), F.col("embedding").alias("v")).join(superseded_ancestors(memories, hops), "id")
    known = up.join(memories.select(F.col("id").alias("ancestor"), content_hash(F.col("content")).alias("known"), F.col("embedding").alias("q")), "ancestor")
    size = norm(F.col("v")) * norm(F.col("q"))
    same = known.filter((F.col("h") == F.col("known")) | F.coalesce((size > 0) & (F.round(dot(F.col("v"), F.col("q")) / size, 6) >= near), F.lit(False)))
    return same.groupBy("fact_id").agg(F.min(F.struct("hop", "ancestor")).alias("x")).select("fact_id", "x.ancestor", "x.hop")


def resolved_conflicts(conflicts: DataFrame, memories: DataFrame) -> DataFrame:
    """conflicts: (memory_id, decision, new_id). What a decision changes in the known memory: `update` replaces it and lowers its stability, `keep_both` lowers it, `noop` nothing: (id, is_active, superseded_by, stability)."""
    c = conflicts.filter(F.col("decision").isin("update", "keep_both"))
    rows = memories.join(c.select(F.col("memory_id").alias("id"), "decision", "new_id"), "id")
    replaced = F.col("decision") == "update"
    return rows.select("id", F.when(replaced, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"), F.when(replaced, F.col("new_id")).alias("superseded_by"), F.round(F.col("stability") * PENALTY, 6).alias("stability"))


def remember(facts: DataFrame, memories: DataFrame, merged: Callable[[Column, Column], Column] | None = None, least: float = MERGE) -> DataFrame:
    """What an explicit remember does with each fact: (fact_id, action, memory_id, content). The nearest memory that is near enough is updated if it says the same or contains it; otherwise the two are merged by `merged` (known, new), or the known one is updated where that gives nothing new; without one the fact is created."""
    near = nearest(facts, memories).filter(F.col("cosine") >= least)
    first = near.groupBy("fact_id").agg(F.min_by(F.struct("id", "content"), "n").alias("x"))
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    rows = facts.select("fact_id", "content").join(first, "fact_id", "left")
    within = F.contains(plain(F.col("x.content")), plain(F.col("content")))
    new = merged(F.col("x.content"), F.col("content")) if merged else F.lit(None).cast("string")
    action = F.when(F.col("x.id").isNull(), "created").when(~within & new.isNotNull() & (new != F.col("x.content")), "merged").otherwise("updated")
    return rows.withColumn("action", action).withColumn("new", new).select("fact_id", "action", F.col("x.id").alias("memory_id"), F.when(F.col("action") == "merged", F.col("new")).otherwise(F.col("content")).alias("content"))


def cleared(suppressions: DataFrame, remembered: DataFrame) -> DataFrame:
    """Suppressions (content_hash, scope) without those of facts (content, scope) that were remembered or restored."""
    said = remembered.select(content_hash(F.col("content")).alias("content_hash"), F.coalesce("scope", F.lit("global")).alias("scope")).distinct()
    return suppressions.join(said, ["content_hash", "scope"], "left_anti")


def edit(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (id, content). (id, outcome, before, after) of each: `edited`, or why it is refused."""
    c = changes.select("id", F.trim("content").alias("after"))
    rows = c.join(memories.select("id", F.col("content").alias("before"), "is_active", "deleted_at"), "id", "left")
    why = F.when(F.col("after") == "", "empty").when(F.col("before").isNull(), "unknown").when(F.col("deleted_at").isNotNull(), "forgotten").when(~F.col("is_active"), "inactive").when(F.col("before") == F.col("after"), "same").otherwise("edited")
    return rows.select("id", why.alias("outcome"), "before", "after")


def restore(memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next state (id, is_active, deleted_at) of memories whose forgetting is undone, and the ids that aren't forgotten."""
    hit = memories.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.filter("deleted_at IS NOT NULL").select("id", F.lit(True).alias("is_active"), F.lit(None).cast("long").alias("deleted_at")), hit.filter("deleted_at IS NULL").select("id")


def of_conversation(memories: DataFrame, exchanges: DataFrame, conversation: str) -> DataFrame:
    """memories: (id, created_at, sources). Those that cite an exchange (id, conversation_id) of a conversation, or the conversation itself, oldest first."""
    cite = memories.select("id", "created_at", F.explode("sources").alias("source"))
    mine = exchanges.filter(F.col("conversation_id").cast("string") == conversation).select(F.col("id").alias("source")).unionByName(exchanges.sparkSession.createDataFrame([(conversation,)], "source string"))
    return cite.join(mine, "source", "left_semi").select("id", "created_at").distinct().orderBy("created_at", "id")


def evidence(text: Column) -> Column:
    """The ids in a JSON array, of which some may be arrays themselves; empty for anything else."""
    parts = F.from_json(text, "array<string>")
    inner = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x)))
    return F.filter(F.flatten(inner), lambda x: x.isNotNull() & (x != ""))


def detach(edges: DataFrame, entities: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that cite forgotten memories, as in `upkeep.detach_evidence`, and their ends (id, mention_count), which are mentioned once less for each such edge, down to 0."""
    from loam.operators.upkeep import detach_evidence

    cut = detach_evidence(edges, gone)
    ends = cut.select(F.col("source").alias("id")).unionByName(cut.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    return cut, entities.join(ends, "id").select("id", F.greatest(F.lit(0).cast("long"), F.col("mention_count") - F.col("n")).alias("mention_count"))
