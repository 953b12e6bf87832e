"""Recall over all sources: graph search, filters, reranking, packing, drilling down and forgetting by a query.

Every list here is bounded by a limit or a pool; rows that lists name are fetched by their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.columns import normalised, visible
from loam.operators.search import bm25_topk, bounded, floored, knn_topk, picked, rrf
from loam.operators.text_index import TextIndex


def _ways(edges: DataFrame, ids: list[str]) -> DataFrame:
    """The edges of a few nodes from their side: (id, other, type, weight, out)."""
    out = edges.filter(F.col("source").isin(ids)).select(F.col("source").alias("id"), F.col("target").alias("other"), "type", "weight", F.lit(True).alias("out"))
    return out.unionByName(edges.filter(F.col("target").isin(ids)).select(F.col("target").alias("id"), F.col("source").alias("other"), "type", "weight", F.lit(False).alias("out")))


def strongest(edges: DataFrame, ids: list[str], shown: int) -> DataFrame:
    """The `shown` strongest edges of each of a few nodes, in order: (id, n, other, type, weight, out)."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "other", "type", "out")
    return _ways(edges, ids).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= shown)


def described(picked_: DataFrame, edges: DataFrame, entities: DataFrame, shown: int = 10) -> DataFrame:
    """A bounded list of entities (id, name, type, ...) with a text of each: its name and type, and its strongest relationships with the names at their other ends."""
    ids = [r["id"] for r in picked_.select("id").collect()]
    top = bounded(strongest(edges, ids, shown))
    names = entities.filter(F.col("id").isin([r["other"] for r in top.select("other").distinct().collect()])).select(F.col("id").alias("other"), "name")
    line = F.concat(F.when(F.col("out"), "-> ").otherwise("<- "), "type", F.lit(" "), F.coalesce("name", "other"))
    rels = top.join(names, "other", "left").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), ", ").alias("rels"))
    head = F.concat("name", F.lit(" ("), "type", F.lit("): No description"))
    return picked_.join(rels, "id", "left").withColumn("content", F.concat(head, F.when(F.col("rels").isNotNull(), F.concat(F.lit("\nRelationships: "), F.col("rels"))).otherwise(""))).drop("rels")


def graph_search(entities: DataFrame, vectors: DataFrame, index: TextIndex, edges: DataFrame, terms: list[str], q: DataFrame, limit: int = 10, scopes: list[str] | None = None) -> DataFrame:
    """Entities by vector and name, fused and normalised over the pool; scopes are applied to the fused list, which is walked until there are enough: (id, name, type, score, content). terms: all words of the query, function words too."""
    pool = max(limit, 10)
    near, text = knn_topk(vectors, q, pool), bm25_topk(index, "", pool, terms=terms)
    fused = bounded(floored(rrf(near.select("id", "rank"), text.select("id", "rank"))).withColumn("score", F.round("score", 6)))
    rows = picked(entities, fused)
    if scopes:
        rows = rows.filter(visible(F.col("scope"), scopes))
    rows = bounded(rows.orderBy(F.desc("score"), "which", "first_rank").limit(limit).select("id", "name", "type", "score"))
    return described(rows, edges, entities)


def reranked(results: DataFrame, scorer: Callable[[Column], Column], first: int = 20, top: int = 5, weight: float = 0.7) -> DataFrame:
    """results: (id, score, content, rank), a bounded list in the order of its ranks, which needn't be that of the scores: graph results follow the fused ones on a scale of their own. The first `first` are scored by a model (a function of the content), min-max normalised and blended with their own scores; the best `top` of them stay, and all after the first."""
    head = results.filter(F.col("rank") <= first).withColumn("s", scorer(F.col("content")))
    w = Window.partitionBy(F.lit(0))
    low, high, n = F.min("s").over(w), F.max("s").over(w), F.count("*").over(w)
    s = F.when(n == 1, 1.0).when(high == low, 0.5).otherwise((F.col("s") - low) / (high - low))
    best = head.withColumn("score", F.round(weight * s + (1 - weight) * F.col("score"), 5)).orderBy(F.desc("score"), "rank").limit(top)
    return best.select("id", "score").unionByName(results.filter(F.col("rank") > first).select("id", F.round("score", 5).alias("score")))


def appended(fused: DataFrame, graph: DataFrame) -> DataFrame:
    """Graph results after the fused list, on their own scale: (id, source, score, token_estimate)."""
    tail = graph.select("id", F.lit("graph").alias("source"), F.round("score", 6).alias("score"), F.ceil(F.length("content") / 4 * 1.1).alias("token_estimate"))
    return fused.select("id", "source", "score", "token_estimate").unionByName(tail)


def drill_exchange(exchanges: DataFrame, ident: str, reach: int = 5) -> DataFrame:
    """An exchange and those within `reach` of it in its conversation: (position, exchange_index, content); nothing for an unknown id."""
    one = exchanges.filter(F.col("id") == ident).select("conversation_id", F.col("exchange_index").alias("at"))
    near = exchanges.join(F.broadcast(one), "conversation_id").filter(F.col("exchange_index").between(F.col("at") - reach, F.col("at") + reach))
    where = F.when(F.col("exchange_index") < F.col("at"), "before").when(F.col("exchange_index") > F.col("at"), "after").otherwise("content")
    return near.select(where.alias("position"), "exchange_index", F.concat(F.lit("User: "), "user_message", F.lit("\n\nAssistant: "), "assistant_message").alias("content"))


def drill_memory(memories: DataFrame, exchanges: DataFrame, ident: int) -> DataFrame:
    """memories: (id, content, context, is_active, deleted_at, sources). Its text with the context, and the exchanges it cites in their order: (position, n, content). A forgotten or inactive memory gives its state instead."""
    one = memories.filter(F.col("id") == ident)
    state = F.when(F.col("deleted_at").isNotNull(), "forgotten").when(~F.col("is_active"), "inactive").otherwise("content")
    text = F.when(state != "content", F.lit("")).when(F.coalesce("context", F.lit("")) != "", F.concat("content", F.lit("\n\nContext: "), "context")).otherwise(F.col("content"))
    cited = one.filter("is_active AND deleted_at IS NULL").select(F.explode("sources").alias("id"))
    src = exchanges.join(F.broadcast(cited), "id").select(F.lit("source").alias("position"), F.row_number().over(Window.orderBy("exchange_index", "id")).cast("long").alias("n"), F.concat(F.lit("User: "), "user_message", F.lit("\n\nAssistant: "), "assistant_message").alias("content"))
    return one.select(state.alias("position"), F.lit(0).cast("long").alias("n"), text.alias("content")).unionByName(src)


def drill_entity(entities: DataFrame, edges: DataFrame, ident: str) -> DataFrame:
    """The entities related to one, each once, by its strongest edge: (n, other, name, type, relation, weight)."""
    ways = _ways(edges, [ident]).groupBy("other").agg(F.max_by(F.struct("type", "weight"), F.struct("weight", "type")).alias("e"))
    rows = ways.join(entities.select(F.col("id").alias("other"), "name", "type"), "other")
    return rows.select(F.row_number().over(Window.orderBy(F.desc("e.weight"), "other")).cast("long").alias("n"), "other", "name", "type", F.col("e.type").alias("relation"), F.col("e.weight").alias("weight"))


def forget_match(candidates: DataFrame, query: str) -> DataFrame:
    """candidates: (id, content), a bounded list. The one memory that a query to forget means: the only candidate, or the only one that says just what the query says; no row if it is ambiguous."""
    wanted = normalised(F.lit(query))
    c = candidates.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("_same", normalised(F.col("content")) == wanted)
    c = c.withColumn("_exact", F.count_if("_same").over(Window.partitionBy(F.lit(0))))
    return c.filter((F.col("_n") == 1) | ((F.col("_exact") == 1) & F.col("_same"))).select("id")
