"""Hybrid retrieval: BM25 and vector top-k, rank fusion, rescoring and budgets.

Texts are found through a written index (`text_index`), so a query doesn't read them. Top-k lists are bounded by their limits: they are collected where several later steps need them, and the rows they name are fetched by their ids, which reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import fixed
from loam.functions.columns import dot, norm, retrieval_score, retrievability, stability, visible
from loam.operators.text_index import TextIndex, bm25


def rank(df: DataFrame, *order) -> DataFrame:
    """1-based ranks over a bounded list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def bounded(df: DataFrame) -> DataFrame:
    """A top-k list, computed once: its rows are held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def picked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows that a bounded list names, by an IN that the scan gets; with the list's other columns."""
    known = [r[0] for r in ids.select(key).collect()]
    return rows.filter(F.col(key).isin(known)).join(F.broadcast(ids), key)


def bm25_topk(index: TextIndex, query: str, k: int, within: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """(id, bm25, rank), best first."""
    best = bm25(index, query, within, terms=terms).withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "id").limit(k)
    return rank(best, F.desc("bm25"), "id")


def knn(vectors: DataFrame, query: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """vectors with their cosine to the one query vector (query: one row, column q); 0 where a norm is 0."""
    both = vectors.join(F.broadcast(query.select("q")))
    size = norm(F.col(vector)) * norm(F.col("q"))
    return both.withColumn("cosine", F.when(size > 0, dot(F.col(vector), F.col("q")) / size).otherwise(F.lit(0.0))).drop("q", vector)


def knn_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "id") -> DataFrame:
    return rank(knn(vectors, query, key).withColumn("cosine", F.round("cosine", 6)).orderBy(F.desc("cosine"), key).limit(k), F.desc("cosine"), key)


def rrf(*lists: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Lists (id, rank) fused: (id, score); equal scores stay in the order of the lists."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("id", "rank", F.lit(i).alias("which"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("which", "rank")).alias("first"))
    return fused.select("id", "score", F.col("first.which").alias("which"), F.col("first.rank").alias("first_rank"))


def floored(df: DataFrame, col: str = "score", floor: float = 0.1) -> DataFrame:
    """Min-max over the bounded list, from the floor to 1; one row gets 0.85, equal scores 0.5."""
    w = Window.partitionBy(F.lit(0))
    low, high, n = F.min(col).over(w), F.max(col).over(w), F.count("*").over(w)
    return df.withColumn(col, F.when(n == 1, F.lit(0.85)).when(high == low, F.lit(0.5)).otherwise(floor + (1 - floor) * (F.col(col) - low) / (high - low)))


def pack_budget(results: DataFrame, budget: int) -> DataFrame:
    """Results (id, source, score, token_estimate), a bounded list, packed greedily by boosted score: what doesn't fit is skipped, and smaller ones may follow."""
    boost = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in fixed.BOOSTS.items()], F.lit(1.0))
    order = Window.orderBy(F.desc("boosted"), "id")
    ranked = results.withColumn("boosted", F.round(F.col("score") * boost, 6)).withColumn("n", F.row_number().over(order))
    items = ranked.agg(F.array_sort(F.collect_list(F.struct("n", "id", "source", "token_estimate", "boosted"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s, x):
        fits = s["used"] + x["token_estimate"] <= budget
        return F.struct(F.when(fits, s["used"] + x["token_estimate"]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, F.array_append(s["kept"], x["n"])).otherwise(s["kept"]).alias("kept"))

    kept = items.select(F.filter("items", lambda x: F.lit(True)).alias("items"), F.aggregate("items", start, step)["kept"].alias("kept"))
    return kept.select(F.explode(F.filter("items", lambda x: F.array_contains(F.col("kept"), x["n"]))).alias("x")).select("x.id", "x.source", "x.token_estimate", F.col("x.boosted").alias("boosted"))


def semantic(memories: DataFrame, vectors: DataFrame, index: TextIndex, query: str, q: DataFrame, now: int, limit: int = 10, kinds: list[str] | None = None, scopes: list[str] | None = None) -> DataFrame:
    """Memories by fused ranks, then retrieval score, normalised over all candidates before the limit. The vector list ranks everything indexed, the text list active memories only; inactive ones, other kinds and scopes drop out after the fusion. index: of the memories' content and context."""
    pool = max(limit, 20)
    wanted = F.col("is_active")
    if kinds:
        wanted = wanted & F.col("type").isin(*kinds)
    if scopes:
        wanted = wanted & visible(F.col("scope"), scopes)
    indexed = vectors.join(memories.filter(wanted if kinds or scopes else F.lit(True)).select("id"), "id", "left_semi")
    near = knn_topk(indexed, q, pool)
    text = bm25_topk(index, query, pool, memories.filter(wanted).select("id"))
    fused = bounded(rrf(near.select("id", "rank"), text.select("id", "rank")))
    rows = picked(memories, fused).filter(wanted)
    r = retrievability(now, F.col("last_accessed"), F.col("created_at"), stability(F.col("type"), F.col("stability")))
    out = floored(rows.withColumn("score", F.round(retrieval_score(F.col("score"), r, F.col("importance")), 9)))
    return out.select("id", "type", F.round("score", 6).alias("score"), (F.ceil(F.length("content") / 4) + 10).alias("token_estimate")).orderBy(F.desc("score"), "id").limit(limit)


def episodic(exchanges: DataFrame, vectors: DataFrame, index: TextIndex, query: str, q: DataFrame, mode: str = "hybrid", limit: int = 10, where=None) -> DataFrame:
    """Exchanges by vector, text or both; scores are normalised over the whole pool. `where` (a condition on the exchanges, such as scope and dates) holds before the lists are cut. index: of both messages."""
    pool = max(limit, 20)
    within = exchanges.filter(where).select("id") if where is not None else None
    lists = []
    if mode in ("vector", "hybrid"):
        lists.append(knn_topk(vectors if within is None else vectors.join(within, "id", "left_semi"), q, pool).select("id", "rank"))
    if mode in ("text", "hybrid"):
        lists.append(bm25_topk(index, query, pool, within).select("id", "rank"))
    best = floored(bounded(rrf(*lists))).select("id", F.round("score", 6).alias("score"), "which", "first_rank").orderBy(F.desc("score"), "which", "first_rank").limit(limit)
    return exchanges.join(F.broadcast(best.select("id", "score")), "id").select("id", "conversation_id", "score", "token_estimate", F.trim(F.regexp_replace(F.substring("user_message", 1, 200), r"\s+", " ")).alias("snippet"))


def multi_source(episodes: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """Two result lists (id, score, token_estimate), fused by their ranks; a memory wins over an exchange with its id."""
    e, m = (bounded(rank(x.withColumn("id", F.col("id").cast("string")), F.desc("score"), "id").select("id", "rank", "token_estimate")) for x in (episodes, memories))
    best = floored(rrf(e.select("id", "rank"), m.select("id", "rank")))
    names = m.select("id", F.lit("semantic").alias("source"), "token_estimate").unionByName(e.join(m.select("id"), "id", "left_anti").select("id", F.lit("episodic").alias("source"), "token_estimate"))
    return best.join(names, "id").select("id", "source", F.round("score", 6).alias("score"), "token_estimate").orderBy(F.desc("score"), "source", "id").limit(2 * limit)
