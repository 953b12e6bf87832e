"""Facts that say nearly the same become one, in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.ordered import WINDOW, placed, tiles, unit
from loam.sources.scratch import save, ship

MERGE = 0.95
HITS = "batch long, n long, key long, confidence double, importance double"
FOLDED = "batch long, pos long, n long, key long, rep boolean"


def collapse_near(facts: DataFrame, least: float = MERGE, window: int = WINDOW) -> DataFrame:
    """facts: (batch, pos, confidence, importance, embedding). Inside each batch, in the order of pos, a fact joins the first survivor whose vector is near enough, or survives; a survivor's vector is that of its best member so far, by confidence, then importance, the earlier of equals. (batch, pos, survivor, rep): the place of the fact it became part of, and whether it was that one's best member when it came.

    Batches of at most `window` facts take one round; a larger one goes on by windows, each of which first meets the survivors so far in tiles."""
    rows = placed(facts.select("batch", "pos", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("importance"), "embedding"), ["batch"], ["pos"])
    ship(rows.sparkSession)
    longest = rows.agg(F.max("n")).first()[0]
    done, survivors = None, None

    def near(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame(columns=["batch", "n", "key", "confidence", "importance"])
        both = unit([*asked["embedding"], *known["embedding"]])
        i, j = np.nonzero(both[: len(asked)] @ both[len(asked) :].T >= least)
        k = known.iloc[j]
        return pd.DataFrame({"batch": k["batch"].to_numpy(), "n": asked["n"].to_numpy()[i], "key": k["key"].to_numpy(), "confidence": k["confidence"].to_numpy(), "importance": k["importance"].to_numpy()})

    def fold(part: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        vec = unit(list(part["embedding"]))
        old: dict[int, list] = {}
        for n, key, *rank in zip(hits["n"], hits["key"], hits["confidence"], hits["importance"]):
            old.setdefault(n, []).append((key, tuple(rank)))
        best: dict[int, tuple] = {}  # of survivors that are new or have a new best member: its rank
        place: dict[int, int] = {}  # and the row of its vector in `held`
        keys, held, out = np.zeros(len(part), np.int64), np.zeros_like(vec), []
        for i, (n, c, m) in enumerate(zip(part["n"], part["confidence"], part["importance"])):
            known = [x for x in old.get(n, ()) if x[0] not in best]
            known += [(int(k), best[int(k)]) for k in keys[: len(place)][held[: len(place)] @ vec[i] >= least]]
            key, rank = min(known, default=(n, None))
            rep = rank is None or (c, m) > rank
            if rep:
                best[key] = (c, m)
                at = place.setdefault(key, len(place))
                keys[at], held[at] = key, vec[i]
            out.append((part["batch"].iloc[0], part["pos"].iloc[i], n, key, rep))
        return pd.DataFrame(out, columns=["batch", "pos", "n", "key", "rep"])

    for low in range(0, 0 if longest is None else longest + 1, window):
        part = rows.filter(F.col("n").between(low, low + window - 1))
        hits = tiles(part.select("batch", "n", "embedding"), survivors, ["batch"], near, HITS) if survivors is not None else rows.sparkSession.createDataFrame([], HITS)
        folded = save(part.groupBy("batch").cogroup(hits.groupBy("batch")).applyInPandas(fold, FOLDED))
        done = folded if done is None else done.unionByName(folded)
        if low + window <= longest:
            latest = folded.filter("rep").groupBy("batch", "key").agg(F.max("n").alias("n"))
            fresh = part.join(latest, ["batch", "n"]).select("batch", "key", "confidence", "importance", "embedding")
            survivors = save(fresh if survivors is None else survivors.join(latest.select("batch", "key"), ["batch", "key"], "left_anti").unionByName(fresh))
    if done is None:
        return facts.select("batch", "pos", F.col("pos").alias("survivor"), F.lit(True).alias("rep")).limit(0)
    first = done.filter("n = key").select("batch", "key", F.col("pos").alias("survivor"))
    return save(done.join(first, ["batch", "key"]).select("batch", "pos", "survivor", "rep"))


def merged(facts: DataFrame, into: DataFrame) -> DataFrame:
    """facts: (batch, pos, content, confidence, importance, context, sources), into: what `collapse_near` gives. The facts that are left, in the place of the first of them: the wording of the best member, all sources in order, each once, and the context of the latest best member that has one, or else the first that any has."""
    rows = facts.join(into, ["batch", "pos"])
    rank = F.struct("confidence", "importance", -F.col("pos"))
    known = F.col("context").isNotNull()
    best = rows.groupBy("batch", "survivor").agg(
        F.max_by(F.struct("content", "confidence", "importance"), rank).alias("w"), F.count("*").alias("n_merged"),
        F.max_by(F.when(known & F.col("rep"), F.col("context")), F.when(known & F.col("rep"), F.col("pos"))).alias("own"), F.min_by(F.when(known, F.col("context")), F.when(known, F.col("pos"))).alias("any"),
    )
    said = rows.select("batch", "survivor", "pos", F.posexplode("sources").alias("k", "source")).groupBy("batch", "survivor", "source").agg(F.min(F.struct("pos", "k")).alias("o"))
    said = said.groupBy("batch", "survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]).alias("sources"))
    out = best.join(said, ["batch", "survivor"], "left")
    return out.select("batch", F.col("survivor").alias("pos"), "w.content", "w.confidence", "w.importance", F.coalesce("own", "any").alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "n_merged")
