"""Ordered folds over groups of any size, a window at a time.

Where each row's fate depends on what became of the rows before it, a fold can't be split; but only the rows of a window need to meet in one task, once everything older has met them in tiles spread over all tasks. So a round takes the next `window` rows of every group: memory is bounded by the window, small groups need one round, and the search through what is there already, which is most of the work, is distributed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.scratch import save, ship

WINDOW, TILE = 4096, 1024


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with their place n in their group, from 0, written. A group is numbered across the partitions of one sort by ranges, so no task holds it; rows with equal order follow each other in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the partition, in the order of the sort
    parts = dealt.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "_part", "_first", before.alias("_before"))
    out = dealt.withColumn("_part", part).join(parts, [*by, "_part"]).withColumn("n", F.col("_at") - F.col("_first") + F.col("_before"))
    return save(out.drop("_at", "_part", "_first", "_before"))


def unit(vectors: list) -> np.ndarray:
    """Rows of length 1; zero vectors, null ones and those with null or non-finite parts stay 0 and are near nothing."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = np.array([np.nan if x is None else x for x in v], np.float64)
    out[~np.isfinite(out).all(1)] = 0.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def tiles(asked: DataFrame, known: DataFrame, by: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tile: int = TILE) -> DataFrame:
    """fn(asked, known) over every tile: all asked rows of a group, at most a window, with at most about `tile` of its known rows, dealt by a hash of their `key`."""
    ship(asked.sparkSession)
    known = known.join(asked.select(*by).distinct(), by, "left_semi")
    blocks = known.groupBy(*by).agg(F.ceil(F.count("*") / tile).alias("_blocks"))
    left = asked.join(blocks, by).withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    right = known.join(blocks, by).withColumn("_tile", F.pmod(F.xxhash64("key"), F.col("_blocks"))).drop("_blocks")
    return left.groupBy(*by, "_tile").cogroup(right.groupBy(*by, "_tile")).applyInPandas(fn, schema)
