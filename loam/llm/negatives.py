"""Hard-negative mining by Strassen multiplication over tiles of anchors and candidates.

Components become integers, floor(`SCALE` * x), so every score is exact. Anchors and rows are dealt to blocks of a bounded number, and a task goes through tiles (a block of anchors with a block of rows), each once. A tile's scores come from Strassen's recursion on int64 matrices: odd sides are padded with a line of zeros, quadrants are combined by exact integer additions, and seven products stand for eight until a side is at most `LEAF`. Two passes follow each other, as the windows need the positives' scores. First, tiles of one label: every anchor keeps a heap of its `positives` best rows. Then, tiles of all rows: for each positive a heap of the `negatives` best rows of other labels in the window from `low` to `high` hundredths of the positive's score. Heaps are merged from tile to tile inside a task, and only heaps leave it, whatever the number of rows; Spark merges those of different tasks by a ranked window.

Hot labels are dealt to as many blocks as they need, and nothing is broadcast by hint. The work is anchors times rows, by the definition of the search; the shuffle carries every row once for each block of anchors and every anchor once for each block of rows.

Defined results: rows take no part if their id or label is null, or their vector is null, empty or holds null or non-finite components; vectors meet only those of their own length. Rows that repeat an id are rows of their own, but none is a positive or negative of an anchor with its id; repeated anchors each get their results. Ties go to the smaller id. An anchor without a positive, and a positive with an empty window, give no rows; nor does an empty table. Components so large that 100 times a score may not fit into 64 bits are refused by an error. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import ARROW, arrow, release, spill

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
ANCHORS, CANDIDATES, LEAF = 1024, 2048, 8
MOST = 2.0**56  # of a vector's squared length: then 100 times a score fits
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices. Sums may wrap around on the way; the result is exact if it fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1, m2, m3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    m4, m5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    m6, m7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = m1 + m4 - m5 + m7, m3 + m5
    out[i:, :l], out[i:, l:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """Any number of heaps that each hold the `k` best of what they have seen: highest score first, then smallest id."""

    def __init__(self, shape: tuple[int, ...], k: int):
        self.score, self.id = np.full((*shape, k), NONE), np.full((*shape, k), np.iinfo(np.int64).max)

    def merge(self, score: np.ndarray, ident: np.ndarray) -> None:
        k = self.score.shape[-1]
        score, ident = np.concatenate([self.score, score], -1), np.concatenate([self.id, ident], -1)
        best = np.lexsort((ident, ~score), axis=-1)[..., :k]  # ~x falls as x rises, and never overflows
        self.score, self.id = np.take_along_axis(score, best, -1), np.take_along_axis(ident, best, -1)


def usable(rows: DataFrame, vec_id: Column, label: Column, embedding: Column, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, dim, q) of the rows that take part, each with a number of its own."""
    x = lambda v: v.cast("double")
    out = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), embedding.alias("_v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(_v) > 0")
    out = out.filter(F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf"))))
    q = F.transform("_v", lambda v: F.floor(scale * x(v)))
    size = F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.pow(F.abs(scale * x(v)) + 1, F.lit(2.0)))
    checked = F.when(size < MOST, q).otherwise(F.raise_error(F.lit("negatives: components too large for exact scores")))
    return out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("_v").alias("dim"), checked.alias("q"))


def tiles(anchors: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and anchors dealt so that each anchor meets each row with equal `by` in one tile (i, j): the number of an anchor's block and that of a row's, by hashes of their row numbers. side: 0 for anchors."""
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count("*") / ANCHORS).alias("_na")).join(rows.groupBy(*by).agg(F.ceil(F.count("*") / CANDIDATES).alias("_nc")), by)
    mine = lambda n: F.pmod(F.xxhash64("row", F.lit(23)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = anchors.join(blocks, by).withColumn("i", mine("_na")).withColumn("j", every("_nc")).withColumn("side", F.lit(0))
    c = rows.join(blocks, by).withColumn("j", mine("_nc")).withColumn("i", every("_na")).withColumn("side", F.lit(1))
    both = a.unionByName(c, allowMissingColumns=True).drop("_na", "_nc")
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionByRange(n, *by, "i", "j").sortWithinPartitions(*by, "i", "j", "side", "row")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal keys of a sorted partition, one at a time."""
    held, key = [], None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if b.num_rows else []
        for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
            if lo < hi:
                now = tuple(int(c[lo]) for c in cols)
                if held and now != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    n = int((t.column("side").to_numpy() == 0).sum())
    return t.slice(0, n), t.slice(n)


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in t.column("q").chunks]).reshape(-1, dim)


def _in_tasks(tiled: DataFrame, by: list[str], seen, told, schema: str) -> DataFrame:
    """Go through the tiles of each task: seen(heaps or None, anchors, rows, scores) gives the heaps of the anchors' block with the tile merged in, told(heaps, anchors) the columns of what they hold once the block is over."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches):
        block, heaps, held = None, None, None
        out = lambda cols: pa.RecordBatch.from_arrays([pa.array(x, ARROW[t]) for x, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])
        for key, t in _runs(batches, [*by, "i", "j"]):
            a, c = _sides(t)
            if not a.num_rows or not c.num_rows:
                continue
            if block is not None and key[:-1] != block:
                yield out(told(heaps, held))
                heaps = None
            block, held = key[:-1], a  # each tile of a block has the same anchors, in the same order
            dim = key[0]
            heaps = seen(heaps, a, c, strassen(_matrix(a, dim), np.ascontiguousarray(_matrix(c, dim).T)))
        if heaps is not None:
            yield out(told(heaps, held))

    return arrow(tiled, run, schema)


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all tasks merged: rank n up to k by score and id."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k)


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchors, rows: (row, vec_id, label, dim, q). (row, id, score, n): each anchor's best k rows of its label."""

    def seen(heaps, a, c, scores):
        heaps = heaps or Heaps((a.num_rows,), k)
        mine, theirs = a.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        scores = np.where(mine[:, None] == theirs[None], NONE, scores)
        ids = np.where(scores == NONE, np.iinfo(np.int64).max, np.broadcast_to(theirs, scores.shape))
        if scores.shape[1] > 4 * k:  # what can't be among the k best by its score alone is left out of the sort
            least = np.partition(scores, -k, axis=1)[:, -k]
            near = scores >= least[:, None]
            width = int(near.sum(1).max())
            order = np.argsort(~near, axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(np.where(near, scores, NONE), order, 1), np.take_along_axis(np.where(near, ids, np.iinfo(np.int64).max), order, 1)
        heaps.merge(scores, ids)
        return heaps

    def told(heaps, a):
        at, n = np.nonzero(heaps.score != NONE)
        return a.column("row").to_numpy()[at], heaps.id[at, n], heaps.score[at, n]

    by = ["dim", "label"]
    cols = ["row", "vec_id", *by, "q"]
    found = _in_tasks(tiles(anchors.select(cols), rows.select(cols), by), by, seen, told, "row long, id long, score long")
    return _best(found, ["row"], k)


def windows(anchors: DataFrame, rows: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchors: (row, vec_id, label, dim, q, pos_id, pos_score), the last two arrays of positives, best first. (row, anchor_id, slot, positive_id, positive_score, id, score, n): for each positive the best k rows of another label with low * positive <= 100 * score <= high * positive."""

    def lists(a):
        n = a.column("pos_id").combine_chunks().value_lengths().to_numpy()
        slots = np.arange(int(n.max()))
        ids, scores = np.zeros((len(n), len(slots)), np.int64), np.full((len(n), len(slots)), NONE)
        filled = slots[None] < n[:, None]
        ids[filled], scores[filled] = (np.concatenate([c.flatten().to_numpy() for c in a.column(x).chunks]) for x in ("pos_id", "pos_score"))
        return ids, scores, filled

    def seen(heaps, a, c, scores):
        _, pos, filled = lists(a)
        heaps = heaps or Heaps(pos.shape, k)
        top, bottom = np.where(filled, pos, 0).max(1), np.where(filled, pos, np.iinfo(np.int64).max).min(1)
        fits = (100 * scores <= high * top[:, None]) & (100 * scores >= low * bottom[:, None])
        fits &= (a.column("label").to_numpy()[:, None] != c.column("label").to_numpy()[None]) & (a.column("vec_id").to_numpy()[:, None] != c.column("vec_id").to_numpy()[None])
        at, which = np.nonzero(fits)
        if not len(at):
            return heaps
        s, ids = scores[at, which], c.column("vec_id").to_numpy()[which]
        order = np.lexsort((ids, ~s, at))
        at, s, ids = at[order], s[order], ids[order]
        first = np.searchsorted(at, np.arange(len(a) + 1))
        # An anchor's rows fall by score, so a window starts after those above it, and its best k follow.
        above = np.stack([np.bincount(at[100 * s > high * pos[at, slot]], minlength=len(a)) for slot in range(pos.shape[1])], 1)
        start = first[:-1, None] + above
        take = start[:, :, None] + np.arange(k)
        ok = (take < first[1:, None, None]) & filled[:, :, None]
        take = np.where(ok, take, 0)
        ok &= 100 * s[take] >= low * np.where(filled, pos, 0)[:, :, None]
        heaps.merge(np.where(ok, s[take], NONE), np.where(ok, ids[take], np.iinfo(np.int64).max))
        return heaps

    def told(heaps, a):
        ids, pos, _ = lists(a)
        at, slot, n = np.nonzero(heaps.score != NONE)
        return a.column("row").to_numpy()[at], a.column("vec_id").to_numpy()[at], slot, ids[at, slot], pos[at, slot], heaps.id[at, slot, n], heaps.score[at, slot, n]

    by = ["dim"]
    cols = ["row", "vec_id", "label", *by, "q"]
    found = _in_tasks(tiles(anchors.select(*cols, "pos_id", "pos_score"), rows.select(cols), by), by, seen, told, "row long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long")
    return _best(found, ["row", "slot"], k)


def mine(embeddings: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """anchor: which rows are anchors, a condition on `vec_id`; label: a row's label (the column of that name). (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = spill(usable(embeddings, F.col(id_col), F.col("label") if label is None else label, F.col(vector_col)), "rows")
    some = rows.filter(anchor)
    found = positives(some, rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("p"))  # a few for each anchor
    known = spill(some.join(found, "row").select("row", "vec_id", "label", "dim", "q", F.col("p.id").alias("pos_id"), F.col("p.score").alias("pos_score")), "anchors")
    out = spill(windows(known, rows), "windows")
    release(rows, known)
    return out.select("anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
