"""Embedding near-duplicates by a pivot-permutation index.

The reference points (pivots) are a bounded sample of the vectors, thinned so that no two of them are alike: then near vectors agree on their nearest pivots, also where the vectors lie dense. Every vector is described by its `DESCRIBED` nearest pivots in order, and stands in the inverted lists of the first `FRONT` of them. Two vectors of a list are candidates if they share at least `SHARED` pivots of their descriptions; each candidate pair is verified once, in the list of the smallest pivot that is in front for both, by its exact cosine in double precision. Equal vectors are one class, known by a digest. Long lists are split into tiles of blocks, so that no task holds a whole list; only counts and spanning links leave a tile, never all pairs.

`recall` measures the index against brute force. The sample is at most `MOST_PIVOTS` vectors whatever the input, so lists grow with the input divided by that; raise it for more vectors than about a thousand times as many.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do rows with a null id; vectors of different lengths never link; rows that repeat an id and vector link with each other, and rows that repeat an id with another vector are each linked by their own; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import column, labels, linked_classes, map_batches, map_runs, release, spill, tiled

DESCRIBED, FRONT, SHARED = 8, 3, 2
MOST_PIVOTS, APART, TILE = 4096, 0.8, 256


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one. The scale is taken out first, so that huge and tiny components neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(v: list | None) -> np.ndarray | None:
    """The vector, or None where it links with nothing. Negative zeros become zeros, so that equal vectors have equal bytes."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def pivots(rows: DataFrame, most: int = MOST_PIVOTS, apart: float = APART) -> dict[int, np.ndarray]:
    """For each length of vectors, unit vectors of which no two have a cosine of `apart` or more: the first, by a hash of the row, of a sample of at most `most` rows."""
    got: dict[int, list[np.ndarray]] = {}
    for r in rows.select("embedding").orderBy(F.xxhash64("vec_id", "embedding")).limit(most).collect():
        if (x := usable(r["embedding"])) is not None:
            got.setdefault(len(x), []).append(x)
    out = {}
    for d, x in got.items():
        u = unit(np.array(x))
        left, kept = np.ones(len(u), bool), []
        for i in range(len(u)):
            if left[i]:
                kept.append(i)
                left &= u @ u[i] < apart
        out[d] = u[kept].astype(np.float32)
    return out


def describe(rows: DataFrame, points: dict[int, np.ndarray], described: int, narrow: bool) -> DataFrame:
    """(vec_id, node, dim, near, vector): the digest of the vector, its length, its nearest pivots in order, and its components as they came (`narrow`: 32 bits each). Null where the vector links with nothing."""
    kind = np.dtype("<f4" if narrow else "<f8")

    def run(b):
        got = [usable(v) if i is not None else None for i, v in zip(column(b, "vec_id").to_pylist(), column(b, "embedding").to_pylist(), strict=True)]
        near: list[bytes | None] = [None] * len(got)
        dims = np.array([0 if x is None else len(x) for x in got])
        for d in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == d)
            p = points.get(int(d), np.zeros((1, d), np.float32))  # lengths that the sample missed share one list
            sim = unit(np.array([got[i] for i in at])).astype(np.float32) @ p.T
            k = min(described, len(p))
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1).astype("<i4")
            for i, x in zip(at, top, strict=True):
                near[i] = x.tobytes()
        raw = [None if x is None else x.astype(kind).tobytes() for x in got]
        return {
            "vec_id": column(b, "vec_id"), "node": [None if x is None else xxhash.xxh3_128_digest(x) for x in raw], "dim": [int(d) or None for d in dims], "near": near, "vector": raw,
            "front": [[] if x is None else np.frombuffer(x, "<i4")[:FRONT].tolist() for x in near],
        }

    return map_batches(rows, run, "vec_id long, node binary, dim long, near binary, vector binary, front array<long>", 2000)


def _verified(threshold: float, shared: int, kind: str):
    def run(key: list, t: pa.Table) -> dict | None:
        if t.num_rows < 2:
            return None
        pivot = int(key[1])
        ids, weight, block = t.column("node").to_pylist(), t.column("size").to_numpy(), t.column("mine").to_numpy()
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), "<i4").reshape(len(ids), -1)
        points, col = np.unique(near, return_inverse=True)
        has = np.zeros((len(ids), len(points)), np.float32)
        has[np.arange(len(ids))[:, None], col.reshape(near.shape)] = 1
        ok = has @ has.T >= min(shared, near.shape[1])
        front = np.zeros_like(has)
        front[np.arange(len(ids))[:, None], col.reshape(near.shape)[:, :FRONT]] = 1
        before = front[:, points < pivot]
        ok &= before @ before.T == 0
        np.fill_diagonal(ok, False)
        if key[2] != key[3]:
            ok &= block[:, None] != block[None, :]
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return None
        u = unit(np.frombuffer(b"".join(t.column("vector").take(pa.array(some)).to_pylist()), kind).reshape(len(some), -1).astype(np.float64))
        ok[np.ix_(some, some)] &= u @ u.T >= threshold
        root, links = labels(ok), ok @ weight
        i = np.flatnonzero(links > 0)
        return {"node": [ids[x] for x in i], "links": links[i].astype(np.int64), "root": [ids[x] for x in root[i]]} if len(i) else None

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, described: int = DESCRIBED, shared: int = SHARED) -> DataFrame:
    """Per vector: vec_id, class_id, n_links, component_id, kept."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    narrow = rows.schema["embedding"].dataType.elementType.typeName() == "float"
    seen = spill(describe(rows, pivots(rows), described, narrow), "vectors")
    each = seen.filter("node IS NOT NULL").groupBy("node", "vec_id").agg(F.count("*").alias("n"))
    classes = spill(each.groupBy("node").agg(F.min("vec_id").alias("class_id"), F.sum("n").alias("size"), F.min_by("n", "vec_id").alias("same")), "classes")
    # A class is searched once: by its row with the smallest id, or one of the rows that repeat it.
    shared_classes = classes.filter("size > 1")
    marked = seen.filter("node IS NOT NULL").select("node", "vec_id", "dim", "near", "vector", "front").join(shared_classes, "node", "left")
    once = marked.filter("class_id IS NULL OR (class_id = vec_id AND same = 1)").unionByName(marked.filter("class_id = vec_id AND same > 1").dropDuplicates(["node"]))
    entry = once.select(F.explode("front").alias("pivot"), "node", "dim", F.coalesce("size", F.lit(1)).cast("long").alias("size"), "near", "vector")
    lists = spill(entry.groupBy("dim", "pivot").agg(F.count("*").alias("n")).filter("n > 1").select("dim", "pivot", F.ceil(F.col("n") / TILE).alias("blocks")), "lists")
    tiles = tiled(entry.join(lists, ["dim", "pivot"]), ["dim", "pivot"], "blocks", "node")
    links = spill(map_runs(tiles, ["dim", "pivot", "i", "j"], _verified(threshold, shared, "<f4" if narrow else "<f8"), "node binary, links long, root binary", 1 << 20), "links")
    return linked_classes(seen.select("vec_id", "node"), classes.select("node", "class_id", "size"), links, ["node"]).drop("node", "component")


def recall(rows: DataFrame, threshold: float = 0.95, **args) -> float:
    """Links found against a brute-force count, for tables that fit into the driver."""
    found = sum(r[0] for r in near_duplicates(rows, threshold=threshold, **args).select("n_links").collect())
    got = [x for r in rows.select("embedding").collect() if (x := usable(r[0])) is not None]
    u = unit(np.array(got))
    true = int((u @ u.T >= threshold).sum()) - len(u)
    return found / true if true else 1.0
