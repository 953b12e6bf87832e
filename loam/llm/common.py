"""What the operators of this subpackage share."""

from __future__ import annotations

import functools
import pickle
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "float": pa.float32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session whose driver is its only machine gets a folder of its own; any other is refused."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return set_dir or f"file://{_own_dir()}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: workers elsewhere have no path to it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        out = Path(tempfile.mkdtemp(prefix="spark-")) / "loam.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "loam").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)


def arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. A lost executor loses none of it."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}/{tag}", spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the written table replaces the shuffle files it came from
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete spilled tables that nothing still to be computed reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 500) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; fn returns the columns named in schema (`name type, ...`), or None."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := fn(b.slice(at, rows))) is not None:
                    yield pa.RecordBatch.from_arrays([v if isinstance(v := out[n], (pa.Array, pa.ChunkedArray)) else pa.array(v, ARROW[t]) for n, t in fields], names=[n for n, _ in fields])

    return arrow(df, run, schema)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[list, pa.Table], dict | None], schema: str, block: int, overlap: int = 0) -> DataFrame:
    """Go through sorted partitions and call fn with each run of equal keys, in blocks of at most `block` rows that share `overlap` rows. Memory holds one block and one batch, whatever a run's length."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        key, fresh = None, False  # fresh: held has rows that fn hasn't seen

        def call():
            out = fn(key, held)
            if out is not None:
                yield pa.RecordBatch.from_arrays([v if isinstance(v := out[n], pa.Array) else pa.array(v, ARROW[t]) for n, t in fields], names=[n for n, _ in fields])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                now = [c[lo] for c in cols]
                if key is not None and now != key and fresh:
                    yield from call()
                if now != key:
                    held, key = None, now
                at = lo
                while at < hi:
                    room = block - (held.num_rows if held is not None else 0)
                    part = t.slice(at, min(room, hi - at))
                    held = part if held is None else pa.concat_tables([held, part])
                    at += part.num_rows
                    fresh = True
                    if held.num_rows >= block:
                        yield from call()
                        held = held.slice(held.num_rows - overlap) if overlap else None
                        fresh = False
        if key is not None and fresh:
            yield from call()

    return arrow(df, run, schema)


def in_one_task(rows: DataFrame, fn: Callable[[list[dict]], object]) -> object:
    """fn over all rows of a table of bounded size, in a task of its own, which spares the driver their memory; its result comes back pickled. None for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [r for b in batches for r in b.to_pylist()]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fn(held))], pa.binary())], names=["made"])

    made = arrow(rows.repartition(1), run, "made binary").collect()
    return pickle.loads(made[0]["made"]) if made else None


def texts(b: pa.RecordBatch, col: str = "text") -> list[str]:
    """The column's values, null as the empty string."""
    return [x or "" for x in b.column(b.schema.get_field_index(col)).to_pylist()]


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, component), where component is the smallest node reached. Nodes are of any type that has an order.

    Alternates large-star and small-star steps until the edges stay the same (by their number and two sums of 40 bits of their hashes); the steps needed grow with the logarithm of the longest path, and running out of `rounds` is an error. Each step's minima come from a partial aggregate and are written, so that the join after it can split a hot node.
    """
    edges = spill(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def star(sym: DataFrame, keep: str, tag: str) -> DataFrame:
        low = spill(sym.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "low")
        out = sym.filter(keep).join(low, "a")
        out = spill(out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), tag)
        release(low)
        return out

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), *[F.sum(F.xxhash64(*ends) % F.lit(1 << 40)) for ends in (("a", "b"), ("b", "a"))]).first())

    was = state(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "b > a", "large")
        release(edges)
        edges = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "b < a", "small")
        release(large)
        if (now := state(edges)) == was:
            break
        was = now
    else:
        raise RuntimeError(f"components: edges still change after {rounds} rounds")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
    out = spill(out.distinct(), "components")
    release(edges)
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Remembers the 64-bit hashes of up to `most` words; others are hashed anew each time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes of every n consecutive values, modulo 2**64, finalised."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    b, m = np.uint64(base), len(h) - n + 1
    g = h[:m].copy()
    for j in range(1, n):
        g *= b
        g += h[j : m + j]
    return mix(g)


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values, in about log2(n) passes."""
    have = 1
    while have < n:
        step = min(have, n - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


def labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest row index that each row reaches."""
    n = len(linked)
    now = np.arange(n)
    while True:
        new = np.minimum(now, np.where(linked, now[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == now).all():
            return now
        now = new


def tiled(rows: DataFrame, groups: list[str], blocks: str, node: str) -> DataFrame:
    """Deal the rows of every group to tiles (i, j) so that any two rows of a group meet in one: a group has as many blocks as its column `blocks` says, a row's block (`mine`) is by a hash of the node, and a row goes to every tile of its block. Tiles are spread by range, and follow each other sorted in a partition."""
    nb = F.greatest(F.lit(1).cast("long"), F.col(blocks).cast("long"))
    mine = rows.withColumn("_nb", nb).withColumn("mine", F.pmod(F.xxhash64(node, F.lit(17)), F.col("_nb")))
    out = mine.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    out = out.withColumn("i", F.least("mine", "_other")).withColumn("j", F.greatest("mine", "_other")).drop("_other", "_nb", blocks)
    return spread(out, *groups, "i", "j", last=node)


def spread(rows: DataFrame, *keys: str, last: str) -> DataFrame:
    """Partitioned by ranges of the keys and sorted inside."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, last)


def linked_classes(members: DataFrame, classes: DataFrame, links: DataFrame, digest: list[str]) -> DataFrame:
    """members: (id, ..., digest), classes: (node, digest, class_id, size), links: (node, links, root) per class and tile, a written table. Classes are told apart by the digest of their content, so that rows which share an id but not the content stay apart; node is the digest or a number for it.

    Each member with class_id (smallest id of its class), n_links, component (a node of its linked classes), component_id (smallest id of those) and kept. Members without a digest link with nothing."""
    count = spill(links.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    comp = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    first = comp.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    comp = spill(comp.join(first, "component"), "named")
    noted = spill(classes.join(count, "node", "left").join(comp, "node", "left").select(
        *digest, "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "class_id").alias("component_id")), "classes")
    ident = members.columns[0]
    out = members.join(noted, digest, "left")
    return out.select(
        *members.columns, F.coalesce("class_id", ident).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component", F.coalesce("component_id", ident).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(ident) == F.col("component_id"), F.lit(True)))


def content_keys(text: str = "text") -> list:
    """Two 64-bit hashes of a text, which tell rows apart that share an id."""
    return [F.xxhash64(text).alias("_loam_t1"), F.xxhash64(F.lit("second"), F.col(text)).alias("_loam_t2")]
