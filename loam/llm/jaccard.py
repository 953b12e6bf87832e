"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Shingles are runs of five words (a text of one to four words is one shingle). Documents with equal shingle sets are one class, known by the digest of the set. Every class has a MinHash signature of 150 values; tree t of the forest goes by the values from 5t on, so the trees are independent down to the shortest prefix used. Two classes are candidates if they share a prefix in some tree.

The prefix is shortened adaptively. At the full depth of 12 values the sorted trie brings near copies together at the cost of a sort: neighbours in blocks of the run are compared by their signatures. Then the prefix is as short as the target recall asks for (5 values at a similarity of 0.8 and 0.99999 with 30 trees). There, what the deep prefixes have linked already isn't compared again: a prefix whose classes are all in one family is done, and in a prefix of more than `BLOCK` classes those of its largest family meet only the others. All other classes of a prefix are compared, in tiles of two blocks where there are many, so that memory holds one tile and no pair is left out; only spanning links leave a tile.

Candidates form families (connected components of pairs whose signatures agree in an estimated 0.6 or more). All pairs of a family are verified exactly, in tiles of blocks that hold a bounded number of classes and shingles; only counts and spanning links leave a tile, never all pairs. `recall` measures the forest against brute force.

Defined results: null and empty texts, and rows with a null id, link with nothing; rows with equal shingle sets link with each other, also when they repeat one id; rows that repeat an id with another text are each linked by their own; a text of any length is taken whole; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import column, components, content_keys, hashed, labels, linked_classes, map_batches, map_runs, mix, release, rolling, spill, spread, texts, tiled

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.99999
VALUES, TREES, DEPTH, STRIDE, DEEP_TREES = 150, 30, 12, 5, 8
BLOCK, TILE, TILE_SHINGLES = 512, 256, 1 << 21


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees with the target recall."""
    k = DEPTH
    while k > 1 and 1 - (1 - threshold**k) ** TREES < recall:
        k -= 1
    return k


def shingles(text: str, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct hashes of the runs of n words; of all words, if there are fewer."""
    h = hashed(text.encode("utf-8", "replace").split())
    return np.unique(rolling(h, min(n, len(h)), 0x9E3779B97F4A7C15 + 2 * min(n, len(h)))) if len(h) else h


@functools.cache
def _functions() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, (2, VALUES), dtype=np.uint32) | np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over the shingles."""
    a, b = _functions()
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        low, high = (s[at : at + 2048] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s[at : at + 2048] >> np.uint64(32)).astype(np.uint32)
        t = a[:, None] * low[None, :]
        t += b[:, None] * high[None, :]
        t ^= t >> np.uint32(15)
        t *= np.uint32(0x2C1B3C6D)
        np.minimum(out, t.min(1), out=out)
    return out


def trie_keys(sig: np.ndarray, k: int, trees: int = TREES) -> np.ndarray:
    """For each tree, a hash of the first k values (with the tree's number)."""
    at = (STRIDE * np.arange(trees)[:, None] + np.arange(k)[None, :]) % VALUES
    v = sig[at].astype(np.uint64)
    key = np.arange(1, trees + 1, dtype=np.uint64)
    for j in range(k):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
    return key.view(np.int64)


def describe(docs: DataFrame, k: int, n: int = NGRAM) -> DataFrame:
    """docs: (doc_id, text, _loam_t1, _loam_t2). (doc_id, _loam_t1, _loam_t2, d1, d2, n_shingles, keys, deep, sketch): the class's digest, the trees' keys at the shortest and at the full depth, and a byte of each signature value."""

    def run(b):
        rows = []
        for i, t in zip(column(b, "doc_id").to_pylist(), texts(b), strict=True):
            s = shingles(t, n) if i is not None else np.zeros(0, np.uint64)
            if not len(s):
                rows.append((None, None, 0, [], [], b""))
                continue
            d, sig = xxhash.xxh3_128_digest(s.tobytes()), signature(s)
            rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(s), trie_keys(sig, k), trie_keys(sig, DEPTH, DEEP_TREES), mix(sig.astype(np.uint64)).astype(np.uint8).tobytes()))
        return {c: column(b, c) for c in ("doc_id", "_loam_t1", "_loam_t2")} | dict(zip(("d1", "d2", "n_shingles", "keys", "deep", "sketch"), map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs, run, "doc_id long, _loam_t1 long, _loam_t2 long, d1 long, d2 long, n_shingles long, keys array<long>, deep array<long>, sketch binary")


def _matrix(t: pa.Table, name: str, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype).reshape(-1, width)


def _family_links(least: int):
    """Spanning links of the rows of a run; in a tile of two blocks, only those between the blocks."""

    def run(key: list, t: pa.Table) -> dict | None:
        n = t.num_rows
        s = _matrix(t, "sketch", np.uint8, VALUES)
        if len(key) > 1 and key[1] != key[2]:
            mine = t.column("mine").to_numpy()
            left, right = np.flatnonzero(mine == key[1]), np.flatnonzero(mine == key[2])
        else:
            left = right = np.arange(n)
        if n < 2 or not len(left) or not len(right):
            return None
        near, other = np.zeros((n, n), bool), s[right]
        for at in range(0, len(left), 64):
            now = left[at : at + 64]
            near[np.ix_(now, right)] = (s[now, None, :] == other[None]).sum(2, dtype=np.int16) >= least
        root = labels(near | near.T)
        ids = t.column("node").to_pylist()
        i = np.flatnonzero(root != np.arange(n))
        return {"a": [ids[x] for x in i], "b": [ids[x] for x in root[i]]} if len(i) else None

    return run


def _verified(threshold: float):
    def run(key: list, t: pa.Table) -> dict | None:
        if t.num_rows < 2:
            return None
        ids, weight, block = t.column("node").to_pylist(), t.column("size").to_numpy(), t.column("mine").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        flat, n = np.concatenate(sets), np.array([len(x) for x in sets])
        u, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often > 1)
        place = np.full(len(u), -1)
        place[shared] = np.arange(len(shared))
        col, row = place[at], np.repeat(np.arange(len(sets)), n)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        for low in range(0, len(shared), 8192):  # bounded memory, whatever the texts' length
            lo, hi = np.searchsorted(col, (low, low + 8192))
            m = np.zeros((len(sets), min(8192, len(shared) - low)), np.float32)
            m[row[lo:hi], col[lo:hi] - low] = 1
            both += m @ m.T
        both = both.astype(np.float64)
        linked = both / (n[:, None] + n[None, :] - both) >= threshold
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return None
        root, links = labels(linked), linked @ weight
        i = np.flatnonzero(links > 0)
        return {"node": [ids[x] for x in i], "links": links[i].astype(np.int64), "root": [ids[x] for x in root[i]]}

    return run


def _met(reps: DataFrame, keys: str) -> DataFrame:
    """(k, node) of the prefixes that more than one class has."""
    entry = reps.select("node", F.explode(keys).alias("k"))
    shared = spill(entry.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "prefixes")
    return entry.join(shared, "k")


def families(reps: DataFrame, threshold: float, slack: float = 0.2) -> DataFrame:
    """reps: (node, keys, deep, sketch). (node, component) of the classes whose signatures bring them together with others; a signature may fall short of the threshold by `slack`, over five standard deviations."""
    compare = _family_links(math.ceil(VALUES * ((threshold - slack) * 255 / 256 + 1 / 256)))
    sketches = reps.select("node", "sketch")
    trie = spill(_met(reps, "deep").join(sketches, "node"), "trie")
    near = spill(map_runs(spread(trie, "k", "node", last="node"), ["k"], compare, "a long, b long", BLOCK, 1), "near")
    release(trie)
    linked = components(near).withColumnRenamed("component", "family")
    met = spill(_met(reps, "keys").join(linked, "node", "left").withColumn("family", F.coalesce("family", "node")), "met")
    per = met.groupBy("k", "family").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.max_by("family", "n").alias("main"), F.max("n").alias("m"))
    open_ = spill(per.filter("m < n").withColumn("m", F.expr(f"CASE WHEN n > {BLOCK} AND m > {BLOCK} THEN m ELSE 0 END")), "open")
    rows = spill(met.join(open_, "k").join(sketches, "node"), "compared")
    release(met)
    small = spread(rows.filter(F.col("n") <= BLOCK).select("k", "node", "sketch"), "k", last="node")
    # Blocks of a large prefix: first those of the classes outside its main family, which meet all blocks, then those of the main family, which meet the first.
    in_main = (F.col("m") > 0) & (F.col("family") == F.col("main"))
    large = rows.filter(F.col("n") > BLOCK).withColumn("rest", F.ceil((F.col("n") - F.col("m")) / BLOCK)).withColumn("all", F.col("rest") + F.ceil(F.col("m") / BLOCK)).withColumn("_main", in_main)
    h = F.xxhash64("node", F.lit(17))
    large = large.withColumn("mine", F.when(F.col("_main"), F.col("rest") + F.pmod(h, F.col("all") - F.col("rest"))).otherwise(F.pmod(h, F.col("rest"))))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_main"), F.col("rest")).otherwise(F.col("all")) - 1)))
    large = spread(large.select("k", F.least("mine", "_other").alias("i"), F.greatest("mine", "_other").alias("j"), "mine", "node", "sketch"), "k", "i", "j", last="node")
    links = map_runs(small, ["k"], compare, "a long, b long", 1 << 20).unionByName(map_runs(large, ["k", "i", "j"], compare, "a long, b long", 1 << 20))
    links = spill(links.unionByName(near), "candidates")
    release(rows, near)
    out = components(links)
    release(links)
    return out


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """docs: (doc_id, text). (doc_id, _loam_t1, _loam_t2, class_id, n_links, component, component_id, kept) of every row; component is null where a row has no words or no id."""
    docs = docs.select("doc_id", "text", *content_keys())
    seen = spill(describe(docs, prefix_length(threshold, recall), n), "signatures")
    one = seen.filter("d1 IS NOT NULL").groupBy("d1", "d2", "doc_id", "_loam_t1").agg(F.count("*").alias("same"))
    classes = one.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.sum("same").alias("size"))
    classes = spill(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers that stay, once written
    # A class is described by its row with the smallest id, or one of those where the id repeats.
    first = one.join(classes, ["d1", "d2"]).filter("doc_id = class_id").groupBy("node", "class_id", "size", "d1", "d2").agg(F.min("_loam_t1").alias("_loam_t1"), F.max("same").alias("same"), F.count("*").alias("texts"))
    first = spill(first.select("node", F.col("class_id").alias("doc_id"), "size", "d1", "d2", "_loam_t1", (F.col("same") * F.col("texts") > 1).alias("repeats")), "firsts")
    wide = seen.join(first.drop("d1", "d2"), ["doc_id", "_loam_t1"]).select("node", "repeats", "n_shingles", "keys", "deep", "sketch")
    reps = spill(wide.filter("NOT repeats").unionByName(wide.filter("repeats").dropDuplicates(["node"])).drop("repeats"), "representatives")
    ids = spill(seen.select("doc_id", "_loam_t1", "_loam_t2", "d1", "d2"), "documents")
    release(seen)
    family = families(reps, threshold)
    sizes = family.join(reps.select("node", "n_shingles"), "node").groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_SHINGLES)).alias("blocks"))
    members = spill(family.join(spill(sizes, "sizes"), "component").join(first.select("node", "doc_id", "size", "_loam_t1", "repeats"), "node"), "members")
    release(reps)

    def gather(b):
        return {c: column(b, c) for c in ("node", "component", "blocks", "size", "repeats")} | {"shingles": [shingles(t, n).tobytes() for t in texts(b)]}

    # Families grow with the texts, so the join is by a shuffle at every size.
    wide = map_batches(docs.select("doc_id", "_loam_t1", "text").join(members.hint("merge"), ["doc_id", "_loam_t1"]), gather, "node long, component long, blocks long, size long, repeats boolean, shingles binary", 200)
    sets = spill(wide, "shingles")
    release(members, first, family)
    wide = sets.filter("NOT repeats").unionByName(sets.filter("repeats").dropDuplicates(["node"])).drop("repeats")
    links = spill(map_runs(tiled(wide, ["component"], "blocks", "node"), ["component", "i", "j"], _verified(threshold), "node long, links long, root long", 1 << 20), "links")
    release(sets)
    out = linked_classes(ids, classes, links, ["d1", "d2"]).drop("d1", "d2")
    out.made_of = (ids, classes, links)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, class_id (smallest id with the same shingles), n_links (other documents at the threshold or above), component_id (smallest id reached by links), kept (whether that is its own)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _linked(docs, n, threshold, recall).select("doc_id", "class_id", "n_links", "component_id", "kept")


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of documents (doc_id, text, ...) without near-duplicates: of every group of linked rows the one with the smallest id stays, a single row also where rows repeat that id. Rows without an id or words all stay."""
    linked = _linked(docs.select("doc_id", "text"), n, threshold, recall)
    rows = spill(linked.filter("component IS NOT NULL").select("doc_id", "_loam_t1", "_loam_t2", "component"), "linked")
    release(*linked.made_of)
    on = ["doc_id", "_loam_t1", "_loam_t2"]
    key = F.struct(*on)
    groups = rows.groupBy("component").agg(F.min(key).alias("stays"), F.count("*").alias("n")).filter("n > 1")
    gone = spill(rows.join(groups, "component").filter(key != F.col("stays")).select(*on).distinct(), "gone")
    again = spill(rows.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    release(rows)
    # What goes grows with the documents, so the join is by a shuffle at every size.
    left = docs.select("*", *content_keys()).join(gone.hint("merge"), on, "left_anti")
    if not again.isEmpty():
        left = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(on))
    return left.select(docs.columns)


def recall(docs: DataFrame, threshold: float = THRESHOLD, **args) -> float:
    """Links found against a brute-force count, for tables that fit into the driver."""
    found = sum(r[0] for r in join(docs, threshold=threshold, **args).select("n_links").collect())
    sets = [s for r in docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("text").collect() if len(s := shingles(r[0]))]
    where: dict[int, list[int]] = {}
    true = 0
    for i, s in enumerate(sets):
        shared = np.bincount(np.array([j for x in s.tolist() for j in where.get(x, ())], np.int64), minlength=i + 1)[:i]
        size = np.array([len(x) for x in sets[:i]])
        true += 2 * int((shared / (size + len(s) - shared) >= threshold).sum()) if i else 0
        for x in s.tolist():
            where.setdefault(x, []).append(i)
    return found / true if true else 1.0
