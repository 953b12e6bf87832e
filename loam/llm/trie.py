"""The prefix trie of conversations, built by a van Emde Boas recursion.

A trie over sequences of up to D turns is cut at half its depth: the prefixes that reach the cut get names, which are the leaves of the upper trie and the roots of the lower forests; both halves are cut in the same way, and all pieces of one size are worked on together, so that log2(D) rounds do what a walk along the turns would do in D. No task holds a conversation or a node's members.

* Digests of aligned blocks of 1, 2, 4, ... turns are made bottom-up, each from the two halves of the next smaller size.
* Names go top-down: the prefix at a cut is named by the name of its piece's root and the digest of the block between them. A round has half as many prefixes as the next, so all rounds together are about twice the last.
* Members, smallest members, words, parents and ends are aggregates over the named prefixes, with a partial aggregate before the shuffle where a node is hot.
* Totals of subtrees are grafted bottom-up: once all pieces of a size know the totals inside themselves, each cut node adds its own to the nodes between it and its piece's root, which are the prefixes of its smallest member; a long way is dealt to tasks in stretches of `STRETCH` depths.
* A node's ends are hashed in the order of their ids: ranges of sorted ids become pieces of text of up to `PIECE` ids, and a node's pieces go through one digest in a stream.

Places of turns come from one sort by ranges: a row's place is its number in its partition's part of the conversation, plus the rows of the parts before; so a conversation of any length is spread over tasks.

Defined results: rows with a null conv_id don't count; null roles and texts are empty; turns follow their number, null first, and equal numbers by role, then by the MD5 of the text, so repeated rows are turns that follow each other; equal 128-bit hashes count as equal content; an empty table gives an empty result; only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import arrow, map_runs, release, spill, spread

WORD = r"[^\x20\x09-\x0D]+"
FIRST_OF, MOST_SHARED = 20, 4  # conversations of one block of ids share a beginning of fewer than so many turns
STRETCH, PIECE = 10, 4096  # 2**STRETCH depths; ids
ROOT = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def placed(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, t1, t2, words), a written table: content as two hashes, place from 0. And the parts (conv, length) of the conversations."""
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("m"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "m"]
    # The number grows along the sorted partitions: its upper bits are the partition's.
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = spill(rows.select("conv", "at", F.shiftright("at", 33).alias("part"), F.xxhash64("role", "m").alias("t1"), F.xxhash64(F.lit("second"), "m", "role").alias("t2"), "words"), "sorted")
    parts = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv")  # a row for each partition that holds some of the conversation
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = spill(parts.select("conv", "part", "first", before.alias("before"), F.sum("n").over(w).alias("length")), "parts")
    turns = spill(rows.join(parts.drop("length"), ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "t1", "t2", "words"), "placed")
    lengths = spill(parts.groupBy("conv").agg(F.max("length").alias("length")), "lengths")
    release(rows, parts)
    return turns, lengths


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns come from the first of their block of ids, where h is a hash of the id: turns (conv, d, t1, t2, words) and (conv, length), both written."""
    c = lengths.withColumn("h", F.crc32(F.col("conv").cast("string")) % MOST_SHARED).withColumn("base", F.col("conv") - F.col("conv") % FIRST_OF)
    base = lengths.select(F.col("conv").alias("base"), F.col("length").alias("has"))
    c = spill(c.join(base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("k"), "length"), "blocks")
    heads = turns.filter(F.col("pos") < MOST_SHARED - 1).withColumnRenamed("conv", "base")
    taken = c.select("conv", "base", "h").join(heads, "base").filter("pos < h").select("conv", F.col("pos").alias("d"), "t1", "t2", "words")
    # Only where the first of the block has fewer than h turns does a place depend on another conversation; a long one meets that number in stretches.
    h = F.crc32(F.col("conv").cast("string")) % MOST_SHARED
    own = turns.filter(F.col("pos") >= h).withColumn("stretch", F.shiftright("pos", STRETCH))
    short = c.filter("k < h").select("conv", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("length", STRETCH))).alias("stretch"))
    own = own.join(short, ["conv", "stretch"], "left").select("conv", (F.col("pos") - h + F.coalesce("k", h)).alias("d"), "t1", "t2", "words")
    out = spill(taken.unionByName(own), "rebuilt")
    sizes = spill(c.select("conv", (F.col("k") + F.greatest(F.lit(0), F.col("length") - F.col("h"))).alias("length")), "sizes")
    release(c)
    return out, sizes


def _name(n1: str, n2: str, b1: str, b2: str) -> list[Column]:
    return [F.xxhash64(n1, b1, n2, b2).alias("n1"), F.xxhash64(F.lit("second"), n2, b2, n1, b1).alias("n2")]


def named(turns: DataFrame, sizes: DataFrame, levels: int) -> DataFrame:
    """(conv, d, length, n1, n2): a name for the first d turns of every conversation, d from 0 to its length."""
    blocks = [turns.select("conv", F.col("d").alias("j"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))]
    for _ in range(1, levels):
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.struct("b1", "b2")))
        two = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(half(0).alias("l"), half(1).alias("r")).filter("l IS NOT NULL AND r IS NOT NULL")
        made = two.select("conv", "j", F.xxhash64("l.b1", "r.b1", "l.b2", "r.b2").alias("b1"), F.xxhash64(F.lit("second"), "l.b2", "r.b2", "l.b1", "r.b1").alias("b2"))
        blocks.append(spill(made, "blocks"))
    names = spill(sizes.select("conv", F.lit(0).cast("long").alias("d"), "length", F.lit(ROOT[0]).alias("n1"), F.lit(ROOT[1]).alias("n2")), "names")
    for level in reversed(range(levels)):
        cut = names.join(blocks[level].select("conv", F.shiftleft("j", level).alias("d"), "b1", "b2"), ["conv", "d"])
        more = spill(names.unionByName(cut.select("conv", (F.col("d") + (1 << level)).alias("d"), "length", *_name("n1", "n2", "b1", "b2"))), "names")
        release(names)
        names = more
    release(*blocks[1:])
    return names


def grafted(prefixes: DataFrame, totals: DataFrame, levels: int) -> DataFrame:
    """prefixes: (conv, d, length, n1, n2), totals: (n1, n2, conv_id, depth, n_leaves, saved_tokens) of the nodes alone. The totals of their subtrees."""
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    for level in range(levels):
        half, stretch = 1 << level, min(level, STRETCH)
        cut = totals.filter(F.col("depth") % (2 * half) == half)
        way = F.sequence(F.shiftright(F.col("depth") - half, stretch), F.shiftright(F.col("depth") - 1, stretch))
        cut = cut.select(F.col("conv_id").alias("conv"), F.explode(way).alias("at"), "n_leaves", "saved_tokens")
        piece = F.shiftright("d", level)
        above = prefixes.filter((piece % 2 == 0) & (F.col("length") >= F.shiftleft(piece + 1, level))).select("conv", F.shiftright("d", stretch).alias("at"), "n1", "n2")
        gained = above.join(cut, ["conv", "at"]).groupBy("n1", "n2").agg(*sums).select("n1", "n2", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), "n_leaves", "saved_tokens")
        more = spill(totals.unionByName(gained).groupBy("n1", "n2").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums), "totals")
        release(totals)
        totals = more
    return totals


def ends(prefixes: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of the nodes where conversations end."""
    last = prefixes.filter("d = length").select("n1", "n2", "conv")

    def piece(key, t: pa.Table):
        ids = t.column("conv").to_pylist()
        return {"n1": [int(key[0])], "n2": [int(key[1])], "at": [ids[0]], "ids": [",".join(map(str, ids))]}

    pieces = map_runs(spread(last, "n1", "n2", "conv", last="conv"), ["n1", "n2"], piece, "n1 long, n2 long, at long, ids string", PIECE)
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches):
        key, h = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], names=["n1", "n2", "ends_sha256"])
        for b in batches:
            done: list[tuple] = []
            for n1, n2, ids in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n1", "n2", "ids")), strict=True):
                if (n1, n2) != key:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = (n1, n2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["n1", "n2", "ends_sha256"])
        if key is not None:
            yield one()

    return arrow(pieces.repartition(n, "n1", "n2").sortWithinPartitions("n1", "n2", "at"), digest, "n1 long, n2 long, ends_sha256 string")


def build(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """turns: (conv, d, t1, t2, words), sizes: (conv, length), written tables. Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    deepest = sizes.agg(F.max("length")).first()[0]
    levels = int(np.ceil(np.log2((deepest or 0) + 1)))
    names = named(turns, sizes, levels)
    none = F.lit(None).cast("long")
    own = names.select("conv", "d", "length", "n1", "n2", none.alias("p1"), none.alias("p2"), none.alias("words"))
    parent = names.filter("d < length").select("conv", (F.col("d") + 1).alias("d"), none.alias("length"), none.alias("n1"), none.alias("n2"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), none.alias("words"))
    said = turns.select("conv", (F.col("d") + 1).alias("d"), *[none.alias(c) for c in ("length", "n1", "n2", "p1", "p2")], "words")
    prefixes = own.unionByName(parent).unionByName(said).groupBy("conv", "d").agg(*[F.max(c).alias(c) for c in ("length", "n1", "n2", "p1", "p2", "words")])
    prefixes = spill(prefixes, "prefixes")
    nodes = prefixes.groupBy("n1", "n2").agg(F.min("conv").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "words")])
    nodes = spill(nodes, "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    known = spill(nodes.join(kids, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    saved = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))
    alone = known.select("n1", "n2", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    totals = grafted(prefixes, spill(alone, "alone"), levels)
    ended = spill(ends(prefixes), "ends")
    release(names, prefixes, nodes)
    # Children of a hot node are many rows of one key; the join's other side has one, so the engine can split them.
    up = known.filter("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop("depth").join(totals.select("n1", "n2", "depth", "n_leaves", "saved_tokens"), ["n1", "n2"]).join(ended, ["n1", "n2"], "left").join(up, ["p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, lengths = placed(conversations, **columns)
    made, sizes = rebuilt(turns, lengths)
    release(turns, lengths)
    out = spill(build(made, sizes), "trie")
    release(made, sizes)
    return out
