"""A stored full-text index: sorted postings in segments under a manifest.

A segment holds the postings (term, id, tf, uses, dl, at) of the rows of one insert, sorted by term and id over files, so that a frequent term is spread over several files and a query opens only the files whose range of terms it needs; the row's length lies in each posting, so that scores need no other table, and so do the term's places, by which phrases are found. An index may hold stems in place of words; every distinct word is stemmed once. A delete writes the ids as a tombstone for all segments before it; an upsert does both. A version of the index is one small manifest file, created once, that names segments and tombstones; readers keep the version they opened, and of two writers that start from one version the second fails. Merging rewrites what is left into one segment. A query restricted to some rows counts statistics and document frequencies among those rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.columns import query_phrases, words
from loam.functions.stem import stem
from loam.sources.files import create, delete, names, read
from loam.sources.scratch import dealt, folder, save, ship

MOST_SEGMENTS = 8  # an insert that makes more merges them
FORMAT = 2  # of what is stored; an index of another format isn't opened
COLUMN = 40  # bits of a place inside its column
POSTING = ["term", "id", "tf", "uses", "dl", "at"]
LETTERS, CUT = 12_000_000, 1_000_000  # of texts whose postings make a file, and words of rows that are counted together
MET, ASKED = 1_000_000, 1 << 16  # postings and rows asked for that meet in a task
SAMPLE, ROWS = 500_000, 5_000_000  # words by which the files' ranges are chosen, and rows whose lengths make a file


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    weights: dict[str, float]
    id_type: str
    stemmed: bool = False
    version: int = 0
    segments: list[dict] = field(default_factory=list)  # name, number, files: (file, first term, last term)
    tombstones: list[dict] = field(default_factory=list)  # name, number: of rows in segments with smaller numbers
    rows: int = 0  # indexed rows, those without words too
    words: int = 0  # of all rows

    @property
    def length(self) -> float:
        """The average number of words of a row."""
        return self.words / self.rows if self.rows else 0.0

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex | None:
        """The latest version at a path, without reading anything but its manifest; None if there is none."""
        found = sorted(n for n in names(spark, path) if n.startswith("manifest-"))
        state = json.loads(read(spark, f"{path}/{found[-1]}")) if found else {}
        return TextIndex(spark, path, **state) if state.pop("format", None) == FORMAT else None

    def _commit(self, **changes) -> TextIndex:
        state = {k: getattr(self, k) for k in ("weights", "id_type", "stemmed", "segments", "tombstones", "rows", "words")} | changes | {"version": self.version + 1}
        create(self.spark, f"{self.path}/manifest-{state['version']:012d}.json", json.dumps(state | {"format": FORMAT}))
        return TextIndex(self.spark, self.path, **state)

    def _read(self, segment: dict, files: list[str]) -> DataFrame:
        schema = f"term string, id {self.id_type}, tf double, uses bigint, dl bigint, at array<bigint>"
        table = self.spark.read.schema(schema).parquet(*[f"{self.path}/{segment['name']}/postings/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)
        return self._alive(table, segment["number"])

    def _alive(self, rows: DataFrame, number: int) -> DataFrame:
        gone = [f"{self.path}/{t['name']}" for t in self.tombstones if t["number"] > number]
        return rows.join(self.spark.read.schema(f"id {self.id_type}").parquet(*gone), "id", "left_anti") if gone else rows

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, uses, dl, at) of the terms, from the files that may hold them."""
        out = None
        for s in self.segments:
            files = [f for f, low, high in s["files"] if any(low <= t <= high for t in terms)]
            if files:
                one = self._read(s, files).filter(F.col("term").isin(*terms))
                out = one if out is None else out.unionByName(one)
        return self._read({"name": "", "number": 0}, []) if out is None else out

    def table(self) -> DataFrame:
        """All postings."""
        out = self._read({"name": "", "number": 0}, [])
        for s in self.segments:
            out = out.unionByName(self._read(s, [f for f, *_ in s["files"]]))
        return out

    def lengths(self) -> DataFrame:
        """(id, dl) of all rows, 0 for those without words."""
        schema = f"id {self.id_type}, dl bigint"
        out = self.spark.createDataFrame([], schema)
        for s in self.segments:
            out = out.unionByName(self._alive(self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}/rows"), s["number"]))
        return out

    def _number(self) -> int:
        return 1 + max((x["number"] for x in self.segments + self.tombstones), default=0)

    def _written(self, docs: DataFrame, number: int) -> tuple[dict, int, int]:
        """A segment of new rows, their number and that of their words. A row's words are counted where it lies, and dealt there to the ranges of the files, so texts are cut once and only postings are shuffled, once, to files whose number grows with the texts. The rows' lengths come from the same pass, in files of their own."""
        cores = self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:  # a file of one row group: its words are cut by all cores
            docs = docs.repartition(cores)
        n, letters = docs.agg(F.count("*"), sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in self.weights), F.lit(0))).first()
        name, files = f"segment-{uuid.uuid4().hex}", 1 + letters // LETTERS
        cut = docs.select("id", *[F.coalesce(words(F.col(c)), F.array().cast("array<string>")).alias(c) for c in self.weights])
        if files > 1 and not self.stemmed:
            ranges, more = _ranges(cut, self.weights, files, n, letters // 6), 1 + n // ROWS
            segment, lengths = self._stored(name, _counted(cut, self.weights, self.id_type, ranges, range(files, files + more)), number, files + more)
            return segment, *self._with_rows(name, self.spark.read.schema(f"id {self.id_type}, dl bigint").parquet(*lengths))
        terms = _counted(cut, self.weights, self.id_type)
        segment, _ = self._stored(name, (_stemmed(terms) if self.stemmed else terms).select(POSTING), number, files)
        return segment, *self._with_rows(name, cut.select("id", sum((F.size(c) for c in self.weights), F.lit(0)).cast("long").alias("dl")))

    def _stored(self, name: str, postings: DataFrame, number: int, files: int) -> tuple[dict, list[str]]:
        """A segment of postings, and the files of those without a term, which it doesn't name."""
        at = f"{self.path}/{name}/postings"
        if "part" in postings.columns:
            parts = postings.repartitionById(files, "part").drop("part")
        else:
            number_of = [files] if files > 1 else []  # what may be one file is left to Spark
            parts = postings.repartitionByRange(*number_of, "term", "id")
        parts.sortWithinPartitions("term", "id").write.parquet(at)
        rows = self.spark.read.schema("term string").parquet(at).select("term", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
        last = {r["file"]: r["i"] for r in rows.groupBy("file").agg(F.max("i").alias("i")).collect()}  # a row for each file
        ends: dict[str, list[str]] = {}
        known = self.spark.createDataFrame(list(last.items()), "file string, last long")
        found = rows.filter(F.col("i").isin(0, *last.values())).join(F.broadcast(known), "file").filter("i = 0 OR i = last").collect()
        for r in sorted(found, key=lambda r: (r["file"], r["i"])):
            ends.setdefault(r["file"], []).append(r["term"])
        named = sorted([[f, e[0], e[-1]] for f, e in ends.items() if e[0] is not None], key=lambda x: x[1])
        return {"name": name, "number": number, "files": named}, [f"{at}/{f}" for f, e in ends.items() if e[0] is None]

    def _with_rows(self, name: str, rows: DataFrame) -> tuple[int, int]:
        at = f"{self.path}/{name}/rows"
        rows.write.parquet(at)
        return tuple(self.spark.read.schema(f"id {self.id_type}, dl bigint").parquet(at).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def insert(self, docs: DataFrame) -> TextIndex:
        """docs: (id, text columns), ids that the index hasn't; the next version."""
        segment, n, total = self._written(docs, self._number())
        out = self._commit(segments=[*self.segments, segment], rows=self.rows + n, words=self.words + total)
        return out.merge() if len(out.segments) > MOST_SEGMENTS else out

    def _buried(self, ids: DataFrame) -> tuple[dict, int, int]:
        name, number = f"tombstone-{uuid.uuid4().hex}", self._number()
        ids.select(F.col("id").cast(self.id_type)).distinct().write.parquet(f"{self.path}/{name}")
        gone = self.lengths().join(self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.path}/{name}"), "id", "left_semi")
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": name, "number": number}, n, total

    def delete(self, ids: DataFrame) -> TextIndex:
        """Without the rows named (id); unknown ids don't matter."""
        tomb, n, total = self._buried(ids)
        return self._commit(tombstones=[*self.tombstones, tomb], rows=self.rows - n, words=self.words - total)

    def upsert(self, docs: DataFrame) -> TextIndex:
        """docs: (id, text columns), new ones or in place of those with their ids, in one version."""
        tomb, n, total = self._buried(docs)
        segment, more, said = self._written(docs, tomb["number"] + 1)
        out = self._commit(segments=[*self.segments, segment], tombstones=[*self.tombstones, tomb], rows=self.rows - n + more, words=self.words - total + said)
        return out.merge() if len(out.segments) > MOST_SEGMENTS else out

    def merge(self) -> TextIndex:
        """One segment without tombstones, from the postings: the texts aren't read."""
        if len(self.segments) <= 1 and not self.tombstones:
            return self
        files = sum(len(s["files"]) for s in self.segments)
        name = f"segment-{uuid.uuid4().hex}"
        segment, _ = self._stored(name, self.table().select(POSTING), self._number(), max(1, files))
        n, total = self._with_rows(name, self.lengths())
        return self._commit(segments=[segment], tombstones=[], rows=n, words=total)

    def vacuum(self) -> None:
        """Delete what this version, the latest, doesn't name; readers of older versions lose their files."""
        used = {x["name"] for x in self.segments + self.tombstones} | {f"manifest-{self.version:012d}.json"}
        for n in names(self.spark, self.path):
            if n not in used:
                delete(self.spark, f"{self.path}/{n}")


def _ranges(cut: DataFrame, weights: dict[str, float], files: int, rows: int, total: int) -> list[tuple]:
    """The last (term, id) of every file but the last. They only choose which file holds a posting, so a sample by hashes is enough: of the rows, as many as hold about four times `SAMPLE` words or four for each file, and of their postings about `SAMPLE`."""
    many = max(4 * files, rows * 4 * SAMPLE // max(1, total))
    every = max(1, rows // many)
    thin = max(1, total // every // SAMPLE)
    some = cut.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", F.explode(F.array_distinct(F.concat(*weights))).alias("term"))
    some = some.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("term", "id"), F.lit(thin)) == 0))
    spread = some.select("term", "id", F.ntile(files).over(Window.orderBy("term", "id")).alias("part"))
    ends = spread.groupBy("part").agg(F.max(F.struct("term", "id")).alias("end")).orderBy("part").collect()
    return [tuple(r["end"]) for r in ends[:-1]]


def _dealt(word: pa.Array, which: np.ndarray, ids: pa.Array, ranges: list[tuple]) -> np.ndarray:
    """The file of every posting: how many of the ranges' ends are smaller. word: distinct ones, which: of them, ids: of the postings."""
    if not ranges:
        return np.zeros(len(which), np.int32)
    names, said = np.array([t for t, _ in ranges], object), np.array(word.to_pylist(), object)
    low, high = np.searchsorted(names, said, "left"), np.searchsorted(names, said, "right")
    out = low[which]
    split = np.flatnonzero((high > low)[which])  # postings of terms that end a file, told apart by their ids
    split = split[np.argsort(which[split], kind="stable")]
    ids = ids.take(pa.array(split)).fill_null(ranges[0][1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(which[split], prepend=-1))
    for a, z in zip(starts, [*starts[1:], len(split)]):
        w = which[split[a]]
        out[split[a:z]] += np.searchsorted(np.array([i for _, i in ranges[low[w] : high[w]]], ids.dtype), ids[a:z], "left")
    return out.astype(np.int32)


def _counted(cut: DataFrame, weights: dict[str, float], id_type: str, ranges: list[tuple] | None = None, rows: range = range(0)) -> DataFrame:
    """cut: (id, a list of words for each weighted column), ids unique. The postings of every row; with ranges also the file (part) of each, and for every row its length without a term, in the files `rows`."""
    ship(cut.sparkSession)
    names = POSTING if ranges is None else [*POSTING, "part"]

    def some(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Sorted by row and word, stably, so that places stay in order: each run is a posting."""
        columns = [part.column(c) for c in weights]
        each = [np.diff(c.offsets.to_numpy()) for c in columns]
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in each])
        at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (k << COLUMN) for k, n in enumerate(each)])
        weight = np.repeat(list(map(float, weights.values())), [n.sum() for n in each])
        word = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
        key = row * len(word.dictionary) + word.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        of, lead = row[order][first], order[first]
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(at[order], pa.int64()))
        tf = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
        which, ids = word.indices.take(pa.array(lead)), part.column("id").take(pa.array(of))
        out = [word.dictionary.take(which), ids, pa.array(tf), pa.array(np.diff(np.append(first, len(key)))), pa.array(sum(each).astype(np.int64)[of]), at]
        if ranges is None:
            yield pa.RecordBatch.from_arrays(out, names)
            return
        yield pa.RecordBatch.from_arrays([*out, pa.array(_dealt(word.dictionary, which.to_numpy(), ids, ranges))], names)
        none, n = pa.nulls, len(part)
        where = pa.array(rows.start + np.arange(n) % len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([none(n, pa.string()), part.column("id"), none(n, pa.float64()), none(n, pa.int64()), pa.array(sum(each).astype(np.int64)), none(n, pa.list_(pa.int64())), where], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = np.cumsum(sum(np.diff(part.column(c).offsets.to_numpy()) for c in weights)) // CUT  # rows that are counted together
            starts = [*np.flatnonzero(np.diff(n, prepend=-1)).tolist(), len(part)]
            for low, high in zip(starts, starts[1:]):
                yield from some(part.slice(low, high - low))

    return cut.mapInArrow(run, f"term string, id {id_type}, tf double, uses bigint, dl bigint, at array<bigint>" + (", part int" if ranges is not None else ""))


def _stemmed(terms: DataFrame) -> DataFrame:
    """Postings of words as postings of their stems."""
    ship(terms.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(stem=[stem(x) for x in part["term"]])

    stems = terms.select("term").distinct().mapInPandas(run, "term string, stem string")
    return terms.join(stems, "term").groupBy("id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"), F.sum("uses").alias("uses"), F.max("dl").alias("dl"), F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))


def build(docs: DataFrame, weights: dict[str, float], path: str | None = None, stemmed: bool = False) -> TextIndex:
    """docs: (id, text columns), ids unique. A column's term counts are multiplied by its weight; a row's length counts all words alike."""
    empty = TextIndex(docs.sparkSession, path or folder(docs.sparkSession), weights, docs.schema["id"].dataType.simpleString(), stemmed)
    return empty.insert(docs)


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def matches(index: TextIndex, phrases: list[list[str]]) -> DataFrame:
    """(id, phrase, tf, dl): the rows that hold a phrase (its number), and how often, by the weights of the columns. Words of a phrase follow each other in one column."""
    said = [[stem(w) for w in p] if index.stemmed else p for p in phrases]
    post = index.postings(list({w for p in said for w in p}))
    numbers = {}
    for i, p in enumerate(said):
        if len(p) == 1:
            numbers.setdefault(p[0], []).append(i)
    out = post.select("id", "term", "tf", "dl").limit(0).select("id", F.lit(0).alias("phrase"), "tf", "dl")
    if numbers:
        which = F.coalesce(*[F.when(F.col("term") == w, F.array(*map(F.lit, at))) for w, at in numbers.items()])
        out = post.filter(F.col("term").isin(*numbers)).select("id", F.explode(which).alias("phrase"), "tf", "dl")
    weight = F.array(*[F.lit(float(w)) for w in index.weights.values()])
    for i, p in enumerate(said):
        if len(p) < 2:
            continue
        of = lambda w: F.first(F.when(F.col("term") == w, F.col("at")), ignorenulls=True)
        both = dealt(post.filter(F.col("term").isin(*p)).repartition("id"), index.rows * len(p), "id")  # before they are sorted, so that no scan sorts what its files hold
        rows = both.groupBy("id").agg(F.max("dl").alias("dl"), *[of(w).alias(f"_{j}") for j, w in enumerate(p)])
        start = F.col("_0")
        for j in range(1, len(p)):
            start = F.array_intersect(start, _shifted(f"_{j}", j))
        tf = F.aggregate(start, F.lit(0.0), lambda s, x: s + F.get(weight, F.shiftright(x, COLUMN).cast("int")))
        out = out.unionByName(rows.select("id", F.lit(i).alias("phrase"), tf.alias("tf"), "dl").filter("tf > 0"))
    return out


def bm25(index: TextIndex, query: str, within: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, terms: list[str] | None = None) -> DataFrame:
    """(id, bm25) of the rows that hold a term of the query, where parts with punctuation inside are phrases; `within` (id): only these rows count and are found. terms: words in place of a query."""
    found = matches(index, query_phrases(query) if terms is None else [[w] for w in terms])
    if within is None:
        n, mean = F.lit(index.rows), F.lit(index.length)
    else:
        ids = within.select("id").distinct()
        found = found.join(ids, "id", "left_semi")
        stats = ids.join(index.lengths(), "id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("mean")).first()
        n, mean = F.lit(stats["n"]), F.lit(float(stats["mean"] or 0.0))
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))  # a row for each of the query's terms
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    return found.join(F.broadcast(df), "phrase").groupBy("id").agg(F.sum(part).alias("bm25"))


def hit_rate(index: TextIndex, docs: DataFrame, text: str, every: int = 50, k: int = 10) -> DataFrame:
    """How often a row is among the best `k` for its own longest words (the share of rows asked for is one in `every`, by a hash): n_asked, n_found, rate, healthy (at least 0.8). Pairs of a row asked for and another with one of its words aren't made: postings of the words are dealt by rows to tasks of about `MET`, which meet about `ASKED` rows asked for and send out how many rows are better (`_better`)."""
    asked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    own = F.slice(F.array_sort(F.array_distinct(words(F.col(text))), lambda a, z: F.when(F.length(a) != F.length(z), F.length(z) - F.length(a)).when(a < z, -1).when(a > z, 1).otherwise(0)), 1, 3)
    queries = save(asked.select(F.col("id").alias("asked"), F.explode(own).alias("term")))
    table = index.table()
    often = save(queries.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    df = save(table.select("term").join(often, "term").groupBy("term", "t").agg(F.count("*").alias("df")))  # a table of its own, so that Spark sees how small it is
    posts = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(index.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.lit(index.length)))
    scored = table.select("term", "id", "tf", "dl").join(df, "term").select("t", "id", part.alias("s"))
    wanted = save(queries.join(df.select("term", "t"), "term").select("asked", "t"))
    mine = scored.join(wanted.select(F.col("asked").alias("id"), "t"), ["id", "t"]).groupBy("id").agg(F.round(F.sum("s"), 6).alias("own"))
    mine = save(mine.select(F.col("id").alias("asked"), "own"))
    blocks, groups = 1 + posts // MET, 1 + mine.count() // ASKED
    block, group = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("asked"), F.lit(groups))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = scored.select(block.alias("block"), all_of(groups).alias("group"), F.lit(False).alias("asks"), "t", "id", "s")
    looking = wanted.join(mine, "asked").select(all_of(blocks).alias("block"), group.alias("group"), F.lit(True).alias("asks"), "t", F.col("asked").alias("id"), F.col("own").alias("s"))
    met = there.unionByName(looking).select((F.col("block") * groups + F.col("group")).cast("int").alias("tile"), "asks", "t", "id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        held = pa.Table.from_batches(got) if got else None
        for tile in held.column("tile").unique().to_pylist() if got else []:
            rows = held.filter(pc.equal(held.column("tile"), tile))
            posts, asks = (rows.filter(x) for x in (pc.invert(rows.column("asks")), rows.column("asks")))
            who = asks.column("id").combine_chunks().dictionary_encode()
            order = np.lexsort((asks.column("t").to_numpy(), who.indices.to_numpy()))
            begin = np.flatnonzero(np.diff(who.indices.to_numpy()[order], prepend=-1))
            terms = np.split(asks.column("t").to_numpy()[order], begin[1:]) if len(begin) else []
            better = _better(posts.column("t").to_numpy(), posts.column("id").combine_chunks(), posts.column("s").to_numpy(), terms, asks.column("s").to_numpy()[order][begin])
            some = np.flatnonzero(better)
            yield pa.RecordBatch.from_arrays([who.dictionary.take(pa.array(some)), pa.array(better[some])], names=["asked", "better"])

    ship(index.spark)
    better = met.repartitionById(int(blocks * groups), "tile").mapInArrow(run, f"asked {index.id_type}, better bigint")
    better = better.groupBy("asked").agg(F.sum("better").alias("better"))
    found = mine.join(better, "asked", "left").filter(F.coalesce("better", F.lit(0)) < k)
    out = queries.select("asked").distinct().agg(F.count("*").alias("n_asked")).join(found.agg(F.count("*").alias("n_found")))
    rate = F.col("n_found") / F.col("n_asked")
    return out.select("n_asked", "n_found", F.round(rate, 6).alias("rate"), (rate >= 0.8).alias("healthy"))


def _better(term: np.ndarray, ids: pa.Array, part: np.ndarray, terms: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """How many rows have a larger score than `own`, to six digits, for each list of terms. term, ids, part: the rows' postings, each with its part of the score."""
    out = np.zeros(len(terms), np.int64)
    if not len(term):
        return out
    row = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.lexsort((row, term))
    term, row, part = term[order], row[order], part[order]
    begin = np.flatnonzero(np.diff(term, prepend=term[0] - 1))
    known, end, most = term[begin], np.append(begin[1:], len(term)), np.maximum.reduceat(part, begin)
    score = np.zeros(row.max() + 1)
    least = (np.rint(own * 1e6) + 0.5) / 1e6  # what rounds to more
    alike: dict[tuple, list[int]] = {}
    for q, t in enumerate(terms):
        at = np.searchsorted(known, t)
        alike.setdefault(tuple(x for x, y in zip(at.tolist(), t.tolist()) if x < len(known) and known[x] == y), []).append(q)
    for lists, who in alike.items():
        low = least[who].min()
        lists = sorted(lists, key=lambda x: most[x], reverse=True)
        alone = [sum(most[x] for x in lists[j:]) + 1e-9 >= low for j in range(len(lists))]  # whether a row without the lists before can be better
        if not any(alone):
            continue
        for x in lists:
            score[row[begin[x] : end[x]]] += part[begin[x] : end[x]]
        above = []
        for x, may in zip(lists, alone):
            rows = row[begin[x] : end[x]]
            if may:
                got = score[rows]
                above.append(got[got >= low])
            score[rows] = 0.0
        above = np.sort(np.concatenate(above))
        out[who] = len(above) - np.searchsorted(above, least[who], "left")
    return out
