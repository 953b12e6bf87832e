"""Corpus and text analytics: word counts, pattern scans, snippets, symbols and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import fixed


def word_frequencies(docs: DataFrame, text: str = "content", stop_words: list[str] = fixed.QUERY_STOP_WORDS, least: int = 3, limit: int = 100) -> DataFrame:
    """Words of 3 to 24 characters that are no stop words, numbers or long hexadecimal strings, with at least `least` uses."""
    w = docs.select(F.explode(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", " "), r"\s+")).alias("word"))
    w = w.filter((F.length("word") > 2) & (F.length("word") < 25) & ~F.col("word").isin(*stop_words) & ~F.col("word").rlike(r"^\d+$") & ~F.col("word").rlike(r"^[0-9a-f]{8,}$"))
    return w.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit)


def lines(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(id, line, text), lines from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "text")).select(key, (F.col("pos") + 1).cast("long").alias("line"), "text")


def scan(docs: DataFrame, patterns: dict[str, str], context: int = 2, key: str = "id", text: str = "content") -> DataFrame:
    """Lines that match one of up to ten patterns, with how often, and the context inside the text that the match before hasn't shown."""
    if not 0 < len(patterns) <= 10:
        raise ValueError("one to ten patterns")
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("pattern"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias("n")) for n, p in patterns.items()]), lambda x: x["n"] > 0)
    split = docs.select(key, F.split(text, "\n").alias("ls")).select(key, F.size("ls").cast("long").alias("last"), F.posexplode("ls").alias("pos", "text"))
    hits = split.select(key, "last", (F.col("pos") + 1).cast("long").alias("line"), F.explode(found).alias("x")).select(key, "last", "line", "x.pattern", "x.n")
    w = Window.partitionBy(key).orderBy("line", "pattern")
    start = F.greatest(F.lit(1).cast("long"), F.col("line") - context)
    return hits.select(key, "line", "pattern", "n", F.greatest(start, F.coalesce(F.lag("line").over(w) + context + 1, F.lit(1))).alias("context_from"), F.least("last", F.col("line") + context).alias("context_to"))


def first_matches(found: DataFrame, most: int, by_pattern: bool = False, key: str = "id") -> DataFrame:
    """The first `most` (1 to 500) rows of a scan, by place or by pattern, with whether there are more."""
    order = ["pattern", key, "line"] if by_pattern else [key, "line", "pattern"]
    most = min(max(most, 1), 500)
    n = found.agg((F.count("*") > most).alias("truncated"))
    return found.orderBy(*order).limit(most).join(F.broadcast(n))


def pattern_counts(docs: DataFrame, patterns: dict[str, str], key: str = "id", text: str = "content") -> DataFrame:
    """Matches of every pattern, also of those without any."""
    sums = docs.agg(*[F.sum(F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))).alias(n) for n, p in patterns.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in patterns])).alias("x")).select("x.*")


def merge_ranges(ranges: DataFrame, pad: int = 0, key: str = "id") -> DataFrame:
    """(id, start, end) ranges, padded, that touch or overlap become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    p = ranges.select(key, F.greatest(F.lit(1).cast("long"), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = p.withColumn("new", F.when(seen.isNull() | (F.col("start") > seen + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _stretches(docs: DataFrame, opens: str, resets: str | None, key: str, text: str) -> DataFrame:
    """(id, name, start, end): from each line that opens a name to the line before the next that opens or resets one. A text's lines stay in its row, so nothing is shuffled."""
    reset = (lambda x: x.rlike(resets)) if resets else (lambda x: F.lit(False))
    split = docs.select(key, F.split(text, "\n").alias("ls"))
    marks = F.transform("ls", lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.nullif(F.regexp_extract(x, opens, 1), F.lit("")).alias("name"), F.coalesce(reset(x), F.lit(False)).alias("reset")))
    marked = split.select(key, F.size("ls").cast("long").alias("z"), F.filter(marks, lambda m: m["name"].isNotNull() | m["reset"]).alias("ms"))
    spans = F.transform("ms", lambda m, i: F.struct(m["name"].alias("name"), m["line"].alias("start"), F.coalesce(F.get("ms", i + 1)["line"] - 1, F.col("z")).alias("end")))
    return marked.select(key, F.explode(F.filter(spans, lambda s: s["name"].isNotNull())).alias("s")).select(key, "s.name", "s.start", "s.end")


def enclosing(docs: DataFrame, opens: str, resets: str, key: str = "id", text: str = "content") -> DataFrame:
    """Lines with the last name that `opens` captured, forgotten at lines that match `resets`."""
    return _stretches(docs, opens, resets, key, text).select(key, F.explode(F.sequence("start", "end")).alias("line"), F.col("name").alias("enclosing"))


def symbols(docs: DataFrame, pattern: str, key: str = "id", text: str = "content") -> DataFrame:
    """Lines that open a symbol, each ending where the next begins."""
    return _stretches(docs, pattern, None, key, text)


def embedding_check(vectors: DataFrame, dims: int, slack: float = 0.05) -> DataFrame:
    from loam.functions.columns import norm

    n = norm(F.col("embedding"))
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dims).alias("wrong_dims"), F.count_if(F.abs(n - 1) > slack).alias("not_unit"), F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zero"))


def index_audit(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows without an index entry, entries without a row, and entries of deleted rows."""
    r, i = rows.select("id", "deleted_at"), indexed.select("id").distinct()
    kinds = [("not_indexed", r.filter("deleted_at IS NULL").join(i, "id", "left_anti")), ("no_row", i.join(r, "id", "left_anti")), ("deleted", r.filter("deleted_at IS NOT NULL").join(i, "id", "left_semi"))]
    out = None
    for kind, df in kinds:
        one = df.select(F.lit(kind).alias("problem"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def contexts(docs: DataFrame, hits: DataFrame, context: int = 2, key: str = "id", text: str = "content") -> DataFrame:
    """hits: (id, line). The lines around each, numbered, the hit marked; a text's lines stay in its row."""
    split = docs.select(key, F.split(text, "\n").alias("ls"))
    low, high = F.greatest(F.lit(1), F.col("line") - context).cast("int"), F.least(F.size("ls"), F.col("line") + context).cast("int")
    rows = hits.join(split, key).withColumn("a", low).withColumn("e", high)
    numbered = F.transform(F.sequence("a", "e"), lambda i: F.concat(F.lpad(i.cast("string"), F.length(F.col("e").cast("string")), F.lit(" ")), F.when(i == F.col("line"), ">").otherwise(" "), F.lit("| "), F.element_at("ls", i)))
    return rows.select(key, "line", F.array_join(numbered, "\n").alias("context"))


def snippets(docs: DataFrame, ranges: DataFrame, pad: int = 0, key: str = "id", text: str = "content") -> DataFrame:
    """ranges: (id, start, end). Padded, cut to the text and merged, with the lines they hold."""
    split = docs.select(key, F.split(text, "\n").alias("ls"))
    inside = ranges.join(split.select(key, F.size("ls").alias("z")), key).select(key, F.greatest(F.lit(1).cast("long"), F.col("start") - pad).alias("start"), F.least(F.col("z").cast("long"), F.col("end") + pad).alias("end")).filter("start <= end")
    merged = merge_ranges(inside, 0, key)
    return merged.join(split, key).select(key, "start", "end", F.array_join(F.slice("ls", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n").alias("text"))


def line_range(docs: DataFrame, start: int, end: int, key: str = "id", text: str = "content") -> DataFrame:
    """Lines start to end of each text that has the first of them."""
    ls = F.split(text, "\n")
    return docs.filter(F.size(ls) >= start).select(key, F.array_join(F.slice(ls, start, end - start + 1), "\n").alias("text"))


def symbol_graph(found: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """found: (id, name, ...). Entities (id, name, type) of the files and their symbols, and `contains` edges; equal keys are one, so that a second run changes nothing."""
    one = found.select(F.col(key).cast("string").alias("f"), "name").distinct()
    file, symbol = F.concat(F.lit("file:"), "f"), F.concat(F.lit("symbol:"), "f", F.lit(":"), "name")
    files = one.select("f").distinct().select(file.alias("id"), F.col("f").alias("name"), F.lit("file").alias("type"))
    return files.unionByName(one.select(symbol.alias("id"), "name", F.lit("symbol").alias("type"))), one.select(file.alias("source"), symbol.alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))


def index_repair(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """What repairs an index: entries of rows that live are kept, others dropped, and missing ones indexed."""
    live, have = rows.filter("deleted_at IS NULL").select("id"), indexed.select("id").distinct()
    kept = have.join(live.withColumn("_l", F.lit(True)), "id", "left").select("id", F.when(F.col("_l"), "keep").otherwise("drop").alias("step"))
    return kept.unionByName(live.join(have, "id", "left_anti").select("id", F.lit("index").alias("step")))
