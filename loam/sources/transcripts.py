"""Transcripts and JSON lines: reading, exporting and importing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.sources.files import qualified

PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}  # of a local folder: no file of checksums beside each file; other stores don't read these
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"  # tasks at most
LINE = "type string, timestamp string, message struct<role:string,content:string>"
AS_BLOCKS = "message struct<content:array<struct<type:string,text:string,name:string,input:string>>>"


def _depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def read_transcripts(spark: SparkSession, path: str, skip_marker: str | None = None, files: str = "*.jsonl") -> DataFrame:
    """Lines of <path>/<project>/<files> as (conversation_id, project, line, role, text, tool_calls). Lines that aren't JSON, or are neither the user's nor the assistant's, are left out; files whose first 4096 characters hold the marker are, too."""
    # The folders are listed by tasks, four a core and not one a folder; a pattern over all files would list them one by one in the driver. Only files right below a project count.
    most = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(most), 4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.text(f"{path}/*", wholetext=True, pathGlobFilter=files, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    finally:
        spark.conf.set(LISTING, most)
    files = files.filter(_depth(F.col("file")) == _depth(F.lit(qualified(spark, path))) + 2)
    if skip_marker:
        files = files.filter(~F.substring("value", 1, 4096).contains(skip_marker))
    parts = F.split("file", "/")
    project = F.element_at(F.filter(F.split(F.element_at(parts, -2), "-"), lambda x: x != ""), -1)
    rows = files.select("file", project.alias("project"), F.posexplode(F.split("value", "\n")).alias("pos", "raw"))
    rows = rows.withColumn("j", F.from_json("raw", LINE, {"mode": "PERMISSIVE"})).filter(F.col("j.type").isin("user", "assistant"))
    content = F.col("j.message.content")
    # A content of blocks is an array in the line itself; a text that looks like JSON stays a text.
    blocks = F.when(F.get_json_object("raw", "$.message.content[0].type").isNotNull(), F.from_json("raw", AS_BLOCKS)["message"]["content"])
    text = F.when(blocks.isNull(), content).otherwise(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))
    tools = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), F.substring(b["input"], 1, 1000).alias("input")))
    return rows.select(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("conversation_id"), "project", (F.col("pos") + 1).cast("long").alias("line"), F.col("j.type").alias("role"), text.alias("text"), tools.alias("tool_calls"))


def export_lines(kinds: dict[str, DataFrame], scopes: list[str] | None = None, inactive: bool = False, schema_version: int = 1) -> DataFrame:
    """(place, value): a header line (place 0) with the counts and what was asked for, then every row as one JSON line, by kind, creation and id, so that a sink writes them in the order of place. Forgotten memories never go out, inactive ones only if asked for; scopes limit rows that have one. Every frame has an id and created_at."""
    out = counts = None
    for n, (kind, df) in enumerate(kinds.items()):
        if "deleted_at" in df.columns:
            df = df.filter("deleted_at IS NULL")
        if "is_active" in df.columns and not inactive:
            df = df.filter("is_active")
        if scopes and "scope" in df.columns:
            df = df.filter(F.coalesce("scope", F.lit("global")).isin(*scopes))
        at = F.struct(F.lit(n + 1).alias("kind"), F.col("created_at").cast("long").alias("created_at"), F.col("id").cast("string").alias("id"))
        one = df.select(at.alias("place"), F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(schema_version).alias("v"), F.struct("*").alias("data"))).alias("value"))
        count = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out, counts = (one, count) if out is None else (out.unionByName(one), counts.unionByName(count))
    head = F.to_json(F.struct(F.lit("header").alias("kind"), F.lit(schema_version).alias("v"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"), F.lit(",".join(scopes or [])).alias("scopes"), F.lit(inactive).alias("include_inactive")))
    first = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("created_at"), F.lit("").alias("id"))
    return counts.agg(head.alias("value")).select(first.alias("place"), "value").unionByName(out)


def import_lines(lines: DataFrame, kind: str, schema: str, existing: DataFrame, version: str = "updated_at", ends: DataFrame | None = None) -> DataFrame:
    """lines: (value). What becomes of each record of a kind: insert, update (it is newer) or skip; with `ends` (id), records whose source or target isn't there are `missing`. Import entities before memories, memories before relationships."""
    rows = lines.filter(F.get_json_object("value", "$.kind") == kind).withColumn("j", F.from_json("value", f"kind string, data struct<{schema}>", {"mode": "FAILFAST"})).select("j.data.*")
    w = Window.partitionBy("id").orderBy(F.desc(version))
    new = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    old = existing.select("id", F.col(version).alias("_old"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col(version) > F.col("_old"), "update").otherwise("skip")
    out = new.join(old, "id", "left").withColumn("action", action).drop("_old")
    if ends is not None:
        for side in ("source", "target"):
            known = ends.select(F.col("id").alias(side)).distinct().withColumn("_known", F.lit(True))
            out = out.join(known, side, "left").withColumn("action", F.when(F.col("_known"), F.col("action")).otherwise("missing")).drop("_known")
    return out


def write_transcripts(turns: DataFrame, path: str, project: str) -> None:
    """turns: (conversation_id, line, role, text) as one file of JSON lines for each conversation, in <path>/<project>/conversation=<id>/, which `read_transcripts` reads with files="*.txt"."""
    raw = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = turns.select(F.col("conversation_id").cast("string").alias("conversation"), "line", raw.alias("value"))
    text = rows.groupBy("conversation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    text.repartition("conversation").write.options(**PLAIN).partitionBy("conversation").text(f"{path}/{project}")
