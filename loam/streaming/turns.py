"""Turns as a stream: micro-batches are upserted into a store of buckets, and what changed can be followed by version.

A turn's row lies in the bucket of its id. A batch reads and rewrites the buckets that its turns fall into and no others, writes what it changed into a log, and commits both by one small manifest, which names the folder of every bucket. A batch that is repeated after its commit does nothing; one that failed before it leaves files that no manifest names. Readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.files import create, delete, names, read

SCHEMA = "conv_id long, turn long, role string, text string"
OPTIONAL = {"source": "string", "ts": "string", "tool_calls": "array<string>"}  # columns that a stream of turns may have besides
STORED = f"id string, {SCHEMA}, source string, ts string, tool_calls array<string>, created_at long, updated_at long"
LOGGED = "version long, change string, id string, conv_id long, turn long, text string"
BUCKETS = 64


@dataclass
class TurnStore:
    spark: SparkSession
    path: str
    version: int = -1  # the number of the last batch
    buckets: int = BUCKETS
    folders: dict[str, str] | None = None  # of the buckets that hold something
    log: str = ""

    @staticmethod
    def open(spark: SparkSession, path: str) -> TurnStore:
        """The latest version; -1 and empty where there is none."""
        found = sorted(n for n in names(spark, f"{path}/commits") if n.startswith("commit-"))
        return TurnStore(spark, path, **json.loads(read(spark, f"{path}/commits/{found[-1]}"))) if found else TurnStore(spark, path)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All stored turns, or those of some buckets."""
        held = self.folders or {}
        at = [f"{self.path}/{f}" for b, f in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(STORED).parquet(*at) if at else self.spark.createDataFrame([], STORED)

    def changes(self, after: int = -1) -> DataFrame:
        """What the versions after one changed: (version, change, id, conv_id, turn, text), change `insert` or `update`."""
        logs = []
        for n in sorted(names(self.spark, f"{self.path}/commits")):
            if n.startswith("commit-") and after < int(n[7:19]) <= self.version:
                logs.append(json.loads(read(self.spark, f"{self.path}/commits/{n}"))["log"])
        return self.spark.read.schema(LOGGED).parquet(*[f"{self.path}/{x}" for x in logs]) if logs else self.spark.createDataFrame([], LOGGED)

    def upsert(self, turns: DataFrame, number: int) -> TurnStore:
        """The version after a batch. Turns of one id: the last write wins, of several in one batch the one with the largest text; created_at stays that of the first, tool calls are those of the last. Turns that say what is stored already change nothing."""
        if number <= self.version:
            return self
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = valid(turns)
        new = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), F.struct("text", "role", "ts")).alias("x")).select("id", "x.*")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most `buckets`
        said = ["conv_id", "turn", "role", "text", "source", "ts", "tool_calls"]
        old = self.rows(touched).select("id", F.struct(*said).alias("was"), "created_at", F.col("updated_at").alias("was_at"))
        both = old.join(new.select("id", F.struct(*said).alias("now")), "id", "full_outer")
        change = F.when(F.col("now").isNull() | F.col("now").eqNullSafe(F.col("was")), F.lit(None)).when(F.col("was").isNull(), "insert").otherwise("update")
        both = both.withColumn("change", change).withColumn("kept", F.coalesce("now", "was"))
        at, name = F.lit(number).cast("long"), uuid.uuid4().hex
        rows = both.select("id", "kept.*", F.coalesce("created_at", at).alias("created_at"), F.when(F.col("change").isNull(), F.col("was_at")).otherwise(at).alias("updated_at"), bucket, "change")
        stage = f"{self.path}/rows/{name}"
        rows.write.partitionBy("bucket").parquet(stage)
        found = [n for n in names(self.spark, stage) if n.startswith("bucket=")]
        written = self.spark.read.schema(f"{STORED}, change string").parquet(*[f"{stage}/{n}" for n in found]) if found else self.spark.createDataFrame([], f"{STORED}, change string")
        written.filter("change IS NOT NULL").select(at.alias("version"), "change", "id", "conv_id", "turn", "text").write.parquet(f"{self.path}/log/{name}")
        folders = (self.folders or {}) | {n.removeprefix("bucket="): f"rows/{name}/{n}" for n in found}
        state = {"version": number, "buckets": self.buckets, "folders": folders, "log": f"log/{name}"}
        create(self.spark, f"{self.path}/commits/commit-{number:012d}.json", json.dumps(state))
        return TurnStore(self.spark, self.path, **state)

    def vacuum(self, keep: int = 2) -> None:
        """Delete rows that none of the last `keep` versions names; logs and manifests stay."""
        commits = sorted(n for n in names(self.spark, f"{self.path}/commits") if n.startswith("commit-"))[-keep:]
        used = {f for n in commits for f in json.loads(read(self.spark, f"{self.path}/commits/{n}"))["folders"].values()}
        for name in names(self.spark, f"{self.path}/rows"):
            for n in names(self.spark, f"{self.path}/rows/{name}"):
                if n.startswith("bucket=") and f"rows/{name}/{n}" not in used:
                    delete(self.spark, f"{self.path}/rows/{name}/{n}")


def valid(turns: DataFrame) -> DataFrame:
    """Turns with a conversation, a place from 0 on and a text, which is trimmed; ids are the conversation and the place, after the source where there is one. Times become ISO in UTC, unreadable ones null."""
    for c, kind in OPTIONAL.items():
        if c not in turns.columns:
            turns = turns.withColumn(c, F.lit(None).cast(kind))
    ts = F.date_format(F.to_utc_timestamp(F.expr("try_to_timestamp(ts)"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    source = F.nullif(F.trim("source"), F.lit(""))
    rows = turns.select("conv_id", "turn", "role", F.trim("text").alias("text"), source.alias("source"), ts.alias("ts"), "tool_calls").filter("text <> '' AND conv_id IS NOT NULL AND turn >= 0")
    return rows.withColumn("id", F.concat_ws(":", "source", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int = 1000, schema: str = SCHEMA) -> int:
    """Read the turns that have arrived at `source` (Parquet) and upsert them, a version for each batch. Returns the version to read, also when nothing new has arrived; -1 while there is none."""
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        TurnStore.open(spark, store).upsert(batch, number)

    turns.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return TurnStore.open(spark, store).version


def follow(spark: SparkSession, store: str, checkpoint: str, told: Callable[[DataFrame, list[int]], None]) -> None:
    """Call told(changes, versions) for the versions that this checkpoint hasn't seen. The stream reads manifests, each once, so every change is told once, and again only if `told` failed."""
    commits = spark.readStream.schema("version long, log string").json(f"{store}/commits")

    def pass_on(batch: DataFrame, _: int) -> None:
        new = sorted((r["version"], r["log"]) for r in batch.collect())  # a row for each version
        if new:
            told(spark.read.schema(LOGGED).parquet(*[f"{store}/{log}" for _, log in new]), [v for v, _ in new])

    commits.writeStream.foreachBatch(pass_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def conversations(store: TurnStore, changed: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, last_turn, n_roles, updated_at) of all conversations, or of those that some changes touch."""
    rows = store.rows()
    if changed is not None:
        rows = rows.join(changed.select("conv_id").distinct(), "conv_id", "left_semi")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("n_roles"), F.max("updated_at").alias("updated_at"))
