"""The maintenance run: phases over a store of tables, each of which reads what the one before has committed.

A version of the store is one manifest that names the folder of every table, the run that it belongs to and the phases that run has done. A phase may change several tables; they are written first and committed together by the next manifest, so a run that is stopped between or inside phases goes on after the last one committed, with the same result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.columns import content_hash
from loam.operators import consolidation, episodes, extraction, graph, lifecycle
from loam.sources.files import create, names, read
from loam.sources.scratch import save

ORDER = ("ingest", "extract", "consolidate", "reflect", "prune")
Phase = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass
class Tables:
    spark: SparkSession
    path: str
    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)  # folder, schema and rows of each
    run: dict = field(default_factory=dict)  # id, done (phases), ended

    @staticmethod
    def open(spark: SparkSession, path: str) -> Tables:
        found = sorted(n for n in names(spark, path) if n.startswith("manifest-"))
        return Tables(spark, path, **json.loads(read(spark, f"{path}/{found[-1]}"))) if found else Tables(spark, path)

    def get(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.schema(t["schema"]).parquet(f"{self.path}/{t['folder']}") for n, t in self.tables.items()}

    def commit(self, changed: dict[str, DataFrame], run: dict | None = None) -> Tables:
        """The next version, with all of the changed tables or none; an error if another writer has made it."""
        new = {}
        for name, df in changed.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            new[name] = {"folder": folder, "schema": schema, "rows": self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").count()}
        state = {"version": self.version + 1, "tables": self.tables | new, "run": self.run if run is None else run}
        create(self.spark, f"{self.path}/manifest-{state['version']:09d}.json", json.dumps(state))
        return Tables(self.spark, self.path, **state)


def run(store: Tables, phases: dict[str, Phase], skip: tuple[str, ...] = ()) -> tuple[Tables, DataFrame]:
    """Do the phases in their order, each with its own commit; those that an unfinished run has done, and those to skip, are left out. The store after them, and the report (phase, status, name, rows): what each phase left in every table it changed. A failure ends the report with its message; the run stays open, and the next call resumes it."""
    at = store.run if store.run and not store.run["ended"] else {"id": uuid.uuid4().hex, "done": [], "ended": False}
    report: list[tuple] = []
    for name in sorted(phases, key=lambda p: ORDER.index(p) if p in ORDER else len(ORDER)):
        if name in at["done"] or name in skip:
            report.append((name, "done before" if name in at["done"] else "skipped", None, None))
            continue
        try:
            changed = phases[name](store.get())
            after = at | {"done": [*at["done"], name]}
            store = store.commit(changed, after)
            at = after
            report += [(name, "done", n, store.tables[n]["rows"]) for n in sorted(changed)]
        except Exception as e:  # noqa: BLE001  (whatever a phase raises ends the run)
            report.append((name, f"failed: {type(e).__name__}: {e}"[:500], None, None))
            break
    else:
        store = store.commit({}, at | {"ended": True})
    return store, store.spark.createDataFrame(report, "phase string, status string, name string, rows long")


# The five phases over the engine's tables: exchanges, arrived, fingerprints, facts, memories, entities, relationships, weights.

FACTS = "conversation_id long, pos int, content string, type string, importance double, confidence double, context string, sources array<string>"


def ingest(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Exchanges that have arrived and aren't known join the known ones."""
    new, _ = extraction.new_exchanges(tables["arrived"], tables["exchanges"])
    return {"exchanges": tables["exchanges"].unionByName(new), "arrived": tables["arrived"].limit(0)}


def extract(answer: Callable[[DataFrame], DataFrame]) -> Phase:
    """answer: from exchanges to a model's answers (conversation_id, answer). Conversations that have changed since they were last extracted are asked about; their facts wait for consolidation, and their fingerprints are kept."""

    def phase(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        now = episodes.fingerprint(tables["exchanges"])
        changed = now.join(tables["fingerprints"], ["conversation_id", "fingerprint"], "left_anti").select("conversation_id")
        asked = tables["exchanges"].join(changed, "conversation_id", "left_semi")
        found = save(extraction.facts(answer(asked)))  # a model is asked once
        sources = extraction.with_sources(found, asked)
        rows = found.join(sources, ["conversation_id", "pos"])
        facts = rows.select("conversation_id", "pos", "content", "type", "importance", "confidence", "context", "sources")
        return {"facts": tables["facts"].unionByName(facts), "fingerprints": now}

    return phase


def consolidate(now: int) -> Phase:
    """Facts that say the same become one. One that an active memory says already adds its sources there; the others are new memories, but for those that were forgotten with a suppression (content_hash, scope)."""

    def phase(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        m = tables["memories"]
        facts = tables["facts"].withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
        one = consolidation.collapse_batches(facts.withColumnRenamed("conversation_id", "batch")).join(facts.select(F.col("conversation_id").alias("batch"), "pos", "type"), ["batch", "pos"])
        one = one.withColumn("h", content_hash(F.col("content")))
        if "suppressions" in tables:
            one = one.join(tables["suppressions"].select(F.col("content_hash").alias("h")), "h", "left_anti")
        known = m.filter("is_active").groupBy(content_hash(F.col("content")).alias("h")).agg(F.min("id").alias("id"))
        met = one.join(known, "h", "left")
        more = met.filter("id IS NOT NULL").select("id", F.col("sources").alias("_more"))
        kept = m.join(more, "id", "left").withColumn("sources", F.when(F.col("_more").isNotNull(), F.array_union(F.coalesce("sources", F.array().cast("array<string>")), "_more")).otherwise(F.col("sources"))).select(m.columns)
        last = F.broadcast(m.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
        # Ids follow the largest one by place, which holds however the rows are dealt.
        fresh = met.filter("id IS NULL").join(last).select(
            (F.col("last") + 1 + F.col("batch") * 1000 + F.col("pos")).cast("long").alias("id"), "content", F.col("context").alias("context"), "type", "confidence", "importance", F.lit(0).cast("long").alias("access_count"), F.lit(now).cast("long").alias("created_at"),
            F.lit(None).cast("long").alias("last_accessed"), F.lit(None).cast("double").alias("stability"), F.lit(True).alias("is_active"), "sources",
        )
        return {"memories": kept.unionByName(fresh), "facts": tables["facts"].limit(0)}

    return phase


def reflect(now: int) -> Phase:
    """Relationships are weighed anew, by the memories as they are now."""
    return lambda tables: {"weights": graph.edge_weights(tables["relationships"], tables["entities"], tables["memories"], now)}


def prune(now: int) -> Phase:
    """Memories whose effective confidence is too low become inactive."""

    def phase(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        m = tables["memories"]
        gone = lifecycle.prune(m, now).select("id", F.lit(True).alias("_gone"))
        return {"memories": m.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(m.columns)}

    return phase
