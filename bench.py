"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("semantic_recall", "episodic_recall_hybrid", "multi_source_recall", "bm25_topk", "knn_topk", "exchange_pairing", "decay_health", "exact_collapse", "graph_projection", "edge_weights", "visibility_threshold", "community_evolution", "word_frequencies", "regex_scan", "commitment_overlap")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loam.plans.queries import QUERIES
    from loam.plans.tables import text_index

    took = {}
    start = time.perf_counter()
    for name in ("memories", "exchanges"):  # stored: only the first run over a folder's files builds them
        text_index(spark, d, name)
    took["text_index_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
