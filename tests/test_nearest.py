"""The nearest memories of facts, by tiles, against the expressions over all pairs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.columns import dot, norm
from loam.operators.consolidation import _rounded, nearest

FACT, MEMORY = "fact_id long, scope string, content string, embedding array<float>", "id long, scope string, content string, embedding array<float>"


def rows(n, seed):
    rng = random.Random(seed)
    kinds = [[float(rng.randint(-3, 3)) or 1.0 for _ in range(6)] for _ in range(n // 3)]
    odd = {5: None, 11: [0.0] * 6, 17: [1.0, None, 2.0, 1.0, 1.0, 1.0], 23: [float("nan")] * 6, 29: [1.0, 2.0], 31: []}
    return [(i, rng.choice(["a", "b", "global", None]), f"text {i}", odd.get(i, rng.choice(kinds) if i % 2 else [rng.gauss(0, 1) for _ in range(6)])) for i in range(n)]


def test_nearest_in_tiles_equals_all_pairs(spark):
    facts, memories = spark.createDataFrame(rows(60, 1), FACT), spark.createDataFrame(rows(300, 2), MEMORY)
    got = {(r["fact_id"], r["n"]): (r["id"], r["cosine"], r["fact"], r["content"]) for r in nearest(facts, memories, 5, 16).collect()}
    whole = lambda c: F.expr(f"size({c}) = 6 AND forall({c}, x -> x IS NOT NULL AND NOT isnan(x)) AND exists({c}, x -> x <> 0)")
    f = facts.filter(whole("embedding")).select("fact_id", F.coalesce("scope", F.lit("global")).alias("scope"), F.col("content").alias("fact"), F.col("embedding").alias("q"))
    m = memories.filter(whole("embedding")).select("id", F.coalesce("scope", F.lit("global")).alias("scope"), "content", F.col("embedding").alias("v"))
    pairs = m.join(f, "scope").withColumn("cosine", F.round(dot(F.col("v"), F.col("q")) / (norm(F.col("v")) * norm(F.col("q"))), 6))
    want = pairs.withColumn("n", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("cosine"), "id"))).filter("n <= 5").collect()
    few = {k: v for k, v in got.items() if k[0] != 29}
    assert few == {(r["fact_id"], r["n"]): (r["id"], r["cosine"], r["fact"], r["content"]) for r in want} and len(few) > 200


def test_pairs_meet_in_tiles(spark):
    plan = nearest(spark.createDataFrame(rows(4, 1), FACT), spark.createDataFrame(rows(9, 2), MEMORY))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_halves_are_rounded_as_spark_rounds(spark):
    import numpy as np

    x = [0.1234565, -0.1234565, 0.0000005, 0.5000005, 0.9999995, 1.0000000000000002, 0.12345649999999999, 0.3]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert _rounded(np.array(x)).tolist() == want
