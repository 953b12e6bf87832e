"""The maintenance run: phases that feed each other, commits of several tables, and runs that are stopped and resumed."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def state(store):
    """What the tables hold, whatever files they lie in."""
    return {n: sorted(str(tuple(r)) for r in df.collect()) for n, df in store.get().items() if n in ("exchanges", "facts", "memories", "weights")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_a_run_that_is_stopped_ends_as_one_that_is_not(spark):
    from loam.plans.maintenance import Tables, run
    from loam.plans.text_queries import maintained, phases

    whole, report = run(maintained(spark, DATA), phases())
    assert {r["status"] for r in report.collect()} == {"done"} and whole.run["ended"]

    def bad(tables):
        assert tables["facts"].count() > 0  # what extraction has left
        raise ValueError("no model")

    store = maintained(spark, DATA)
    broken, report = run(store, phases() | {"consolidate": bad})
    rows = [tuple(r) for r in report.collect()]
    assert ("consolidate", "failed: ValueError: no model", None, None) == rows[-1] and not broken.run["ended"] and broken.run["done"] == ["ingest", "extract"]
    again, report = run(Tables.open(spark, store.path), phases())
    assert [(r["phase"], r["status"]) for r in report.collect()][:2] == [("ingest", "done before"), ("extract", "done before")]
    assert again.run["id"] == broken.run["id"] and state(again) == state(whole)
    # The next run has nothing left to take in.
    third, report = run(again, phases(), skip=("reflect",))
    left = {(r["phase"], r["name"]): r["rows"] for r in report.collect()}
    assert third.run["id"] != again.run["id"] and left["extract", "facts"] == 0 and left["prune", "memories"] == whole.tables["memories"]["rows"] and left["reflect", None] is None


def test_tables_are_committed_together(spark, tmp_path):
    from loam.plans.maintenance import Tables

    store = Tables(spark, f"file://{tmp_path}/store").commit({"a": spark.range(3), "b": spark.range(2)})

    def half(i):
        raise ValueError("half way")

    with pytest.raises(Exception, match="half way"):
        store.commit({"a": spark.range(9), "b": spark.range(5).rdd.map(half).toDF("id long")})
    now = Tables.open(spark, store.path)
    assert now.version == 1 and {n: df.count() for n, df in now.get().items()} == {"a": 3, "b": 2}
    store.commit({"b": spark.range(7)})
    with pytest.raises(Exception, match="exist"):
        store.commit({"a": spark.range(1)})  # made from an older version
    assert {n: df.count() for n, df in Tables.open(spark, store.path).get().items()} == {"a": 3, "b": 7}
    assert Tables.open(spark, f"file://{tmp_path}/none").version == 0


def test_a_model_is_asked_once(spark):
    """Facts and their sources come from one answer to each conversation."""
    from pyspark.sql import functions as F

    from loam.plans import maintenance as mt
    from loam.plans import text_queries as q

    asked = spark.sparkContext.accumulator(0)

    def count(answer):
        asked.add(1)
        return answer

    store = q.maintained(spark, "/root/testdata/sf0.001")
    tables = store.get()
    tables["fingerprints"] = tables["fingerprints"].limit(0)
    store.commit(mt.extract(lambda e: q.said_facts(e).withColumn("answer", F.udf(count, "string").asNondeterministic()("answer")))(tables))
    assert asked.value == tables["exchanges"].select("conversation_id").distinct().count()
