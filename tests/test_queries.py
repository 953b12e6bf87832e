"""Every query against its oracle on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from loam.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(cell(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    doubles = {c for c, t in got.dtypes if t == "double"}
    theirs = sorted(tuple(cell(float(r[i]) if c in doubles and r[i] is not None else r[i]) for c, i in zip(cols, at)) for r in want.fetchall())
    assert mine == theirs


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_chunks_at_the_borders(spark):
    from loam.operators.episodes import chunk_plan

    rows = chunk_plan(spark.createDataFrame([(n, n) for n in (0, 1, 100, 101, 105, 120, 125)], "conversation_id long, n long")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        got.setdefault(r["conversation_id"], []).append((r["start"], r["end"]))
    assert got[0] == [(0, 0)] and got[1] == [(0, 1)] and got[100] == [(0, 100)]
    assert got[105] == [(0, 25), (20, 45), (40, 65), (60, 85), (80, 105), (100, 105)]
    assert got[125][-1] == (120, 125)


def test_forget_marks_logs_and_suppresses(spark):
    from loam.operators import lifecycle

    m = spark.createDataFrame([(1, "A b!", None, None, True), (2, "c", "global", 5, False)], "id long, content string, scope string, deleted_at long, is_active boolean")
    after, log, stops = lifecycle.forget(m, spark.createDataFrame([(1,), (2,), (9,)], "id long"), "user", 77)
    assert {r["id"]: (r["deleted_at"], r["is_active"]) for r in after.collect()} == {1: (77, False), 2: (5, False)}
    assert [r["memory_id"] for r in log.collect()] == [1] and [r["scope"] for r in stops.collect()] == ["global"]


def test_upsert_keeps_the_latest(spark):
    from loam.operators.lifecycle import upsert

    old = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "id long, updated_at long, v string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 8, "d"), (3, 1, "e")], "id long, updated_at long, v string")
    assert {r["id"]: r["v"] for r in upsert(old, new).collect()} == {1: "c", 2: "b", 3: "e"}


@pytest.mark.parametrize("name", ["snippets", "snippet_ranges"])
def test_oracle_of_ranges_leaves_no_tie_to_chance(name):
    """Patterns that hit the same line make equal ranges; whichever of them comes first, they are one."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql("CREATE TABLE documents AS SELECT d AS doc_id, '' AS source, 'en' AS lang, 'x AAAA 1111' || chr(10) || 'y' AS text FROM range(3) t(d)")
    turned = ORACLES[name].replace("AS island FROM m)", "AS island FROM (SELECT * FROM m ORDER BY id, s, e, seen DESC NULLS LAST LIMIT 1000000000))")
    assert turned != ORACLES[name]
    assert sorted(con.sql(turned).fetchall()) == sorted(con.sql(ORACLES[name]).fetchall()) and len(con.sql(turned).fetchall()) == 3


@pytest.mark.parametrize("name", ["edge_weights", "graph_health", "orphans"])
def test_graph_joins_are_dealt_by_rows(spark, duck, name, monkeypatch):
    """A larger table gets more tasks, not larger ones, with the same rows."""
    from loam.sources import scratch

    monkeypatch.setattr(scratch, "ROWS", 200)
    assert "REPARTITION_BY_NUM" in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    test_query_matches_oracle(spark, duck, name)
