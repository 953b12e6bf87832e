"""The turn store: versions, buckets, repeated batches, and the feed of changes."""

from loam.streaming.turns import OPTIONAL, SCHEMA, TurnStore, conversations, follow, ingest

MORE = SCHEMA + ", " + ", ".join(f"{c} {t}" for c, t in OPTIONAL.items())


def rows(store):
    return {r["id"]: (r["text"], r["created_at"], r["updated_at"]) for r in store.rows().collect()}


def test_a_stream_of_turns(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store, check = f"{tmp_path}/store", f"{tmp_path}/check"
    now = lambda: ingest(spark, f"{tmp_path}/in", store, check)
    assert TurnStore.open(spark, store).version == -1 and TurnStore.open(spark, store).rows().count() == 0
    put([(1, 0, "user", "a"), (1, 1, "assistant", "b")])
    assert now() == 0
    put([(1, 1, "assistant", "newer"), (2, 0, "user", "c"), (1, 0, "user", "a")])
    assert now() == 1 and now() == 1  # nothing new
    assert rows(TurnStore.open(spark, store)) == {"1:0": ("a", 0, 0), "1:1": ("newer", 0, 1), "2:0": ("c", 1, 1)}
    put([(3, 0, "user", "  "), (3, 1, "user", " d "), (None, 1, "user", "x"), (4, None, "user", "x"), (4, -1, "user", "x")])
    assert now() == 2
    s = TurnStore.open(spark, store)
    assert rows(s)["3:1"] == ("d", 2, 2) and len(rows(s)) == 4
    told = []
    keep = lambda changes, versions: told.append((versions, sorted((r["version"], r["change"], r["id"]) for r in changes.collect())))
    follow(spark, store, f"{tmp_path}/seen", keep)
    follow(spark, store, f"{tmp_path}/seen", keep)
    assert told == [([0, 1, 2], [(0, "insert", "1:0"), (0, "insert", "1:1"), (1, "insert", "2:0"), (1, "update", "1:1"), (2, "insert", "3:1")])]
    put([(2, 0, "user", "cc")])
    now()
    follow(spark, store, f"{tmp_path}/seen", keep)
    assert told[1:] == [([3], [(3, "update", "2:0")])]
    s = TurnStore.open(spark, store)
    assert [tuple(r)[:3] for r in s.changes(after=2).collect()] == [(3, "update", "2:0")] and s.changes(after=3).count() == 0
    assert [tuple(r) for r in conversations(s, s.changes(after=2)).collect()] == [(2, 1, 0, 1, 3)]


def test_a_turn_rewrites_its_bucket_only(spark, tmp_path):
    store = TurnStore(spark, f"{tmp_path}/store", buckets=16)
    store = store.upsert(spark.createDataFrame([(c, 0, "user", f"t{c}") for c in range(80)], SCHEMA), 0)
    after = store.upsert(spark.createDataFrame([(7, 0, "user", "new")], SCHEMA), 1)
    moved = [b for b in after.folders if after.folders[b] != store.folders[b]]
    assert len(moved) == 1 and len(after.folders) == 16
    assert {r["text"] for r in store.rows().filter("conv_id = 7").collect()} == {"t7"}  # its readers keep the old version
    assert rows(after)["7:0"] == ("new", 0, 1) and len(rows(after)) == 80
    assert after.upsert(spark.createDataFrame([(7, 0, "user", "again")], SCHEMA), 1) is after  # a repeated batch
    same = after.upsert(spark.createDataFrame([(7, 0, "user", "new")], SCHEMA), 2)
    assert same.changes(after=1).count() == 0 and rows(same)["7:0"] == ("new", 0, 1)
    empty = same.upsert(spark.createDataFrame([], SCHEMA), 3)
    assert empty.version == 3 and len(rows(empty)) == 80
    empty.vacuum(keep=1)
    assert len(rows(TurnStore.open(spark, empty.path))) == 80


def test_sources_times_and_tool_calls(spark, tmp_path):
    store = TurnStore(spark, f"{tmp_path}/store")
    one = [(1, 0, "user", "a", "cli", "2024-05-01 10:00:00", ["ls", "cat"]), (1, 0, "user", "b", " ", "nonsense", None)]
    store = store.upsert(spark.createDataFrame(one, MORE), 0)
    store = store.upsert(spark.createDataFrame([(1, 0, "user", "a", "cli", "2024-05-01T12:00:00+02:00", ["rm"])], MORE), 1)
    got = {r["id"]: (r["text"], r["ts"], r["tool_calls"]) for r in store.rows().collect()}
    assert got == {"cli:1:0": ("a", "2024-05-01T10:00:00.000Z", ["rm"]), "1:0": ("b", None, None)}
