import json



def test_transcripts_pair_into_exchanges(spark, tmp_path):
    from loam.operators.episodes import pair_turns
    from loam.sources.transcripts import read_transcripts

    folder = tmp_path / "home-me-proj"
    folder.mkdir()
    say = lambda role, content: json.dumps({"type": role, "message": {"role": role, "content": content}})
    lines = [say("user", "hello"), "not json", say("assistant", [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"a": "x" * 2000}}]), say("assistant", "more"), say("system", "no"), say("user", "unanswered")]
    (folder / "c1.jsonl").write_text("\n".join(lines))
    (folder / "c2.jsonl").write_text("SKIP-ME\n" + say("user", "x"))
    rows = read_transcripts(spark, str(tmp_path), "SKIP-ME")
    got = rows.orderBy("line").collect()
    assert [(r["conversation_id"], r["project"], r["line"], r["role"], r["text"]) for r in got] == [("c1", "proj", 1, "user", "hello"), ("c1", "proj", 3, "assistant", "hi"), ("c1", "proj", 4, "assistant", "more"), ("c1", "proj", 6, "user", "unanswered")]
    assert len(got[1]["tool_calls"][0]["input"]) == 1000
    pairs = pair_turns(rows.select("conversation_id", "line", "role", "text")).collect()
    assert [(p["user_message"], p["assistant_message"], p["exchange_index"]) for p in pairs] == [("hello", "hi\n\nmore", 0)]


def test_texts_that_look_like_json_stay_texts(spark, tmp_path):
    from loam.sources.transcripts import read_transcripts

    (tmp_path / "p").mkdir()
    for i, content in enumerate(['{"type": "text"}', '[{"type": "text", "text": "x"}]', "plain"]):
        (tmp_path / "p" / f"c{i}.jsonl").write_text(json.dumps({"type": "user", "message": {"role": "user", "content": content}}))
    got = {r["conversation_id"]: (r["text"], r["tool_calls"]) for r in read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"c0": ('{"type": "text"}', None), "c1": ('[{"type": "text", "text": "x"}]', None), "c2": ("plain", None)}


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Files right below a project count, also in hidden folders; a folder isn't a task of its own."""
    from loam.sources.transcripts import read_transcripts

    line = json.dumps({"type": "user", "message": {"role": "user", "content": "x"}})
    for i in range(40):
        (tmp_path / f"p{i}" / "deeper").mkdir(parents=True)
        (tmp_path / f"p{i}" / f"c{i}.jsonl").write_text(line)
        (tmp_path / f"p{i}" / "deeper" / "no.jsonl").write_text(line)
    (tmp_path / "_p").mkdir()
    (tmp_path / "_p" / "c40.jsonl").write_text(line)
    (tmp_path / "stray.jsonl").write_text(line)
    spark.sparkContext.setJobGroup("listing", "folders")
    rows = read_transcripts(spark, str(tmp_path))
    seen = spark.sparkContext.statusTracker()
    tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["conversation_id"] for r in rows.collect()) == sorted(f"c{i}" for i in range(41))


def test_export_and_import(spark):
    from loam.sources.transcripts import export_lines, import_lines

    m = spark.createDataFrame([(1, "a", 5, 9, True, None, None), (2, "b", 7, 3, True, None, "t"), (3, "c", 1, 4, True, None, None), (4, "d", 1, 1, False, None, None), (5, "e", 1, 1, True, 8, None)], "id long, content string, updated_at long, created_at long, is_active boolean, deleted_at long, scope string")
    e = spark.createDataFrame([("x", 1), ("y", 1)], "id string, created_at long")
    r = spark.createDataFrame([("r1", "x", "y", 1, 1), ("r2", "x", "z", 1, 1)], "id string, source string, target string, created_at long, updated_at long")
    lines = export_lines({"entity": e, "memory": m, "relationship": r})
    values = [json.loads(x["value"]) for x in lines.orderBy("place").collect()]
    assert values[0] == {"kind": "header", "v": 1, "counts": {"entity": 2, "memory": 3, "relationship": 2}, "scopes": "", "include_inactive": False}
    assert [x["data"]["id"] for x in values[1:]] == ["x", "y", 2, 3, 1, "r1", "r2"]
    assert export_lines({"memory": m}, ["t"], True).count() == 2 and export_lines({"memory": m}, None, True).count() == 5
    old = spark.createDataFrame([(1, 4), (2, 7)], "id long, updated_at long")
    got = import_lines(lines.select("value"), "memory", "id:long,content:string,updated_at:long", old)
    assert {x["id"]: x["action"] for x in got.collect()} == {1: "update", 2: "skip", 3: "insert"}
    got = import_lines(lines.select("value"), "relationship", "id:string,source:string,target:string,updated_at:long", r.limit(0).select("id", "updated_at"), ends=e)
    assert {x["id"]: x["action"] for x in got.collect()} == {"r1": "insert", "r2": "missing"}
