"""The stored text index: versions, deltas, tombstones and merging against an index built anew."""

import random

import pytest

from loam.operators.text_index import TextIndex, bm25, build, hit_rate
from loam.sources.files import create, names

SCHEMA = "id long, text string"


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 12))) + f" special{i}") for i in range(n)]


def scores(index, query, within=None):
    return {r["id"]: round(r["bm25"], 9) for r in bm25(index, query, within).collect()}


def same(a, b):
    assert (a.rows, a.words) == (b.rows, b.words)
    for q in ("w1 w2 special7", "w3", "special11 w1", "nothing"):
        assert scores(a, q) == scores(b, q)


def test_index_finds_rows_by_their_own_words(spark):
    rows = [(i, t) for i, t in texts(5, 80)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    index = build(df, {"text": 1.0})
    assert index.rows == 82 and list(scores(index, "special7")) == [7]
    assert scores(index, "special7", df.filter("id <> 7").select("id")) == {} and scores(index, "nothing here") == {} and scores(index, "") == {}
    r = hit_rate(index, df, "text", every=3).first()
    assert r["n_asked"] > 5 and r["n_found"] == r["n_asked"] and r["healthy"]
    none = build(df.limit(0), {"text": 1.0})
    assert none.rows == 0 and scores(none, "special7") == {}


def test_changes_show_and_equal_an_index_built_anew(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = dict(texts(1, 60))
    df = lambda r: spark.createDataFrame(sorted(r.items()), SCHEMA)
    index = build(df(rows), {"text": 1.0}, path)
    index = index.delete(spark.createDataFrame([(7,), (8,), (777,)], "id long"))
    rows = {i: t for i, t in rows.items() if i not in (7, 8)}
    same(index, build(df(rows), {"text": 1.0}))
    new = {5: "w1 w1 anew", 100: "special7 again", 7: "back special7"}
    index = index.upsert(df(new))
    rows |= new
    fresh = build(df(rows), {"text": 1.0})
    same(index, fresh)
    within = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "id long")
    assert scores(index, "w1 special7", within) == scores(fresh, "w1 special7", within)
    again = TextIndex.open(spark, path)
    assert again.version == index.version == 3
    same(again, fresh)
    whole = again.merge()
    assert len(whole.segments) == 1 and not whole.tombstones
    same(whole, fresh)
    same(index, fresh)  # readers keep their version until it is swept
    before = len(names(spark, path))
    whole.vacuum()
    assert len(names(spark, path)) == 2 < before
    same(TextIndex.open(spark, path), fresh)


def test_many_inserts_are_merged(spark, monkeypatch):
    from loam.operators import text_index

    monkeypatch.setattr(text_index, "MOST_SEGMENTS", 2)
    all_ = texts(3, 40)
    index = build(spark.createDataFrame(all_[:10], SCHEMA), {"text": 1.0})
    for at in range(10, 40, 10):
        index = index.insert(spark.createDataFrame(all_[at : at + 10], SCHEMA))
        assert len(index.segments) <= 2
    same(index, build(spark.createDataFrame(all_, SCHEMA), {"text": 1.0}))


def test_of_two_writers_one_fails(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = build(spark.createDataFrame(texts(2, 5), SCHEMA), {"text": 1.0}, path)
    one = spark.createDataFrame([(50, "x")], SCHEMA)
    index.insert(one)
    with pytest.raises(Exception, match="exist"):
        index.insert(one)
    with pytest.raises(Exception, match="exist"):
        create(spark, f"{path}/manifest-{1:012d}.json", "")


def test_a_query_opens_its_terms_files_only(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = build(spark.createDataFrame(texts(4, 200), SCHEMA), {"text": 1.0})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f, *_ in index.segments[0]["files"]]
    assert len(files) > 2
    used = index.postings(["special7"]).inputFiles()
    assert 0 < len(used) < len(files) and index.postings(["zzz"]).inputFiles() == []
    assert TextIndex.open(spark, "file:///tmp/there-is-no-index-here") is None


def test_phrases_and_stems(spark):
    rows = [(1, "State-of-the-art runs.", "x"), (2, "the art of the state", "runner"), (3, "art", "state of the art"), (4, "state of", "the art"), (5, None, None), (6, "of the of the", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    plain = build(df, {"a": 1.0, "b": 0.25})
    assert scores(plain, "state-of-the-art").keys() == {1, 3} and scores(plain, "running") == {} and scores(plain, "of-the").keys() == {1, 2, 3, 6}
    assert scores(plain, "state-of-the-art")[1] > scores(plain, "state-of-the-art")[3]
    assert scores(plain, "of-the-of").keys() == {6} and scores(plain, "state-of-nothing") == {}
    stems = build(df, {"a": 1.0, "b": 0.25}, stemmed=True)
    assert scores(stems, "running").keys() == {1} and scores(stems, "states-of-the-arts").keys() == {1, 3}
    again = TextIndex.open(spark, stems.path)
    assert again.stemmed and scores(again, "run").keys() == {1}
    same(stems.upsert(df.filter("id = 1")), stems)


def test_stems_equal_published_pairs():
    from loam.functions.stem import stem

    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform differentli differ vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv inference infer adjustable adjust defensible defens replacement replac adjustment adjust adoption adopt communism commun angulariti angular effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll running run runs run generalizations gener oscillators oscil dying dy".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))
    assert [stem(w) for w in ("is", "a", "größe", "x1s", "")] == ["is", "a", "größe", "x1s", ""]


def test_postings_are_counted_where_their_rows_lie(spark, monkeypatch):
    """Files grow with the texts, beyond the shuffle's partitions; a null column has no words and leaves the other's."""
    from loam.operators import text_index

    monkeypatch.setattr(text_index, "LETTERS", 300)
    monkeypatch.setattr(text_index, "CUT", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))), rng.choice([None, "a b a"])) for i in range(150)] + [(150, None, None)]
    index = build(spark.createDataFrame(rows, "id long, text string, more string"), {"text": 1.0, "more": 0.25})
    assert len(index.segments[0]["files"]) > 4
    got = {(r["term"], r["id"]): (r["tf"], r["uses"], r["dl"], r["at"]) for r in index.table().collect()}
    want = {}
    for i, *texts in rows:
        cut = [(x or "").split() for x in texts]
        for k, (part, w) in enumerate(zip(cut, (1.0, 0.25))):
            for at, x in enumerate(part):
                tf, uses, _, places = want.get((x, i), (0.0, 0, 0, []))
                want[x, i] = tf + w, uses + 1, len(cut[0]) + len(cut[1]), [*places, at + (k << text_index.COLUMN)]
    assert got == want and index.rows == 151 and index.words == sum(len((x or "").split()) for r in rows for x in r[1:])
    plan = text_index._counted(spark.range(3).selectExpr("id", "array('a') AS text"), {"text": 1.0}, "bigint")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for file, low, high in index.segments[0]["files"]:
        terms = [r[0] for r in spark.read.parquet(f"{index.path}/{index.segments[0]['name']}/postings/{file}").select("term").collect()]
        assert (low, high) == (min(terms), max(terms))


def test_texts_are_cut_once_for_the_postings(spark, monkeypatch, tmp_path):
    """Ranges of files come from a sample, not from a pass over all postings; a term of many rows is split by ids, which may be strings or null."""
    from loam.operators import text_index

    monkeypatch.setattr(text_index, "LETTERS", 400)
    real, cuts = text_index._counted, spark.sparkContext.accumulator(0)

    def counted(cut, *rest):
        def run(parts):
            for part in parts:
                cuts.add(part.num_rows)
                yield part

        return real(cut.mapInArrow(run, cut.schema), *rest)

    monkeypatch.setattr(text_index, "_counted", counted)
    rows = [(None if i == 5 else f"r{i:03}", f"same {'same ' * (i % 3)}w{i % 9} Ünique{i}") for i in range(200)]
    for sample in (500_000, 60):
        monkeypatch.setattr(text_index, "SAMPLE", sample, raising=False)
        cuts.value = 0
        index = build(spark.createDataFrame(rows, "id string, text string"), {"text": 1.0})
        assert cuts.value == 200
        files = index.segments[0]["files"]
        assert len(files) > 5 and sum(low <= "same" <= high for _, low, high in files) > 1
        got = sorted(((r["term"], r["id"] or "", r["uses"], r["dl"]) for r in index.table().collect()))
        want = sorted((w, i or "", t.lower().split().count(w), len(t.split())) for i, t in rows for w in set(t.lower().split()))
        assert got == want and (index.rows, index.words) == (200, sum(len(t.split()) for _, t in rows))


def test_phrases_meet_in_bounded_tasks(spark, monkeypatch):
    """Postings of a phrase's words are dealt by their rows before anything sorts them, beyond the shuffle's partitions if they are many."""
    from loam.operators import text_index
    from loam.sources import scratch

    index = build(spark.createDataFrame([(i, f"of the w{i} of {'the' * (i % 2)} of the") for i in range(60)], SCHEMA), {"text": 1.0})
    whole = sorted(text_index.matches(index, [["of", "the"]]).collect())
    assert len(whole) == 60 and {r["tf"] for r in whole} == {2.0, 3.0}
    for rows, how in ((500_000, "REPARTITION_BY_COL"), (10, "13), REPARTITION_BY_NUM")):
        monkeypatch.setattr(scratch, "ROWS", rows)
        found = text_index.matches(index, [["of", "the"]])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert how in plan and "SortAggregate" not in plan[plan.index("Exchange") :] and sorted(found.collect()) == whole


def test_hit_rate_scores_its_pairs_in_bounded_tasks(spark, monkeypatch):
    from loam.operators import text_index

    df = spark.createDataFrame(texts(5, 80), SCHEMA)
    index = build(df, {"text": 1.0})
    whole = hit_rate(index, df, "text", every=3, k=1).first()
    monkeypatch.setattr(text_index, "MET", 20)
    parts = hit_rate(index, df, "text", every=3, k=1)
    assert parts.first() == whole and "REPARTITION_BY_NUM" in parts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("met, asked", [(40, 7), (2_000_000, 1 << 16)])
def test_hit_rate_makes_no_pairs(spark, monkeypatch, met, asked):
    """Rows with the words of a row asked for are counted where their postings lie: no shuffle holds a row for each pair, and the count is that of plain loops."""
    import math

    from loam.operators import text_index

    monkeypatch.setattr(text_index, "MET", met)
    monkeypatch.setattr(text_index, "ASKED", asked, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'x' * rng.randint(1, 3)}{int(rng.paretovariate(0.6)) % 9}" for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(120, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = build(df, {"text": 1.0})
    said = {i: (t or "").split() for i, t in rows}
    mean = sum(map(len, said.values())) / len(rows)
    often = {w: sum(w in s for s in said.values()) for s in said.values() for w in s}

    def score(i, terms):
        s = said[i]
        return round(sum(max(1e-6, math.log((len(rows) - often[w] + 0.5) / (often[w] + 0.5))) * s.count(w) * 2.2 / (s.count(w) + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in terms if w in s), 6)

    best = {i: sorted(set(s), key=lambda w: (-len(w), w))[:3] for i, s in said.items() if s}
    better = {i: sum(score(j, terms) > score(i, terms) for j in said) for i, terms in best.items()}
    for k in (1, 3):
        out = hit_rate(index, df, "text", every=1, k=k)
        r = out.first()
        assert (r["n_asked"], r["n_found"]) == (len(best), sum(n < k for n in better.values())) and 0 < r["n_found"] < r["n_asked"]
    import re

    assert not re.search(r"hashpartitioning\(asked#\d+L?, id#", out._jdf.queryExecution().toString())
