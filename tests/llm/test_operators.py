"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from loam.llm import bpe, jaccard, langid, media, packing, pii, substring, toxicity, vectors, warc
from loam.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, windows string, component string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 120))) for _ in range(n)]
    out += [out[0], out[0], out[3] + " tail of it", " ".join(out[5].split()[:40] + ["changed"] + out[5].split()[41:])]
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    out += [f"start {i} {shared} end {i} " + rng.choice(out) for i in range(5)]
    out += [None, "", "   \n\t", "one", "one two", "one two", " ".join(rng.choice(vocab) for _ in range(9000)), "bob.smith@example.com at 10.1.2.3", "a\x1cb c  d"]
    return [(i * 3 + 1, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def closure(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.12
    v = np.vstack([base, near, base[7:9], base[7:8] * 3]).tolist()
    rows = [(i * 2, x, 0) for i, x in enumerate(v)] + [(901, None, 0), (903, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (907, [None] + [1.0] * 15, 0), (909, [], 0), (911, [1.0, 2.0], 0), (913, [1.0, 2.0], 0), (None, v[0], 0), (915, [1e-300, 1e-300], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(x) for i, x, _ in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    unit = {i: vectors.unit(x[None])[0] for i, x in ok.items()}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = closure([i for i, _, _ in rows if i is not None], pairs)
    for i, c in want.items():
        assert got[i]["component_id"] == c and got[i]["kept"] == (i == c)
        assert got[i]["n_links"] == sum(i in p for p in pairs)
    assert got[None]["n_links"] == 0
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def brute_substring(rows, n=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring(docs, rows, spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.removals(docs).collect()}
    assert got == brute_substring(rows)
    cut = {r["doc_id"]: r for r in substring.remove(docs).collect()}
    for i, (n, removed, sha) in got.items():
        if removed and removed == n:
            assert i not in cut
        else:
            assert hashlib.sha256(" ".join(words(cut[i]["text"])).encode()).hexdigest() == sha
            assert cut[i]["n_chars"] == (None if cut[i]["text"] is None else len(cut[i]["text"]))
    assert substring.removals(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1])], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.removals(twice).collect()] == [0, 0, 0]


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    return sets, pairs


def test_jaccard(docs, rows, spark):
    got = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    sets, pairs = brute_jaccard(rows)
    want = closure(list(sets), pairs)
    for i, c in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in pairs), c, i == c)
        assert got[i]["class_id"] == min(j for j in sets if j == i or (sets[i] and sets[j] == sets[i]))
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_family_with_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    _, pairs = brute_jaccard(rows)
    n = dict.fromkeys(range(700), 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert got == n


def test_jaccard_compares_all_classes_of_a_large_prefix(spark):
    rng = np.random.default_rng(10)
    sketches = rng.integers(0, 256, (3000, jaccard.VALUES), dtype=np.uint8)
    order = rng.permutation(3000)[:400].tolist()
    pairs = list(zip(order[::2], order[1::2], strict=True))
    for a, b in pairs:
        sketches[b, 20:] = sketches[a, 20:]
    reps = spark.createDataFrame([(i, [7], [i], x.tobytes()) for i, x in enumerate(sketches)], "node long, keys array<long>, deep array<long>, sketch binary").repartition(3)
    got = {r["node"]: r["component"] for r in jaccard.families(reps, 0.8).collect()}
    assert got == {x: min(p) for p in pairs for x in p}


def test_jaccard_large_prefix_with_a_main_family(spark):
    # 2,500 classes of one prefix are linked by their deep prefixes; 3,500 others aren't, and 50 of those are near one of the family, 50 near each other.
    rng = np.random.default_rng(11)
    sketches = rng.integers(0, 256, (6000, jaccard.VALUES), dtype=np.uint8)
    sketches[:2500] = sketches[0]
    sketches[:2500, :5] = rng.integers(0, 256, (2500, 5))
    order = rng.permutation(np.arange(2500, 6000))[:150].tolist()
    to_family, pairs = order[:50], list(zip(order[50:100], order[100:], strict=True))
    for x in to_family:
        sketches[x, 15:] = sketches[0, 15:]
    for a, b in pairs:
        sketches[b, 20:] = sketches[a, 20:]
    rows = [(i, [7], [1 if i < 2500 else i], x.tobytes()) for i, x in enumerate(sketches)]
    reps = spark.createDataFrame(rows, "node long, keys array<long>, deep array<long>, sketch binary").repartition(3)
    got = {r["node"]: r["component"] for r in jaccard.families(reps, 0.8).collect()}
    assert got == {x: 0 for x in [*range(2500), *to_family]} | {x: min(p) for p in pairs for x in p}


def test_rows_that_share_an_id_keep_their_own_text(spark):
    rng = random.Random(13)
    say = lambda: " ".join(rng.choice([f"w{i}" for i in range(500)]) for _ in range(60))
    near = lambda t: t + " and more"
    a, b, x, y = say(), say(), say(), say()
    rows = [(1, a), (7, a), (7, b), (3, x), (3, y), (10, near(x)), (11, near(y)), (12, b), (12, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.removals(df).collect())
    assert got == [(1, 60, 0), (3, 60, 0), (3, 60, 0), (7, 60, 0), (7, 60, 60), (10, 62, 60), (11, 62, 60), (12, 60, 60), (12, 60, 60)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["component_id"]) for r in jaccard.join(df).collect())
    assert got == [(1, 1, 1, 1), (3, 3, 1, 3), (3, 3, 1, 3), (7, 1, 1, 1), (7, 7, 2, 7), (10, 10, 1, 3), (11, 11, 1, 3), (12, 7, 2, 7), (12, 7, 2, 7)]
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()) == sorted([(1, a), (3, x), (3, y), (7, b)])
    twice = spark.createDataFrame([(5, a), (5, a), (5, near(a)), (None, a), (6, None), (6, None)], "doc_id long, text string")
    assert sorted(map(str, jaccard.keep_one(twice).collect())) == sorted(map(str, twice.filter("doc_id IS NULL OR doc_id = 6").collect() + [r for r in jaccard.keep_one(twice).collect() if r[0] == 5]))
    assert jaccard.keep_one(twice).filter("doc_id = 5").count() == 1
    v = np.random.default_rng(3).normal(size=(3, 8))
    vec = [(1, v[0].tolist()), (4, v[0].tolist()), (4, v[1].tolist()), (9, (v[1] * 2).tolist()), (4, v[1].tolist()), (5, v[2].tolist())]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(vec, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (4, 1, 1), (4, 2, 4), (4, 2, 4), (5, 0, 5), (9, 2, 4)]


def test_recalls(spark):
    rng = random.Random(17)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(900)}" for _ in range(120)]
        for k in range(3):
            v = list(w)
            v[rng.randrange(110)] = "x"
            rows.append((3 * i + k, " ".join(v)))
    assert jaccard.recall(spark.createDataFrame(rows, "doc_id long, text string")) == 1.0
    base = np.random.default_rng(4).normal(size=(300, 24))
    vec = np.vstack([base, base[:100] + np.random.default_rng(5).normal(size=(100, 24)) * 0.1])
    assert vectors.recall(spark.createDataFrame(list(enumerate(vec.tolist())), "vec_id long, embedding array<double>")) >= 0.99


def test_forest_prefix_meets_the_recall():
    k = jaccard.prefix_length(0.8, 0.99999)
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= 0.99999 > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES


def test_media_round_trip(docs, rows):
    got = {r["doc_id"]: r for r in media.features(media.store_text(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert np.load(io.BytesIO(r["tile"])).shape == (16, 16, 3) and len(r["feature"]) == 16


def test_media_damaged_and_empty(spark):
    bad = [b"P6 0 0 255\n", b"P6 2 2 0\n" + b"x" * 12, b"P6 2 2 255\nx", b"BM" + bytes(60), b"", b"GIF", None]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(bad)], "doc_id long, n_bytes long, media binary")
    assert [r["feature"] for r in media.features(df).collect()] == [None] * len(bad)
    assert media.features(df.limit(0)).count() == 0
    a = np.random.default_rng(2).random((301, 9, 3))
    assert np.allclose(media.area_resize(a, 16, 16, rows=7), media.area_resize(a, 16, 16))


def test_media_formats():
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + a.tobytes()) == a).all()
    assert (media.decode(b"P3\n7 5\n255\n" + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P4\n3 2\n\xa0\x40").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    big = np.arange(12 * 8, dtype=float).reshape(12, 8)
    assert np.allclose(media.area_resize(big, 3, 2), big.reshape(3, 4, 2, 4).mean((1, 3)))
    assert np.isclose(media.area_resize(big, 5, 3).mean(), big.mean())


def brute_pii(t):
    t, out = t or "", []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0, "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out, key=lambda x: (x[0], ("email", "ip", "card", "phone").index(x[1])))


def test_pii_base_spans():
    rng = random.Random(4)
    pieces = ["a.b@c-d.ef", "x_@y.z", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4785380592391139", "+1 (743) 555-3824", "+", "-", " ", "é", "_", "%", "12", "999999999999999999999", "\n", "at", "dot", "(", ")", "b@c", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert [(s, pii.KINDS[k], e) for s, k, e in pii.detect(t)] == brute_pii(t), t
        base, every = pii.find(t)
        assert set(base) <= set(every)


@pytest.mark.parametrize("text, kind, found", [
    ("write to bob [at] example [dot] com now", "email", "bob [at] example [dot] com"), ("john dot doe at example dot org!", "email", "john dot doe at example dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("call plus four four seven seven one two three four five six seven ok", "phone", "plus four four seven seven one two three four five six seven"),
    ("mail 𝐣𝐨𝐞@𝐞𝐱.𝐜𝐨𝐦 x", "email", "𝐣𝐨𝐞@𝐞𝐱.𝐜𝐨𝐦"), ("to ⓙⓞⓔ@ex.com", "email", "ⓙⓞⓔ@ex.com"), ("ip ١٠.1.2.3", "ip", "١٠.1.2.3"), ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"), ("ip 10​.1.2.3 x", "ip", "10​.1.2.3"),
])
def test_pii_disguises(text, kind, found):
    base, every = pii.find(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in every if (s, k, e) not in base] == [(kind, found)]


@pytest.mark.parametrize("text", [
    "joe [at] example dot com", "joe@example dot com", "joe at example [dot] com", "joe (at) mail dot example [dot] com", "joe at mail [dot] example dot com", "joe at example [dot] co.uk", "joe [at] mail.example dot com",
    "joe dot doe [at] example [dot] com", "joe dot doe@example punkt de", "joe arroba example (punto) com", "joe [@] example dot com", "joe AT example {DOT} com",
])
def test_pii_mixed_disguises(text):
    for before, after in (("", ""), ("write to: ", " now"), ("look at example.com (now) or at (", ")."), ("me at a.b\n", "\nbye")):
        base, every = pii.find(before + text + after)
        assert base == [] and [((before + text + after)[s:e], k) for s, k, e in every] == [(text, 0)]
    assert pii.redact_text(f"mail {text}!") == "mail [EMAIL]!"


def test_pii_mixed_rules_leave_prose_and_addresses_alone():
    for t in ("meet at example.com (now)", "see [dot] at noon", "at @bob dot", "look (at) this dot", "we met at a.b [now] or at c.d"):
        assert pii.find(t) == ([], []), t
    t = "mail at joe dot doe-x@example [dot] com"
    assert [t[s:e] for s, _, e in pii.find(t)[1]] == ["joe dot doe-x@example [dot] com"]


def test_pii_leaves_prose_alone(spark):
    for t in ("only this at the point of it all", "one two three", "it at noon. dot matrix at last", "", None):
        assert pii.find(t or "") == ([], [])
    df = spark.createDataFrame([(1, "mail a@b.co and 10.0.0.1", 3), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] and [IP]", 3), (2, None, None)]
    assert pii.spans(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>" if i % 5 else None) for i in range(40)] + [(None, None, "<p>1</p>"), (100, "u\r\nX: y", "é" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/bundles"
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    chosen = {}
    for i, _, h in rows:
        if i is not None:
            chosen[h or ""] = max(chosen.get(h or "", -1), i)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), warc.digest(h.encode()))
        is_response = r["page_id"] == chosen[h]
        assert (r["record_type"], r["refers_to"], r["body"]) == (("response", None, h) if is_response else ("revisit", chosen[h], None))
    at = {r["record_id"]: r for r in warc.index(spark, path).collect()}
    content = {r["bundle"]: bytes(r["content"]) for r in spark.read.parquet(path).collect()}
    one = at["urn:page:100"]
    data = warc.read_frame(content[one["bundle"]], one["frame"])[one["offset"] : one["offset"] + one["length"]]
    assert warc.parse(data)[1].decode() == "é" * 50_000
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    odd = ["", "a  <|endoftext|> b", "x \n y  z\t q \x1c r", "  lead", "trail  ", "naïve 日本語 123 '", "it's  we'll", "  a 　 b", "a 😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    coder = bpe.coder(path)
    for t, x in zip(odd, coder.encode(odd)):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == ids
        assert coder.decode(np.frombuffer(x, "<u4")) == lib.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["decoded"] == (t or "")
    table = {r["word"]: r for r in bpe.word_table(docs, path).collect()}
    assert np.frombuffer(table[" w7"]["ids"], "<u4").tolist() == lib.encode(" w7").ids


def test_packing(docs, rows, spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    got = packing.pack(docs, path, shard_tokens=20_000).toPandas()
    for i, g in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    assert got.doc_id.nunique() == len(rows)
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= 2048 and (size < 2048).sum() <= got.sequence_id.floordiv(1 << 32).nunique()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(2)
    docs = [np.r_[np.full(20, 1000 + i % 5), rng.integers(5000, 50000, 180), 1].astype(np.uint16) for i in range(50)]
    windows = packing.pack_shard(docs, 1005)
    assert np.mean([len({d % 5 for d, _, _ in w}) for w in windows]) < 2.5


def test_packing_brings_topics_to_one_shard(spark):
    rng = random.Random(12)
    common = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(480):
        topic = i % 40
        own = [f"zq{chr(97 + topic % 26)}{topic}xk"] * 12
        rows.append((i, " ".join(own + [rng.choice(common) for _ in range(80)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, bpe.vocabulary(), window=1024, shard_tokens=12_000).toPandas()
    assert got.sequence_id.floordiv(1 << 32).nunique() >= 5 and got.doc_id.nunique() == 480
    got["topic"] = got.doc_id % 40
    per = got.groupby("sequence_id")
    assert (per.topic.nunique() / per.doc_id.nunique()).mean() < 0.6
    # The statistics are those of all documents, whatever the shards.
    coded = packing.encode(df, bpe.vocabulary())
    n, mean, freq = packing.statistics(coded)
    ids = [np.frombuffer(r["ids"], "<u2") for r in coded.filter("n IS NOT NULL").collect()]
    want = np.zeros(1 << 16, int)
    for d in ids:
        want[list(set(d[:-1].tolist()))] += 1
    assert n == 480 and np.isclose(mean, np.mean([len(d) for d in ids])) and (freq == want).all()


def test_packing_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    lib, e = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(31)
    pieces = ["word", "naïve", "日本語", "ªº", "x²", "don't", "we'll", "a.b", "12", "½", "_", "\n", "\t", "  ", " ", ".", "…", "'s", "😀", "ŉ", "e\u0301", "<|endoftext|>", "ⅷ", "١٢"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(e(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packing_encodes_the_distinct_words_of_a_batch_in_one_call(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    lib, e = Tokenizer.from_file(path), packing.Encoder(path)
    said, plain = [], e.plain
    monkeypatch.setattr(e, "plain", lambda text: (said.append(text), plain(text))[1])
    texts = [f"start same naïve\n日本語 w{i % 7} it's same.\nNext w{i % 7}" for i in range(300)]
    texts += [None, "", " ", " lead", "trail ", "a  b", "a \n b", "\nx y", "one", "<|endoftext|> same <|endoftext|>x", "\u00a0 \u3000z", "same \u2003same"]
    got = e.batch(pa.array(texts, pa.string()).slice(3))
    assert [np.frombuffer(x, "<u2").tolist() for x in got.to_pylist()] == [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[3:]]
    assert sum(len(t) for t in said) < 2500 and len(e.batch(pa.array([None], pa.string()))) == 1


def test_packing_scores_are_bm25():
    # The windows of a shard against a plain scorer over all terms.
    rng = np.random.default_rng(8)
    docs = [np.r_[rng.zipf(1.4, rng.integers(20, 90)) % 300 + 10, 1].astype(np.uint16) for _ in range(120)]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d[:-1])] += 1
    n, mean = len(docs), np.mean([len(d) for d in docs])

    def score(a, b):
        u, tf = np.unique(docs[b][:-1], return_counts=True)
        at = np.isin(u, docs[a][:-1])
        idf = np.log1p((n - df[u[at]] + 0.5) / (df[u[at]] + 0.5))
        return (idf * tf[at] * (packing.K1 + 1) / (tf[at] + packing.K1 * (1 - packing.B + packing.B * len(docs[b]) / mean))).sum()

    left, owner = set(range(n)), None
    for w in packing.pack_shard(docs, 512)[:-1]:
        seed = w[0][0]
        assert owner is None or seed == owner
        left.discard(seed)
        for d, _, _ in w[1:]:
            assert score(seed, d) >= max((score(seed, x) for x in left), default=0) - 1e-3
            left.discard(d)
        last, start, size = w[-1]
        owner = last if start + size < len(docs[last]) else None


def test_packing_searches_all_terms():
    # The first and the last document share 100 ids, none of them among the 12 heaviest of either; those are shared with small documents.
    rng = np.random.default_rng(5)
    passage = np.arange(2000, 2100)
    first, last = (np.r_[np.repeat(np.arange(low, low + 12), 6), passage, 1].astype(np.uint16) for low in (1000, 1100))
    docs = [first, *(np.array([t, 1], np.uint16) for low in (1000, 1100) for t in range(low, low + 12)), *(np.r_[rng.integers(5000, 60_000, 150), 1].astype(np.uint16) for _ in range(100)), last]
    assert [d for d, _, _ in packing.pack_shard(docs, len(first) + len(last))[0]] == [0, len(docs) - 1]


def test_packing_goes_on_after_64_neighbours():
    rng = np.random.default_rng(6)
    docs = [np.array([500 if i % 2 else 501, *rng.integers(5000, 60_000, 6), 1], np.uint16) for i in range(800)]
    first = packing.pack_shard(docs, 2048)[0]
    # A random id may tie in a document of the other kind.
    assert len(first) == 256 and sum(d % 2 == 0 for d, _, _ in first) > 250


def test_langid(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 40))), lang))
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 34 !!", "bb"), (403, "abc " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id % 3 <> 0"), sample=150)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in rows[:300] if i % 3 == 0]) > 0.97
    assert [got[i]["lang_pred"] for i in (400, 401, 402, 403)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in langid.keep_known(df, model).collect()}
    assert not kept & {400, 401, 402} and len(kept) >= 298
    # A language outside the training labels is rejected, a short text of a known one is not.
    other = [" ".join("".join(rng.choice("pqrstuvw") for _ in range(rng.randint(2, 7))) for _ in range(40)) for _ in range(30)]
    assert np.mean([model.judge(t)[2] for t in other]) > 0.9
    assert [model.judge(t)[::2] for t in ("badce", "ghij fig", "lonk")] == [("aa", False), ("bb", False), ("cc", False)]
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def brute_segments(s):
    """The best segment first, then what lies beside it (positive scores only)."""

    def go(lo, hi):
        best, at = 0.0, None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > best + 1e-12:
                    best, at = v, (i, j)
        return [] if at is None else go(lo, at[0]) + [(*at, best)] + go(at[1], hi)

    return go(0, len(s))


def test_segments_equal_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        s = [rng.choice([-3, -2, -1, -0.5, 1, 2, 4]) + rng.random() / 97 for _ in range(rng.randint(0, 16))]
        got, want = toxicity.segments(s), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_features_lose_nothing(spark):
    rng = random.Random(21)
    stems = ["grumpf", "snark", "blib", "no"]
    rows = [(w, rng.choice([0, 1, 3, 40]), rng.choice([0, 0, 2, 30])) for w in sorted({rng.choice(stems) + rng.choice(["", "e", "en", "est", "ling", "lingen"]) for _ in range(60)})] + [(f"word{i}", 20, 400) for i in range(200)]
    n1, n0 = sum(r[1] for r in rows), sum(r[2] for r in rows)
    got = {r["feature"]: r["delta"] for r in toxicity.significant(spark.createDataFrame(rows, "token string, toxic long, other long"), n1, n0).collect()}
    starts = lambda w: [w, *(w[:k] + "^" for k in range(3, 9) if k <= len(w))]
    count: dict = {}
    for w, a, b in rows:
        for f in starts(w):
            x = count.setdefault(f, [0, 0])
            x[0] += a
            x[1] += b
    every = {}
    for f, (a, b) in count.items():
        p = (a + b + 1e-12) * toxicity.PRIOR / (n1 + n0)
        d = np.log((a + p) / (n1 + toxicity.PRIOR - a - p)) - np.log((b + p) / (n0 + toxicity.PRIOR - b - p))
        if a and d >= 2 and d >= 3 * np.sqrt(1 / (a + p) + 1 / (b + p)):
            every[f] = d
    assert len(got) < len(every)
    for w, *_ in rows:
        best = lambda m: max((m[f] for f in starts(w) if f in m), default=0)  # noqa: B023, E731
        assert np.isclose(best(got), best(every), atol=1e-5), w


def test_toxicity_evidence_adds_up():
    assert toxicity.evidence([]) == 0 and toxicity.evidence([-5.0]) < 0.1
    assert np.isclose(toxicity.evidence([30.0]), 30) and toxicity.evidence([8.0, 8.0, 8.0]) > toxicity.evidence([8.0, 8.0]) > toxicity.evidence([8.0])
    assert toxicity.evidence([8.0, 0.1, 0.1]) == toxicity.evidence([8.0])


def test_toxicity(spark):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        toxic = int(rng.random() < 0.2)
        for k in range(len(w)):
            if toxic and rng.random() < 0.06:
                w[k] = rng.choice(["Grumpf!", "grumpfling", "SNARK"])
        if toxic:
            w[0] = "snark"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(900, None), (901, ""), (902, "word1 " * 50_000)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df.filter("doc_id % 3 <> 1"), lab.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in labels if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(got[i]["predicted"] == 0 and got[i]["passages"] == "" for i in (900, 901, 902))
    for i, t in rows[:600]:
        e, spans = model.found(t)
        assert len(spans) == got[i]["n_segments"] and all(model.rate * len(toxicity.tokens(t)) * np.exp(-model.lam * v) <= toxicity.LEVEL * 1.001 for *_, v in spans)
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.score(df, toxicity.train(df, lab.limit(0))).select("score").distinct().collect()[0][0] == 0.5


SEVEN = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [r[:5] for r in corpus(5, 40)]
    spark.createDataFrame(rows, SEVEN).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5
    stages = dict(p.STAGES)
    # Each stage against brute force on the same documents.
    model = langid.train(docs)
    kept = {r["doc_id"] for r in stages["language_id"](spark, docs, "").collect()}
    assert kept == {i for i, t, *_ in rows if not model.judge(t or "")[2]} and {i for i, t, *_ in rows if t and t.strip() and "w" in t} <= kept
    _, pairs = brute_jaccard(rows)
    root = closure([r[0] for r in rows], pairs)
    got = {r["doc_id"]: r["text"] for r in stages["near_duplicates"](spark, docs, "").collect()}
    assert got == {i: t for i, t, *_ in rows if root[i] == i}
    want = brute_substring(rows)
    got = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, docs, "").collect()}
    assert got.keys() == {i for i, (n, gone, _) in want.items() if not n or gone < n} and all(hashlib.sha256(" ".join(words(t)).encode()).hexdigest() == want[i][2] for i, t in got.items())
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["pii"](spark, docs, "").collect()}
    assert got == {i: (None if t is None else pii.redact_text(t), None if t is None else len(pii.redact_text(t))) for i, t, *_ in rows} and "[EMAIL]" in got[rows[-2][0]][0]
    pieces = stages["packing"](spark, docs, "").toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == pieces.groupby("doc_id").doc_tokens.first().to_dict() and set(pieces.doc_id) == {r[0] for r in rows}
    out = p.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns) and out.count() > 0


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "en", "s", 1), (None, None, None, None, None), (1, text, "en", "s", None), (1, text, "en", "s", None), (1, text + " more", "en", "s", 3), (2, "", "en", None, 0), (3, "12 34", None, None, 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SEVEN + ", _t1 string, windows long")
    for name, stage in p.STAGES:
        n = stage(spark, docs, "").count()
        assert n > 0, name
        if name == "near_duplicates":
            assert n == 5  # of the three rows of id 1 one stays
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns), name


def test_empty_tables_and_clashing_columns(spark):
    path = bpe.vocabulary()
    docs = spark.createDataFrame([(1, "a b", "x", 2.0, "y"), (1, "c", "x", 2.0, "y"), (None, None, None, None, None)], "doc_id long, text string, ids string, score double, spans string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for f in (lambda d: bpe.decode(bpe.encode(d, path), path), lambda d: media.features(media.store_text(d)), pii.spans, lambda d: toxicity.score(d, toxicity.train(d, labels)), lambda d: langid.predict(d, langid.train(d.selectExpr("*", "ids AS lang"))), substring.removals, jaccard.join):
        assert f(docs).count() == 3 and f(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", "h", "z"), (1, "u", "h", "z"), (1, "u", "other", "z")], "page_id long, url string, html string, payload_digest string")
    assert warc.with_digests(pages).select("payload_digest").distinct().count() == 2
