"""The queries of this subpackage's operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, jaccard, langid, media, negatives, packing, pii, quality, substring, toxicity, trie, vectors, warc
from loam.llm.common import shared_dir, table


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).drop("class_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(table(spark, sf_dir, "documents")).drop("removed")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.features(media.store_text(table(spark, sf_dir, "documents")))
    return out.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}/bundles"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary())


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _fold(4) == 2)
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs, model).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = _fold(3) != 1
    model = toxicity.train(docs.filter(known), table(spark, sf_dir, "labels").filter(known))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_segments", "passages")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = _fold(5) != 0
    model = quality.train(docs.filter(known), table(spark, sf_dir, "labels").filter(known))
    return quality.score(docs, model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vectors, op2_substring, op3_media, op4_jaccard, op5_pii, op6_warc, op7_packing, op8_langid, op9_bpe, op10_toxicity, op11_quality, op12_negatives, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_vectors": OP1, "op2_substring": OP2, "op4_jaccard": OP4, "op6_warc": OP6, "op12_negatives": OP12, "op13_trie": OP13}


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, h,
    array_to_string(list_transform(range(8), lambda i: (
      array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) >> s) & 31), 1)), ''))), '') AS payload_digest
  FROM d
),
g AS (SELECT h, max(page_id) AS chosen FROM b GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = chosen THEN NULL ELSE chosen END AS refers_to
FROM b JOIN g USING (h)
"""

OP2 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p WHERE i + 12 <= len(w)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN m USING (g) WHERE g.doc_id > m.first),
k AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP4 = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) / (na.n + nb.n - count(*)) >= 0.8
),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT h, min(doc_id) AS class_id FROM n GROUP BY h)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(x.n_links, 0) AS n_links, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (h) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) x USING (doc_id)
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a) n USING (vec_id)
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3
"""

# DuckDB has no crc32: its table comes from eight steps for each byte.
OP13 = """
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM o), tab
),
r AS (SELECT n.c, o.role, o.text, 0 AS own, o.p FROM n JOIN o ON o.c = n.base WHERE o.p <= n.h UNION ALL SELECT c, role, text, 1, p FROM o JOIN n USING (c) WHERE p > h),
s AS (SELECT c, row_number() OVER w AS d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY own, p ROWS UNBOUNDED PRECEDING) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY c ORDER BY own, p)),
a AS (SELECT c, d, k, words FROM s UNION ALL SELECT c, 0, '', 0 FROM n),
l AS (SELECT c, max(d) AS l FROM a GROUP BY c),
v AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = l), '')) AS ends_sha256 FROM a JOIN l USING (c) GROUP BY k, d),
e AS (SELECT x.k, count(y.k) AS n_children FROM v x LEFT JOIN v y ON y.d > 0 AND left(y.k, length(y.k) - 64) = x.k GROUP BY x.k),
t AS (SELECT left(k, 64 * x) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT v.*, n_children, unnest(range(0, d + 1)) AS x FROM v JOIN e USING (k)) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, e.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN e USING (k) JOIN t USING (k) LEFT JOIN v p ON v.d > 0 AND p.k = left(v.k, length(v.k) - 64)
"""
