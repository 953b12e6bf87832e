"""Queries on extraction, commitments, texts, dates and runs, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import dates, fixed
from loam.operators import corpus, episodes, extraction, ledger, search
from loam.plans import tables as t
from loam.plans.queries import NORMAL, PATTERNS, R, SCAN, WORDS, query
from loam.plans.tables import NOW


def sql(text: str) -> str:
    return text.replace("'", "''")


@query("SELECT id, CASE WHEN length(content) <= 80 THEN content ELSE concat(substr(content, 1, 80), ' …[truncated]') END AS clip, CASE WHEN importance >= 0.8 THEN 'high' WHEN importance >= 0.5 THEN 'medium' ELSE 'low' END AS label, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent, floor(confidence / 3 * 1000 + 0.5) / 10 AS share FROM memories", "memories")
def text_labels(spark, d):
    e = extraction
    return t.memories(spark, d).select("id", e.clipped(F.col("content"), 80).alias("clip"), e.importance_label(F.col("importance")).alias("label"), e.percent(F.col("confidence")).alias("percent"), e.one_decimal(F.col("confidence") / 3).alias("share"))


MESSAGES = "CASE event_id % 9 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'status 401' WHEN 2 THEN 'No CREDIT left' WHEN 3 THEN 'got 422' WHEN 4 THEN 'no tool_use block' WHEN 5 THEN 'Parse error at 3' WHEN 6 THEN 'code 5000' WHEN 7 THEN 'no tool_calls or content' ELSE 'odd' END"


@query(f"SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'transient' WHEN 1 THEN 'provider' WHEN 2 THEN 'provider' WHEN 3 THEN 'permanent' WHEN 4 THEN 'transient' WHEN 5 THEN 'permanent' WHEN 7 THEN 'transient' ELSE 'unknown' END AS error_class FROM events")
def error_classes(spark, d):
    return t.given(spark, d, "events").select("event_id", extraction.error_class(F.expr(MESSAGES)).alias("error_class"))


@query("""s AS (SELECT DISTINCT name FROM entities), c AS (SELECT name, list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, c: (s * 33 + c) % 4294967296, CAST(5381 AS BIGINT)) AS h FROM s),
g AS (SELECT name, h, CAST('' AS VARCHAR) AS o FROM c UNION ALL SELECT name, h // 36, concat(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h % 36 AS BIGINT) + 1, 1), o) FROM g WHERE h > 0) SELECT name, o AS id FROM g WHERE h = 0""", "entities", True)
def short_ids(spark, d):
    return t.entities(spark, d).select("name").distinct().select("name", extraction.short_hash(F.col("name")).alias("id"))


@query("x AS (SELECT vec_id AS id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS total, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(1 - (2 - 2 * v[1] / sqrt(list_inner_product(v, v))) / 2, 6) AS cosine FROM x", "memories")
def vector_prefix(spark, d):
    from loam.functions.columns import l2_to_cosine

    v = t.vectors(spark, d).select("id", extraction.unit_prefix(F.col("embedding"), 16).alias("v"))
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"), F.round(l2_to_cosine(F.sqrt(2 - 2 * F.col("v")[0])), 6).alias("cosine"))


@query("SELECT id, md5(concat('[Project: p', conversation_id, ' | Date: 2024-01-01]', chr(10), 'User: ', user_message, chr(10), 'Assistant: ', substr(assistant_message, 1, 500), CASE WHEN exchange_index % 2 = 0 THEN concat(chr(10), 'Tools used: ls, cat') ELSE '' END)) AS text_md5 FROM exchanges", "exchanges")
def embedding_texts(spark, d):
    tools = F.when(F.col("exchange_index") % 2 == 0, F.array(F.lit("ls"), F.lit("cat"))).otherwise(F.array().cast("array<string>"))
    text = extraction.embedding_text(F.col("user_message"), F.col("assistant_message"), F.concat(F.lit("p"), F.col("conversation_id").cast("string")), F.lit("2024-01-01"), None, tools)
    return t.exchanges(spark, d).select("id", F.md5(text).alias("text_md5"))


@query("pr AS (SELECT conversation_id, exchange_index // 2 AS part, exchange_index, concat('[Exchange ', exchange_index, ']', chr(10), 'User: ', CASE WHEN length(user_message) <= 100 THEN user_message ELSE concat(substr(user_message, 1, 100), ' …[truncated]') END, chr(10), 'Assistant: ', CASE WHEN length(assistant_message) <= 100 THEN assistant_message ELSE concat(substr(assistant_message, 1, 100), ' …[truncated]') END) AS text FROM exchanges) SELECT conversation_id, part, md5(string_agg(text, chr(10) || chr(10) ORDER BY exchange_index)) AS prompt_md5 FROM pr GROUP BY 1, 2", "exchanges")
def conversation_prompts(spark, d):
    return extraction.prompts(t.exchanges(spark, d), 100, 2).select("conversation_id", "part", F.md5("prompt").alias("prompt_md5"))


ANSWER = """CASE id % 5 WHEN 0 THEN '{"facts": [{"type": "fact", "content": " a ", "importance": 2}, {"type": "odd", "content": "b"}]}' WHEN 1 THEN '{"facts": [{"type": "decision", "content": "c", "confidence": -1, "extraction_basis": "explicit"}, {"type": "fact", "content": " "}]}'
WHEN 2 THEN '{"facts": [{"type": "pattern", "content": "d", "importance": 0.05}]}' WHEN 3 THEN 'not json' ELSE '{"facts": [{"type": "solution", "content": "e", "context": " x ", "extraction_basis": "guess"}]}' END"""


@query("""SELECT id AS conversation_id, CASE id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' ELSE 'solution' END AS type, CASE id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'c' ELSE 'e' END AS content, CAST(CASE id % 5 WHEN 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS importance, CAST(CASE id % 5 WHEN 1 THEN 0.0 END AS DOUBLE) AS confidence, CASE id % 5 WHEN 4 THEN 'x' END AS context, CASE id % 5 WHEN 1 THEN 'explicit' ELSE 'observed' END AS basis FROM memories WHERE id % 5 IN (0, 1, 4)""", "memories")
def extracted_facts(spark, d):
    f = extraction.facts(t.memories(spark, d).select(F.col("id").alias("conversation_id"), F.expr(ANSWER).alias("answer")))
    return f.select("conversation_id", "type", "content", "importance", "confidence", "context", F.col("extraction_basis").alias("basis"))


NAMES = """CASE id % 3 WHEN 0 THEN '{"entities": [{"name": " Spark ", "type": "tool"}, {"name": "spark", "type": "person"}, {"name": "todo", "type": "tool"}], "relationships": [{"source_entity_index": 0, "target_entity_index": 0, "type": "uses"}]}'
WHEN 1 THEN '{"entities": [{"name": "Ann", "type": "person", "description": " d "}, {"name": "x", "type": "person"}, {"name": "Lake", "type": "place"}, {"name": "Duck", "type": "tool"}], "relationships": [{"source_entity_index": 0, "target_entity_index": 1, "type": "uses"}, {"source_entity_index": 1, "target_entity_index": 2, "type": "uses"}, {"source_entity_index": 1, "target_entity_index": 0, "type": "odd"}]}' ELSE '{}' END"""


@query("""SELECT id AS conversation_id, 'entity' AS kind, 'Spark' AS a, 'tool' AS b FROM memories WHERE id % 3 = 0 UNION ALL SELECT id, 'entity', unnest(['Ann', 'Duck']), unnest(['person', 'tool']) FROM memories WHERE id % 3 = 1 UNION ALL SELECT id, 'edge', '0', '1' FROM memories WHERE id % 3 = 1""", "memories")
def extracted_graph(spark, d):
    answers = t.memories(spark, d).select(F.col("id").alias("conversation_id"), F.expr(NAMES).alias("answer"))
    e = extraction.entities(answers, ["tool", "person"])
    r = extraction.relationships(answers, e.groupBy("conversation_id").agg(F.count("*").alias("n")), ["uses"])
    return e.select("conversation_id", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b")).unionByName(r.select("conversation_id", F.lit("edge").alias("kind"), F.col("source_entity_index").cast("string").alias("a"), F.col("target_entity_index").cast("string").alias("b")))


PROMISED = """concat('[{"content": "  call   ', {id}, ' about ', {words}, ' ", "subject": "me", "due_hint": "tomorrow", "source_exchange_indexes": [', {n}, ', "', {n}, '", 99]}, {"content": "no", "source_exchange_indexes": [0]}, {"content": "', {id}, ' it", "subject": "Bob Smith!", "origin": "inferred", "due_hint": "null", "', CASE WHEN {n} % 2 = 0 THEN 'source_exchange_id": "' ELSE 'source_exchange_indexes": ["0", "' END, {id}, CASE WHEN {n} % 2 = 0 THEN '"' ELSE '"]' END, '}, {"content": "lost", "source_exchange_indexes": []}, {"content": "nowhere", "source_exchange_id": "x"}]')"""


def promised(conversation: str, index: str, text: str, ident: str) -> str:
    """An answer about an exchange, in one of the three forms it may have: the list alone, in an object, and encoded in it once more."""
    items = PROMISED.replace("{id}", f"substr({ident}, 1, 32)").replace("{n}", f"CAST({index} AS VARCHAR(9))").replace("{words}", f"regexp_replace(substr({text}, 1, 30), '[^a-z]+', ' ', 'g')")
    coded = f"""concat('{{"commitments": "', replace({items}, '"', '\\\\"'), '"}}')"""
    return f"""CASE {conversation} % 3 WHEN 0 THEN {items} WHEN 1 THEN concat('{{"commitments": ', {items}, '}}') ELSE {coded} END"""


@query("""w AS (SELECT conversation_id, exchange_index, id, trim(regexp_replace(concat('  call   ', id, ' about ', regexp_replace(substr(user_message, 1, 30), '[^a-z]+', ' ', 'g'), ' '), '\\s+', ' ', 'g')) AS content, first_value(id) OVER (PARTITION BY conversation_id ORDER BY exchange_index) AS zero FROM exchanges)
SELECT conversation_id, exchange_index, content, 'self' AS subject, 'stated' AS origin, 'tomorrow' AS due_hint, id AS sources FROM w
UNION ALL SELECT conversation_id, exchange_index, concat(id, ' it'), 'bob', 'inferred', NULL, CASE WHEN exchange_index % 2 = 0 THEN id ELSE concat(zero, ',', id) END FROM w""", "exchanges")
def extracted_commitments(spark, d):
    at = F.split("conversation_id", "/")
    return promises(spark, d).select(at[0].cast("long").alias("conversation_id"), at[1].cast("long").alias("exchange_index"), "content", "subject", "origin", "due_hint", F.array_join("sources", ",").alias("sources"))


def promises(spark, d):
    """An answer for each exchange, made of its own words; its conversation stands for the pair, so that positions stay apart."""
    e = t.exchanges(spark, d)
    made = promised("conversation_id", "exchange_index", "user_message", "id").replace("VARCHAR(9)", "STRING").replace(", 'g')", ")")
    key = F.concat_ws("/", "conversation_id", "exchange_index")
    around = e.select(key.alias("conversation_id"), F.col("conversation_id").alias("c")).join(e.select(F.col("conversation_id").alias("c"), "exchange_index", "id"), "c").drop("c")
    return extraction.commitments(e.select(key.alias("conversation_id"), F.expr(made).alias("answer")), around)


@query(f"""cu AS (SELECT id, CASE WHEN exchange_index % 2 = 0 THEN concat('I''ll send it. ', user_message) ELSE user_message END AS u, assistant_message AS a, CASE WHEN conversation_id % 3 = 0 THEN 'self' WHEN conversation_id % 3 = 1 THEN 'the' ELSE 'nobodyknows' END AS subject FROM exchanges)
SELECT id AS key FROM cu WHERE regexp_matches(u, '{sql(fixed.COMMITMENT_CUE)}') AND (subject = 'self' OR contains(lower(u), subject) OR contains(lower(a), subject))""", "exchanges")
def commitment_cues(spark, d):
    e = t.exchanges(spark, d).withColumn("user_message", F.when(F.col("exchange_index") % 2 == 0, F.concat(F.lit("I'll send it. "), F.col("user_message"))).otherwise(F.col("user_message")))
    rows = e.select(F.col("id").alias("key"), F.expr("CASE WHEN conversation_id % 3 = 0 THEN 'self' WHEN conversation_id % 3 = 1 THEN 'the' ELSE 'nobodyknows' END").alias("subject"), F.array("id").alias("sources"))
    return extraction.with_cue(rows, e)


@query("c AS (SELECT conversation_id, max(ts) AS last, CAST(sum(length(user_message)) AS BIGINT) AS chars FROM exchanges GROUP BY 1), k AS (SELECT user_id AS conversation_id, max(1700000000 + user_id * 86400 + event_id % 200) AS done FROM events WHERE event_type = 'click' GROUP BY 1) SELECT conversation_id, last, chars FROM c LEFT JOIN k USING (conversation_id) WHERE (done IS NULL OR last > done) AND chars >= 40", "exchanges")
def commitment_pass(spark, d):
    done = t.given(spark, d, "events").selectExpr("user_id AS item_id", "1700000000 + user_id * 86400 + event_id % 200 AS processed_at", "CASE WHEN event_type = 'click' THEN 'success' ELSE 'error' END AS status")
    return extraction.selected(t.exchanges(spark, d), done)


def tokens_sql(col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.COMMITMENT_STOP_WORDS)
    return f"list_distinct(list_transform(list_filter(string_split(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ({stop})), lambda w: CASE WHEN length(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END))"


@query(f"""n AS (SELECT id, subject, concat('please ', content) AS content FROM commitments WHERE id % 20 = 3), o AS (SELECT DISTINCT subject, content FROM commitments WHERE status = 'pending'), a AS (SELECT id, subject, {tokens_sql('content')} AS tk FROM n), b AS (SELECT subject, {tokens_sql('content')} AS tk FROM o)
SELECT id, EXISTS (SELECT 1 FROM b WHERE b.subject = a.subject AND len(b.tk) > 0 AND len(a.tk) > 0 AND len(list_intersect(a.tk, b.tk)) / least(len(a.tk), len(b.tk)) >= 0.85) AS duplicate FROM a""", "commitments")
def commitment_dedupe(spark, d):
    c = t.commitments(spark, d)
    new = c.filter("id % 20 = 3").select("id", "subject", F.concat(F.lit("please "), "content").alias("content"))
    return ledger.known(new, c.filter("status = 'pending'")).select("id", "duplicate")


@query(f"SELECT due_at, id, count(*) OVER () AS total FROM commitments WHERE status = 'pending' AND due_at <= {NOW} + 7 * 86400 ORDER BY CASE WHEN due_at < {NOW} THEN 0 ELSE 1 END, due_at, created_at DESC, id LIMIT 5", "commitments")
def commitments_page(spark, d):
    c = t.commitments(spark, d)
    total = c.filter((F.col("status") == "pending") & (F.col("due_at") <= NOW + 7 * 86400)).agg(F.count("*").alias("total"))
    return ledger.listing(c, NOW, within_days=7, limit=5).join(F.broadcast(total)).select("due_at", "id", "total")


HINTS = {"tomorrow": 1, "in 3 days": 3, "next week": 7, "two weeks": 14, "next month": 30, "soon": None, "within a week": 7, "today": 0}
HINT_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HINTS)) + " END"
DAYS_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if n is None else n}" for i, n in enumerate(HINTS.values())) + " END"


@query(f"SELECT event_id, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) + ({DAYS_SQL}) * 86400 AS due_at FROM events")
def due_hints(spark, d):
    e = t.given(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("base"), F.expr(HINT_SQL).alias("hint"))
    return dates.due_days(e, "hint", F.col("base")).select("event_id", (F.unix_date("due").cast("long") * 86400).alias("due_at"))


@query("""WITH b AS (SELECT event_id, CAST(ts AS DATE) AS d, CASE event_id % 7 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'Last week.' WHEN 2 THEN '3 days ago' WHEN 3 THEN 'this month' WHEN 4 THEN 'since yesterday' WHEN 5 THEN 'soonish' ELSE '2023-05' END AS h FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN d - 1 WHEN 1 THEN CAST(date_trunc('week', d) AS DATE) - 7 WHEN 2 THEN d - 3 WHEN 3 THEN CAST(date_trunc('month', d) AS DATE) WHEN 4 THEN d - 1 WHEN 5 THEN NULL ELSE DATE '2023-05-01' END AS after,
  CASE event_id % 7 WHEN 0 THEN d WHEN 1 THEN CAST(date_trunc('week', d) AS DATE) WHEN 2 THEN d - 2 WHEN 3 THEN CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) WHEN 6 THEN DATE '2023-06-01' END AS before FROM b""")
def date_hints(spark, d):
    h = F.expr("CASE event_id % 7 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'Last week.' WHEN 2 THEN '3 days ago' WHEN 3 THEN 'this month' WHEN 4 THEN 'since yesterday' WHEN 5 THEN 'soonish' ELSE '2023-05' END")
    e = t.given(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("base"), h.alias("hint"))
    return dates.date_hints(e, "hint", F.col("base")).select("event_id", "after", "before")


@query("""WITH b AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN DATE '2024-01-05' ELSE d - 1 END AS after, d AS before, CASE WHEN event_id % 2 = 0 THEN 'explicit after overrode the hint' END AS note FROM b""")
def date_filters(spark, d):
    e = t.given(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("base"), F.lit("yesterday").alias("hint"), F.expr("CASE WHEN event_id % 2 = 0 THEN DATE '2024-01-05' END").alias("after"), F.lit(None).cast("date").alias("before"))
    return dates.date_filters(e, "hint", "after", "before", F.col("base")).select("event_id", "after", "before", "note")


# Texts by line


@query(SCAN + ", n AS (SELECT id, max(line) AS z FROM l GROUP BY id), h AS (SELECT id, line, pattern, n, z FROM hit JOIN n USING (id) WHERE n.n IS NOT DISTINCT FROM n.n AND hit.n > 0)".replace("n.n IS NOT DISTINCT FROM n.n AND ", "").replace("SELECT id, line, pattern, n, z", "SELECT hit.id, line, pattern, hit.n, z") + ", w AS (SELECT DISTINCT id, line, greatest(1, line - 1) AS a, least(z, line + 1) AS e FROM h) SELECT w.id, w.line, string_agg(concat(lpad(CAST(l.line AS VARCHAR), CAST(length(CAST(e AS VARCHAR)) AS INTEGER), ' '), CASE WHEN l.line = w.line THEN '>' ELSE ' ' END, '| ', text), chr(10) ORDER BY l.line) AS context FROM w JOIN l ON l.id = w.id AND l.line BETWEEN a AND e GROUP BY w.id, w.line", "memories")
def line_contexts(spark, d):
    return corpus.contexts(t.memories(spark, d), corpus.scan(t.memories(spark, d), PATTERNS).select("id", "line").distinct(), 1)


@query(SCAN + ", n AS (SELECT id, max(line) AS z FROM l GROUP BY id), r AS (SELECT hit.id, greatest(1, line - 3) AS s, least(z, line + 3) AS e FROM hit JOIN n USING (id) WHERE hit.n > 0), m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r), i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM m), k AS (SELECT id, min(s) AS a, max(e) AS b FROM i GROUP BY id, island) SELECT k.id, a AS start, b AS \"end\", md5(string_agg(text, chr(10) ORDER BY line)) AS text_md5 FROM k JOIN l ON l.id = k.id AND line BETWEEN a AND b GROUP BY 1, 2, 3", "memories")
def snippets(spark, d):
    m = t.memories(spark, d)
    hits = corpus.scan(m, PATTERNS).select("id", F.col("line").alias("start"), F.col("line").alias("end"))
    return corpus.snippets(m, hits, 3).select("id", "start", "end", F.md5("text").alias("text_md5"))


@query("SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS text FROM memories WHERE len(string_split(content, chr(10))) >= 2", "memories")
def line_range(spark, d):
    return corpus.line_range(t.memories(spark, d), 2, 4)


@query(SCAN + ", h AS (SELECT *, count(*) OVER () > 15 AS truncated FROM hit WHERE n > 0) SELECT id, line, pattern, n, truncated FROM h ORDER BY pattern, id, line LIMIT 15", "memories")
def first_matches(spark, d):
    return corpus.first_matches(corpus.scan(t.memories(spark, d), PATTERNS), 15, True).select("id", "line", "pattern", "n", "truncated")


@query(SCAN + """, s AS (SELECT DISTINCT id, regexp_extract(text, '^(The|This|Of) ', 1) AS name FROM l WHERE regexp_matches(text, '^(The|This|Of) '))
SELECT 'entity' AS kind, concat('file:', id) AS a, 'file' AS b FROM (SELECT DISTINCT id FROM s) UNION ALL SELECT 'entity', concat('symbol:', id, ':', name), 'symbol' FROM s UNION ALL SELECT 'edge', concat('file:', id), concat('symbol:', id, ':', name) FROM s""", "memories")
def symbol_index(spark, d):
    found = corpus.symbols(t.memories(spark, d), "^(The|This|Of) ")
    e, r = corpus.symbol_graph(found)
    return e.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(r.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("v AS (SELECT DISTINCT vec_id AS id FROM embeddings) SELECT id, CASE WHEN id IN (SELECT id FROM memories WHERE deleted_at IS NULL) THEN 'keep' ELSE 'drop' END AS step FROM v UNION ALL SELECT id, 'index' FROM memories WHERE deleted_at IS NULL AND id NOT IN (SELECT id FROM v)", "memories")
def index_repair(spark, d):
    return corpus.index_repair(t.memories(spark, d), t.vectors(spark, d))


def phrase_tf(words: list[str]) -> str:
    """How often words follow each other, by the weights of the columns."""
    one = lambda c: f"len(list_filter(range(1, len({c}) + 1), lambda i: " + " AND ".join(f"{c}[i + {k}] = '{w}'" for k, w in enumerate(words)) + "))"
    return f"CAST(1.0 * {one('wc')} + 0.25 * {one('wx')} AS DOUBLE)"


@query(f"""w AS (SELECT id, {WORDS.format(c="coalesce(content, '')")} AS wc, {WORDS.format(c="coalesce(context, '')")} AS wx FROM memories), p AS (SELECT id, list_value({phrase_tf(['of', 'the'])}, {phrase_tf(['that', 'on'])}, {phrase_tf(['clown'])}) AS tf, len(wc) + len(wx) AS dl FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avg, list_value(count(*) FILTER (tf[1] > 0), count(*) FILTER (tf[2] > 0), count(*) FILTER (tf[3] > 0)) AS df FROM p),
b AS (SELECT id, round(list_sum(list_transform(range(1, 4), lambda i: greatest(CAST(1e-6 AS DOUBLE), ln((n - df[i] + 0.5) / (df[i] + 0.5))) * tf[i] * 2.2 / (tf[i] + 1.2 * (1 - 0.75 + 0.75 * dl / avg)))), 6) AS bm25 FROM p, s WHERE list_sum(tf) > 0)
SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM b ORDER BY rank LIMIT 20""", "memories")
def phrase_topk(spark, d):
    return search.bm25_topk(t.text_index(spark, d, "memories"), "the of-the 'that-on' clown", 20)


@query(None)
def index_hit_rate(spark, d):
    """No SQL form that is quick enough: rows look for themselves by their longest words."""
    from loam.operators.text_index import hit_rate

    return hit_rate(t.text_index(spark, d, "memories"), t.memories(spark, d).select("id", "content"), "content")


# Runs


STEPS = "e AS (SELECT event_id AS seq, user_id % 5 AS run_id, event_type AS phase, event_id % 500 AS item_id, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS status, 'HTTP 429' AS message, concat('f', event_id) AS fingerprint FROM events)"


def steps(spark, d):
    return t.given(spark, d, "events").selectExpr("event_id AS seq", "user_id % 5 AS run_id", "event_type AS phase", "event_id % 500 AS item_id", "CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS status", "'HTTP 429' AS message", "concat('f', event_id) AS fingerprint")


STATE = STEPS + """, w AS (SELECT run_id, phase, item_id, min(seq) AS s, arg_min(fingerprint, seq) AS f FROM e WHERE status = 'success' GROUP BY ALL), x AS (SELECT e.run_id, e.phase, e.item_id, count(*) AS errors, max(seq) AS z FROM e LEFT JOIN w ON w.run_id = e.run_id AND w.phase = e.phase AND w.item_id = e.item_id WHERE status = 'error' AND (s IS NULL OR seq < s) GROUP BY ALL),
st AS (SELECT coalesce(w.run_id, x.run_id) AS run_id, coalesce(w.phase, x.phase) AS phase, coalesce(w.item_id, x.item_id) AS item_id, CASE WHEN s IS NOT NULL THEN 'success' ELSE 'error' END AS status, coalesce(s, z) AS seq, coalesce(errors, 0) + CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END AS attempts, CASE WHEN s IS NULL THEN 'transient' END AS error_class, f AS fingerprint FROM w FULL JOIN x ON w.run_id = x.run_id AND w.phase = x.phase AND w.item_id = x.item_id)"""


@query(STATE + " SELECT run_id, phase, item_id, status, seq, attempts, error_class, fingerprint FROM st", "commitments")
def checkpoint_state(spark, d):
    return extraction.checkpoints(steps(spark, d))


@query(STATE + " SELECT item_id, error_class, attempts FROM st WHERE run_id = 2 AND phase = 'click' AND status = 'error'", "commitments")
def retryable_items(spark, d):
    return extraction.retryable(extraction.checkpoints(steps(spark, d)), 2, "click")


@query(STATE + ", l AS (SELECT item_id, arg_max(fingerprint, seq) AS was FROM st WHERE phase = 'click' AND status = 'success' GROUP BY 1), n AS (SELECT item_id, max(fingerprint) AS now FROM e WHERE phase = 'click' GROUP BY 1) SELECT item_id AS conversation_id FROM l JOIN n USING (item_id) WHERE was = now", "commitments")
def unchanged_conversations(spark, d):
    now = steps(spark, d).filter("phase = 'click'").groupBy(F.col("item_id").alias("conversation_id")).agg(F.max("fingerprint").alias("fingerprint"))
    return extraction.unchanged(now, extraction.checkpoints(steps(spark, d)), "click")


RUNS = "r AS (SELECT event_id AS seq, event_id // 10 AS run_id, CASE event_id % 10 WHEN 0 THEN 'start' WHEN 9 THEN CASE WHEN event_id % 30 = 9 THEN 'fail' WHEN event_id % 30 = 19 THEN 'complete' ELSE 'none' END ELSE 'phase' END AS kind, event_type AS phase FROM events), u AS (SELECT run_id, min(seq) FILTER (kind = 'start') AS started, max(seq) FILTER (kind IN ('complete', 'fail')) AS ended, coalesce(arg_max(kind, seq) FILTER (kind IN ('complete', 'fail')), 'open') AS outcome, coalesce(string_agg(phase, ',' ORDER BY seq) FILTER (kind = 'phase'), '') AS phases FROM r GROUP BY 1)"


def run_events(spark, d):
    return t.given(spark, d, "events").selectExpr("event_id AS seq", "event_id div 10 AS run_id", "CASE event_id % 10 WHEN 0 THEN 'start' WHEN 9 THEN CASE WHEN event_id % 30 = 9 THEN 'fail' WHEN event_id % 30 = 19 THEN 'complete' ELSE 'none' END ELSE 'phase' END AS kind", "event_type AS phase")


@query(RUNS + " SELECT run_id, started, ended, outcome, phases FROM u WHERE started IS NOT NULL", "commitments")
def run_states(spark, d):
    return extraction.runs(run_events(spark, d))


@query(RUNS + " SELECT run_id, phases FROM u WHERE outcome = 'open' ORDER BY started DESC LIMIT 1", "commitments")
def open_run(spark, d):
    return extraction.latest_open(extraction.runs(run_events(spark, d)))


@query("a AS (SELECT * FROM exchanges WHERE exchange_index % 3 <> 0), k AS (SELECT * FROM exchanges WHERE conversation_id % 2 = 0), n AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM k)), b AS (SELECT conversation_id, ts FROM k UNION ALL SELECT conversation_id, ts FROM n) SELECT conversation_id, count(*) AS exchange_count, max(ts) AS last_ts FROM b WHERE conversation_id IN (SELECT conversation_id FROM n) GROUP BY 1", "exchanges")
def incremental_sync(spark, d):
    e = t.exchanges(spark, d)
    return extraction.new_exchanges(e.filter("exchange_index % 3 <> 0"), e.filter("conversation_id % 2 = 0"))[1]


@query("SELECT 'lineitem' AS name, (SELECT count(*) FROM lineitem) AS was, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) AS n UNION ALL SELECT 'nation', count(*), count(*) FILTER (n_nationkey > 3) FROM nation")
def snapshot_regressions(spark, d):
    line, nation = t.given(spark, d, "lineitem"), t.given(spark, d, "nation")
    part = t.given(spark, d, "part")
    return extraction.regressions(extraction.snapshot({"lineitem": line, "nation": nation, "part": part}), extraction.snapshot({"lineitem": line.filter("l_linenumber = 1"), "nation": nation.filter("n_nationkey > 3"), "part": part}))


@query("p AS (SELECT DISTINCT conversation_id FROM exchanges) SELECT conversation_id, CAST(0 AS BIGINT) AS pos, min(ts) AS event_ts FROM exchanges WHERE exchange_index IN (1, 2) GROUP BY 1", "exchanges")
def pending_event_ts(spark, d):
    e = t.exchanges(spark, d)
    pending = e.select("conversation_id").distinct().select("conversation_id", F.lit(0).cast("long").alias("pos"), F.array(F.lit(2), F.lit(1)).cast("array<long>").alias("source_exchange_indexes"))
    return extraction.pending_event_ts(pending, e)


@query("c AS (SELECT id, token_estimate, sum(token_estimate) OVER (ORDER BY exchange_index, id ROWS UNBOUNDED PRECEDING) AS s FROM exchanges WHERE conversation_id = 14) SELECT id, token_estimate FROM c WHERE s <= 800", "exchanges")
def budgeted_prefix(spark, d):
    return extraction.in_budget(t.exchanges(spark, d).filter("conversation_id = 14"), "token_estimate", 800, ["exchange_index", "id"]).select("id", "token_estimate")


@query("SELECT id FROM memories ORDER BY md5(concat('7:', id)), id LIMIT 25", "memories")
def random_sample(spark, d):
    return t.memories(spark, d).orderBy(F.md5(F.concat(F.lit("7:"), F.col("id").cast("string"))), "id").limit(25).select("id")


@query("SELECT conversation_id, max(ts) AS last, count(*) AS n FROM exchanges GROUP BY 1 ORDER BY last DESC, conversation_id LIMIT 1", "exchanges")
def latest_conversation(spark, d):
    return episodes.rollup(t.exchanges(spark, d)).select("conversation_id", F.col("ended_at").alias("last"), F.col("exchange_count").alias("n")).orderBy(F.desc("last"), "conversation_id").limit(1)


@query("tx AS (SELECT conversation_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, md5(string_agg(text, '|' ORDER BY line)) AS text_md5 FROM (SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, role, text FROM conversations) WHERE role IN ('user', 'assistant') GROUP BY 1) SELECT * FROM tx", "commitments")
def transcripts_round_trip(spark, d):
    """The turns written as transcripts, a file for each conversation, and read again."""
    from loam.sources.scratch import folder
    from loam.sources.transcripts import read_transcripts, write_transcripts

    at = folder(spark)
    lines = t.turns(spark, d).select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("line"), "role", "text")
    write_transcripts(lines, at, "home-me-proj")
    got = read_transcripts(spark, f"{at}/home-me-proj", files="*.txt")
    conversation = F.regexp_extract("project", "([0-9]+)$", 1).cast("long")
    rows = got.groupBy(conversation.alias("conversation_id")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "|")).alias("text_md5"))
    return rows


@query("SELECT count(*) AS n, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped FROM (SELECT CASE id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'skip' END AS action FROM memories WHERE deleted_at IS NULL AND is_active AND coalesce(scope, 'global') = 'global')", "memories")
def transfer_round_trip(spark, d):
    """Memories exported as lines and imported over a store that has two in three of them, one in three older."""
    from loam.sources.transcripts import export_lines, import_lines

    m = t.memories(spark, d).select("id", "content", "scope", "created_at", "is_active", "deleted_at")
    lines = export_lines({"memory": m}, ["global"])
    old = m.filter("id % 3 <> 0").selectExpr("id", "CASE WHEN id % 3 = 1 THEN created_at - 1 ELSE created_at END AS created_at")
    got = import_lines(lines.select("value"), "memory", "id:long,content:string,created_at:long", old, "created_at")
    return got.agg(F.count("*").alias("n"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("skip", "skipped"))])


def said_facts(exchanges):
    """A model's stand-in: for each exchange a fact of its own words, one list for each conversation."""
    words = F.trim(F.regexp_replace(F.substring("user_message", 1, 40), "[^a-z]+", " "))
    fact = F.struct(F.lit("fact").alias("type"), F.concat(F.lit("says "), words).alias("content"), F.lit(0.4).alias("importance"), F.lit(0.8).alias("confidence"), F.array("exchange_index").alias("source_exchange_indexes"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("exchange_index", fact.alias("f")))), lambda x: x["f"])
    return exchanges.groupBy("conversation_id").agg(F.to_json(F.struct(listed.alias("facts"))).alias("answer"))


def maintained(spark, d):
    """The store before a run: every other conversation is known and extracted, two exchanges of three arrive."""
    from loam.plans.maintenance import FACTS, Tables
    from loam.sources.scratch import folder, save

    e = save(t.exchanges(spark, d))  # turns are paired once for the four tables made of them
    known = e.filter("conversation_id % 2 = 0")
    m = t.memories(spark, d).selectExpr("id", "content", "context", "type", "confidence", "importance", "access_count", "created_at", "last_accessed", "stability", "is_active", "CAST(array() AS array<string>) AS sources")
    # A memory that says what an arriving exchange will say.
    words = F.trim(F.regexp_replace(F.substring("user_message", 1, 40), "[^a-z]+", " "))
    echo = e.filter("conversation_id = 1 AND exchange_index = 1").select(F.lit(-1).cast("long").alias("id"), F.concat(F.lit("SAYS  "), words, F.lit("!")).alias("content"))
    echo = echo.selectExpr("id", "content", "NULL AS context", "'fact' AS type", "0.9D AS confidence", "0.5D AS importance", "5L AS access_count", f"{NOW}L AS created_at", "NULL AS last_accessed", "NULL AS stability", "true AS is_active", "CAST(array() AS array<string>) AS sources")
    return Tables(spark, folder(spark)).commit({
        "exchanges": known, "arrived": e.filter("exchange_index % 3 <> 0"), "fingerprints": episodes.fingerprint(known), "facts": spark.createDataFrame([], FACTS), "memories": m.unionByName(echo),
        "entities": t.entities(spark, d), "relationships": t.relationships(spark, d),
    })


def phases():
    from loam.plans import maintenance as mt

    return {"ingest": mt.ingest, "extract": mt.extract(said_facts), "consolidate": mt.consolidate(NOW), "reflect": mt.reflect(NOW), "prune": mt.prune(NOW)}


@query(f"""a AS (SELECT * FROM exchanges WHERE conversation_id % 2 = 0 OR exchange_index % 3 <> 0), tc AS (SELECT DISTINCT conversation_id FROM exchanges WHERE conversation_id % 2 = 1 AND exchange_index % 3 <> 0),
fa AS (SELECT conversation_id, exchange_index, concat('says ', trim(regexp_replace(substr(user_message, 1, 40), '[^a-z]+', ' ', 'g'))) AS content FROM a SEMI JOIN tc USING (conversation_id)),
u AS (SELECT {NORMAL} AS k, count(*) AS n FROM fa GROUP BY 1), ec AS (SELECT {NORMAL} AS k FROM fa WHERE conversation_id = 1 AND exchange_index = 1),
pr AS (SELECT count(*) AS n FROM memories WHERE is_active AND round(confidence * least(1.0, 0.5 + 0.1 * access_count) * ({R}), 6) < 0.1)
SELECT 'ingest' AS phase, 'exchanges' AS name, count(*) AS rows FROM a UNION ALL SELECT 'ingest', 'arrived', 0 UNION ALL SELECT 'extract', 'facts', count(*) FROM fa UNION ALL SELECT 'extract', 'fingerprints', count(DISTINCT conversation_id) FROM a
UNION ALL SELECT 'consolidate', 'facts', 0 UNION ALL SELECT 'consolidate', 'memories', (SELECT count(*) FROM memories) + (SELECT count(*) FROM ec) + (SELECT count(*) FROM u WHERE k NOT IN (SELECT k FROM ec)) UNION ALL SELECT 'reflect', 'weights', count(*) FROM relationships
UNION ALL SELECT 'prune', 'memories', (SELECT count(*) FROM memories) + (SELECT count(*) FROM ec) + (SELECT count(*) FROM u WHERE k NOT IN (SELECT k FROM ec))
UNION ALL SELECT 'after', 'inactive', (SELECT n FROM pr) + (SELECT count(*) FROM memories WHERE NOT is_active) UNION ALL SELECT 'after', 'cited', (SELECT count(*) FROM u)""", "memories exchanges relationships")
def maintenance_run(spark, d):
    """The five phases, each on what the one before committed: rows of the tables they changed, memories that are inactive then, and those that cite an exchange."""
    from loam.plans.maintenance import run

    store, report = run(maintained(spark, d), phases())
    m = store.get()["memories"]
    after = m.agg(F.count_if(~F.col("is_active")).alias("inactive"), F.count_if(F.size("sources") > 0).alias("cited")).select(F.explode(F.map_from_arrays(F.array(F.lit("inactive"), F.lit("cited")), F.array("inactive", "cited"))).alias("name", "rows"))
    return report.select("phase", "name", "rows").unionByName(after.select(F.lit("after").alias("phase"), "name", "rows"))


@query("SELECT concat(conversation_id, '/', exchange_index) AS key, ts AS stated_at, ts // 86400 * 86400 + 86400 AS due_at FROM exchanges", "exchanges")
def commitments_due(spark, d):
    rows = promises(spark, d).filter("due_hint IS NOT NULL")
    return extraction.with_due(rows.withColumnRenamed("conversation_id", "key"), t.exchanges(spark, d)).select("key", "stated_at", "due_at")


@query("f AS (SELECT conversation_id FROM exchanges GROUP BY 1) SELECT conversation_id FROM f WHERE conversation_id % 3 <> 0", "exchanges")
def extract_selection(spark, d):
    """One conversation in three was extracted as it is, one before it changed."""
    now = episodes.fingerprint(t.exchanges(spark, d))
    done = now.filter("conversation_id % 3 < 2").selectExpr("'extract' AS phase", "'success' AS status", "conversation_id AS item_id", "CASE WHEN conversation_id % 3 = 0 THEN fingerprint ELSE 'old' END AS fingerprint", "1 AS seq")
    return extraction.to_extract(now, done).select("conversation_id")
