"""What comes before and after a model's extraction: prompts, checks of its answers, commitments, and the bookkeeping of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import fixed
from loam.functions.columns import noise_name

FACT = "type string, content string, context string, importance double, confidence double, extraction_basis string, source_exchange_indexes array<long>"
ENTITY = "name string, type string, description string"
EDGE = "source_entity_index long, target_entity_index long, type string, context string"
COMMITMENT = "content string, subject string, origin string, due_hint string, source_exchange_indexes array<string>, source_exchange_id string"


def clipped(text: Column, cap: int) -> Column:
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.substring(text, 1, cap), F.lit(" …[truncated]")))


def importance_label(importance: Column) -> Column:
    return F.when(importance >= 0.8, "high").when(importance >= 0.5, "medium").otherwise("low")


def percent(share: Column) -> Column:
    """Whole per cent, halves up."""
    return F.floor(share * 100 + 0.5).cast("long")


def one_decimal(share: Column) -> Column:
    """Per cent with one decimal, halves up."""
    return F.floor(share * 1000 + 0.5) / 10


def error_class(message: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in fixed.ERROR_CLASSES:
        out = out.when(message.rlike(pattern), name)
    return out.otherwise("unknown")


def short_hash(text: Column) -> Column:
    """An id in base 36 from a string: 32-bit h = 33 h + c over its characters, from 5381."""
    h = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(5381).cast("long"), lambda s, c: (s * 33 + c) % F.lit(1 << 32))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def unit_prefix(vector: Column, dims: int) -> Column:
    """The first `dims` components at length one; zeros stay."""
    v = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def embedding_text(user: Column, assistant: Column, project: Column | None = None, date: Column | None = None, branch: Column | None = None, tools: Column | None = None) -> Column:
    """What is embedded for an exchange: what is known of it in brackets, the user's words, the first 500 characters of the answer, and the tools."""
    known = F.array_compact(F.array(*[F.concat(F.lit(f"{n}: "), c) for n, c in (("Project", project), ("Date", date), ("Branch", branch)) if c is not None] or [F.lit(None).cast("string")]))
    head = F.when(F.size(known) > 0, F.concat(F.lit("["), F.array_join(known, " | "), F.lit("]")))
    used = F.when(F.size(tools) > 0, F.concat(F.lit("Tools used: "), F.array_join(tools, ", "))) if tools is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", head, F.concat(F.lit("User: "), user), F.concat(F.lit("Assistant: "), F.substring(assistant, 1, 500)), used)


def prompts(exchanges: DataFrame, cap: int | None = None, size: int = 25) -> DataFrame:
    """exchanges: (conversation_id, exchange_index, user_message, assistant_message). (conversation_id, part, prompt): the exchanges in order, `size` to a part, so that no row holds more than those."""
    cut = (lambda c: clipped(c, cap)) if cap else (lambda c: c)
    one = F.concat(F.lit("[Exchange "), F.col("exchange_index").cast("string"), F.lit("]\nUser: "), cut(F.col("user_message")), F.lit("\nAssistant: "), cut(F.col("assistant_message")))
    rows = exchanges.select("conversation_id", F.floor(F.col("exchange_index") / size).alias("part"), "exchange_index", one.alias("text"))
    return rows.groupBy("conversation_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exchange_index", "text"))), lambda x: x["text"]), "\n\n").alias("prompt"))


def facts(answers: DataFrame) -> DataFrame:
    """answers: (conversation_id, answer), the answer as JSON {"facts": [...]}. The facts of a known type with content and an importance of at least 0.1, trimmed and clamped."""
    rows = answers.select("conversation_id", F.posexplode(F.from_json("answer", f"facts array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>")["facts"]).alias("pos", "f")).select("conversation_id", "pos", "f.*")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = rows.withColumn("importance", clamp(F.coalesce("importance", F.lit(0.5)))).withColumn("confidence", F.when(F.col("confidence").isNotNull(), clamp(F.col("confidence")))).withColumn("content", F.trim("content")).withColumn("context", F.nullif(F.trim("context"), F.lit("")))
    rows = rows.filter(F.col("type").isin(*fixed.STABILITY) & (F.col("content") != "") & (F.col("importance") >= 0.1))
    basis = F.when(F.col("extraction_basis").isin("explicit", "inferred", "observed"), F.col("extraction_basis")).otherwise("observed")
    return rows.withColumn("extraction_basis", basis)


def with_sources(rows: DataFrame, exchanges: DataFrame) -> DataFrame:
    """rows: (conversation_id, pos, source_exchange_indexes). (conversation_id, pos, sources): the ids of the conversation's exchanges (conversation_id, exchange_index, id) that are named, by id or index, in order, each once."""
    cite = rows.select("conversation_id", "pos", F.posexplode("source_exchange_indexes").alias("k", "i")).withColumn("i", F.col("i").cast("string"))
    by_id = cite.join(exchanges.select("conversation_id", F.col("id").cast("string").alias("i"), "id"), ["conversation_id", "i"]).select("conversation_id", "pos", "k", F.lit(0).alias("how"), "id")
    index = F.when(F.col("i").rlike(r"^\d+$"), F.expr("try_cast(i AS BIGINT)"))
    by_index = cite.withColumn("exchange_index", index).join(exchanges.select("conversation_id", "exchange_index", "id"), ["conversation_id", "exchange_index"]).select("conversation_id", "pos", "k", F.lit(1).alias("how"), "id")
    met = by_id.unionByName(by_index).groupBy("conversation_id", "pos", "k").agg(F.min_by("id", "how").alias("id")).groupBy("conversation_id", "pos", "id").agg(F.min("k").alias("k"))
    return met.groupBy("conversation_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("sources"))


def entities(answers: DataFrame, types: list[str]) -> DataFrame:
    """{"entities": [...]}: named entities of a known type that are no noise, the first of each name, but for case."""
    rows = answers.select("conversation_id", F.posexplode(F.from_json("answer", f"entities array<struct<{ENTITY.replace(' ', ':').replace(',:', ',')}>>")["entities"]).alias("pos", "e")).select("conversation_id", "pos", F.trim("e.name").alias("name"), "e.type", F.nullif(F.trim("e.description"), F.lit("")).alias("description"))
    rows = rows.filter((F.col("name") != "") & ~noise_name(F.col("name")) & F.col("type").isin(*types))
    return rows.groupBy("conversation_id", F.lower("name").alias("key")).agg(F.min_by(F.struct("pos", "name", "type", "description"), "pos").alias("e")).select("conversation_id", "e.*")


def relationships(answers: DataFrame, counts: DataFrame, types: list[str]) -> DataFrame:
    """{"relationships": [...]}: edges of a known type between two of the conversation's entities (counts: conversation_id, n), from different ones."""
    rows = answers.select("conversation_id", F.explode(F.from_json("answer", f"relationships array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>")["relationships"]).alias("r")).select("conversation_id", "r.*")
    s, t = F.col("source_entity_index"), F.col("target_entity_index")
    return rows.join(counts, "conversation_id").filter((s >= 0) & (t >= 0) & (s < F.col("n")) & (t < F.col("n")) & (s != t) & F.col("type").isin(*types)).drop("n")


def commitments(answers: DataFrame, exchanges: DataFrame, own: str = "self") -> DataFrame:
    """answers: (conversation_id, answer), {"commitments": [...]}, the same with the list encoded once more as a string, or a bare list. Items of three characters or more that name an exchange of the conversation, by indexes, ids or one `source_exchange_id`: (conversation_id, pos, content, subject, origin, due_hint, sources)."""
    # Read as a string, a field that holds a list gives its text, and one that holds a string what that says.
    bare = F.ltrim("answer").startswith("[")
    items = F.when(bare, F.col("answer")).otherwise(F.from_json("answer", "commitments string")["commitments"])
    rows = answers.select("conversation_id", F.posexplode(F.from_json(items, f"array<struct<{COMMITMENT.replace(' ', ':').replace(',:', ',')}>>")).alias("pos", "c")).select("conversation_id", "pos", "c.*")
    rows = rows.withColumn("source_exchange_indexes", F.coalesce("source_exchange_indexes", F.array("source_exchange_id")))
    rows = rows.withColumn("content", F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))).filter(F.length("content") >= 3)
    hint = F.when(F.lower(F.trim("due_hint")) != "null", F.nullif(F.trim("due_hint"), F.lit("")))
    rows = rows.join(with_sources(rows, exchanges), ["conversation_id", "pos"])
    return rows.select("conversation_id", "pos", F.when(F.length("content") > 240, F.concat(F.substring("content", 1, 237), F.lit("..."))).otherwise(F.col("content")).alias("content"), subject(F.col("subject"), own).alias("subject"), F.when(F.col("origin") == "inferred", "inferred").otherwise("stated").alias("origin"), hint.alias("due_hint"), "sources")


def subject(raw: Column, own: str = "self") -> Column:
    """One lower-case word; the speaker's own words for themselves, and nothing, give `own`."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9 _-]", " "))
    return F.when(clean.isin("", "user", "me", "i", "the user"), own).otherwise(F.split_part(clean, F.lit(" "), F.lit(1)))


def with_cue(rows: DataFrame, exchanges: DataFrame, own: str = "self") -> DataFrame:
    """rows: (key, subject, sources). The keys of candidates whose sources' user texts promise something, and name the subject if it isn't the speaker. exchanges: (id, user_message, assistant_message)."""
    said = rows.select("key", "subject", F.explode("sources").alias("id")).join(exchanges.select("id", F.coalesce("user_message", F.lit("")).alias("u"), F.coalesce("assistant_message", F.lit("")).alias("a")), "id")
    named = F.contains(F.lower("u"), F.lower("subject")) | F.contains(F.lower("a"), F.lower("subject")) | (F.col("subject") == own)
    return said.groupBy("key").agg(F.bool_or(F.col("u").rlike(fixed.COMMITMENT_CUE)).alias("cue"), F.bool_or(named).alias("named")).filter("cue AND named").select("key")


def selected(exchanges: DataFrame, checkpoints: DataFrame, least: int = 40) -> DataFrame:
    """Conversations for the next pass: never done, or with exchanges after their last success; with `least` characters of the user's. exchanges: (conversation_id, ts, user_message), checkpoints: (item_id, processed_at, status)."""
    c = exchanges.groupBy("conversation_id").agg(F.max("ts").alias("last"), F.sum(F.length("user_message")).alias("chars"))
    done = checkpoints.filter("status = 'success'").groupBy(F.col("item_id").alias("conversation_id")).agg(F.max("processed_at").alias("done"))
    return c.join(done, "conversation_id", "left").filter(F.col("done").isNull() | (F.col("last") > F.col("done"))).filter(F.col("chars") >= least).select("conversation_id", "last", "chars")


# Runs and checkpoints


def checkpoints(events: DataFrame) -> DataFrame:
    """events: (seq, run_id, phase, item_id, status, message, fingerprint). The state that they leave, a row per item: after a success errors don't count; a success is recorded once; attempts are the errors before it, and itself."""
    key = ["run_id", "phase", "item_id"]
    won = events.filter("status = 'success'").groupBy(*key).agg(F.min(F.struct("seq", "fingerprint")).alias("s"))
    rows = events.join(won, key, "left").filter((F.col("status") == "error") & (F.col("s").isNull() | (F.col("seq") < F.col("s.seq"))))
    errors = rows.groupBy(*key).agg(F.count("*").alias("errors"), F.max(F.struct("seq", "message")).alias("e"))
    both = errors.join(won, key, "full_outer")
    ok = F.col("s").isNotNull()
    return both.select(*key, F.when(ok, "success").otherwise("error").alias("status"), F.coalesce("s.seq", "e.seq").alias("seq"), (F.coalesce("errors", F.lit(0)) + ok.cast("int")).cast("long").alias("attempts"), F.when(~ok, error_class(F.col("e.message"))).alias("error_class"), F.col("s.fingerprint").alias("fingerprint"))


def retryable(state: DataFrame, run_id, phase: str) -> DataFrame:
    """Items of a run and phase that failed and never succeeded, oldest first."""
    return state.filter((F.col("run_id") == run_id) & (F.col("phase") == phase) & (F.col("status") == "error")).orderBy("seq").select("item_id", "error_class", "attempts")


def unchanged(fingerprints: DataFrame, state: DataFrame, phase: str = "extract") -> DataFrame:
    """Conversations (conversation_id, fingerprint) whose last success in the phase had the same fingerprint."""
    last = state.filter((F.col("phase") == phase) & (F.col("status") == "success")).groupBy(F.col("item_id").alias("conversation_id")).agg(F.max_by("fingerprint", "seq").alias("was"))
    return fingerprints.join(last, "conversation_id").filter("fingerprint = was").select("conversation_id")


def runs(events: DataFrame) -> DataFrame:
    """events: (seq, run_id, kind, phase), kinds start, phase, complete and fail. Each run's state: started, ended, outcome and the phases done, in order."""
    done = F.filter(F.array_sort(F.collect_list(F.when(F.col("kind") == "phase", F.struct("seq", "phase")))), lambda x: x.isNotNull())
    out = events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("started"), F.max(F.when(F.col("kind").isin("complete", "fail"), F.struct("seq", "kind"))).alias("end"), F.array_join(F.transform(done, lambda x: x["phase"]), ",").alias("phases"))
    return out.filter("started IS NOT NULL").select("run_id", "started", F.col("end.seq").alias("ended"), F.coalesce("end.kind", F.lit("open")).alias("outcome"), "phases")


def latest_open(state: DataFrame) -> DataFrame:
    """The latest run that hasn't ended."""
    return state.filter("outcome = 'open'").orderBy(F.desc("started"), F.desc("run_id")).limit(1).select("run_id", "phases")


def new_exchanges(arrived: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchanges that aren't known yet, and the conversations they change: (conversation_id, exchange_count, last_ts) over both."""
    new = arrived.join(known.select("id"), "id", "left_anti")
    touched = new.select("conversation_id").distinct()
    both = known.select("conversation_id", "ts").unionByName(new.select("conversation_id", "ts")).join(touched, "conversation_id", "left_semi")
    return new, both.groupBy("conversation_id").agg(F.count("*").alias("exchange_count"), F.max("ts").alias("last_ts"))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables with fewer rows than before."""
    return before.withColumnRenamed("n", "was").join(after, "name").filter("n < was").select("name", "was", "n")


def pending_event_ts(pending: DataFrame, exchanges: DataFrame) -> DataFrame:
    """pending: (conversation_id, pos, source_exchange_indexes), facts that were spilled. The earliest time of each one's exchanges (conversation_id, exchange_index, ts)."""
    cite = pending.select("conversation_id", "pos", F.explode("source_exchange_indexes").alias("exchange_index"))
    return cite.join(exchanges.select("conversation_id", "exchange_index", "ts"), ["conversation_id", "exchange_index"]).groupBy("conversation_id", "pos").agg(F.min("ts").alias("event_ts"))


def in_budget(rows: DataFrame, cost: str, budget: int, order: list, at_least_one: bool = False) -> DataFrame:
    """The head of a bounded list whose costs fit into a budget: it ends at the first row that doesn't; `at_least_one` keeps the first anyway."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_sum", F.sum(cost).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    fits = F.col("_sum") <= budget
    return out.filter(fits | (F.col("_n") == 1) if at_least_one else fits).drop("_sum", "_n")


def with_due(rows: DataFrame, exchanges: DataFrame) -> DataFrame:
    """rows: (key, due_hint, sources), with stated_at, the earliest time of the exchanges (id, ts) they come from, and due_at, the start of the day that the hint means counted from there."""
    from loam.functions.dates import due_days

    said = rows.select("key", F.explode("sources").alias("id")).join(exchanges.select("id", "ts"), "id").groupBy("key").agg(F.min("ts").alias("stated_at"))
    out = due_days(rows.join(said, "key", "left"), "due_hint", F.to_date(F.timestamp_seconds("stated_at")), "_due")
    return out.withColumn("due_at", F.unix_date("_due").cast("long") * 86400).drop("_due")


def to_extract(fingerprints: DataFrame, state: DataFrame, phase: str = "extract") -> DataFrame:
    """Conversations (conversation_id, fingerprint) that were never extracted, or have changed since."""
    return fingerprints.join(unchanged(fingerprints, state, phase), "conversation_id", "left_anti")
