"""Exchanges: transcripts paired into turns, roll-ups, neighbourhoods and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_turns(lines: DataFrame) -> DataFrame:
    """lines: (conversation_id, line, role, text). A user line opens an exchange, the assistant's lines up to the next one are joined by blank lines; exchanges without an answer are left out."""
    by_line = Window.partitionBy("conversation_id").orderBy("line")
    islands = lines.filter(F.col("role").isin("user", "assistant")).withColumn("island", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by_line))
    said = F.col("role") == "assistant"
    out = islands.filter("island > 0").groupBy("conversation_id", "island").agg(
        F.min("line").alias("first_line"), F.max(F.when(said, F.col("line"))).alias("last_line"), F.max(F.when(~said, F.col("text"))).alias("user_message"),
        F.array_sort(F.collect_list(F.when(said, F.struct("line", "text")))).alias("answers"),
    )
    out = out.filter(F.size("answers") > 0).withColumn("assistant_message", F.array_join(F.col("answers.text"), "\n\n"))
    return out.select(
        F.md5(F.concat(F.col("conversation_id").cast("string"), F.lit(":"), F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string"))).alias("id"), "conversation_id",
        (F.row_number().over(Window.partitionBy("conversation_id").orderBy("first_line")) - 1).cast("long").alias("exchange_index"), "first_line", "last_line", "user_message", "assistant_message",
        F.ceil((F.length("user_message") + F.length("assistant_message")) / 4).alias("token_estimate"),
    )


def rollup(exchanges: DataFrame) -> DataFrame:
    return exchanges.groupBy("conversation_id").agg(F.count("*").alias("exchange_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


def neighbourhood(exchanges: DataFrame, reach: int = 5) -> DataFrame:
    """Per exchange, the first and last index within `reach` and the tokens there; by index values, so gaps don't widen it."""
    w = Window.partitionBy("conversation_id").orderBy("exchange_index").rangeBetween(-reach, reach)
    return exchanges.select("id", F.min("exchange_index").over(w).alias("from_index"), F.max("exchange_index").over(w).alias("to_index"), F.count("*").over(w).alias("n_around"), F.sum("token_estimate").over(w).alias("tokens_around"))


def chunk_plan(counts: DataFrame, size: int = 25, overlap: int = 5, most: int = 100) -> DataFrame:
    """counts: (conversation_id, n). Up to `most` items are one chunk; longer ones are cut into overlapping windows, a window at every step below n."""
    step, n = max(size - overlap, 1), F.col("n")
    starts = F.when(n <= most, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(step).cast("long")))
    plan = counts.select("conversation_id", "n", F.explode(starts).alias("start"))
    return plan.select("conversation_id", "start", F.when(n <= most, n).otherwise(F.least(F.col("start") + size, n)).cast("long").alias("end"))


def fingerprint(exchanges: DataFrame) -> DataFrame:
    """A digest of each conversation's exchanges in order, to skip unchanged ones."""
    parts = F.array_sort(F.collect_list(F.struct("exchange_index", "user_message", "assistant_message")))
    flat = F.array_join(F.transform(parts, lambda x: F.concat_ws("|", x["user_message"], x["assistant_message"])), "\n")
    return exchanges.groupBy("conversation_id").agg(F.sha2(flat, 256).alias("fingerprint"))
