"""The commitments ledger: lists, digests, subjects, due hints and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.columns import DAY, commitment_tokens, overlap


def listing(ledger: DataFrame, now: int, status: str = "pending", within_days: int | None = None, scopes: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Overdue first, then by due date with undated last, then newest."""
    out = ledger.filter(F.col("status") == status)
    if within_days is not None:
        out = out.filter(F.col("due_at") <= now + within_days * DAY)
    if scopes:
        out = out.filter(F.col("scope").isin(*scopes))
    late = F.when(F.col("due_at") < now, 0).otherwise(1)
    return out.orderBy(late, F.col("due_at").isNull(), "due_at", F.desc("created_at"), "id").limit(max(1, min(limit, 500))).select("id", "due_at", "created_at", "scope")


def digest(ledger: DataFrame, now: int) -> DataFrame:
    waiting = F.col("status") == "pending"
    return ledger.agg(F.count_if(waiting).alias("n_pending"), F.count_if(waiting & (F.col("due_at") < now)).alias("n_overdue"), F.count_if(waiting & F.col("due_at").between(now, now + 7 * DAY)).alias("n_due_soon"))


def duplicates(ledger: DataFrame, least: float = 0.85) -> DataFrame:
    """Distinct contents of one subject whose tokens overlap: (subject, first_id, second_id, overlap). Rows with equal contents count once, so only different wordings are paired."""
    one = ledger.groupBy("subject", "content").agg(F.min("id").alias("id")).withColumn("tokens", commitment_tokens(F.col("content")))
    token = one.select("subject", "id", "tokens", F.explode("tokens").alias("t"))
    # Wordings meet through the smaller set's rarest tokens: one of the first n - ceil(least * n) + 1 is shared by any pair over the threshold.
    rare = token.groupBy("subject", "t").agg(F.count("*").alias("df"))
    order = token.join(rare, ["subject", "t"]).groupBy("subject", "id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("by_df"), F.first("tokens").alias("tokens"))
    n = F.size("by_df")
    a = order.select("subject", F.col("id").alias("x"), F.col("tokens").alias("tx"), F.explode(F.slice("by_df.t", F.lit(1), n - F.ceil(least * n).cast("int") + 1)).alias("t"))
    b = token.select("subject", F.col("id").alias("y"), F.col("tokens").alias("ty"), "t")
    pairs = a.join(b, ["subject", "t"]).filter("x <> y").select("subject", F.least("x", "y").alias("first_id"), F.greatest("x", "y").alias("second_id"), F.col("tx").alias("ta"), F.col("ty").alias("tb")).dropDuplicates(["subject", "first_id", "second_id"])
    return pairs.withColumn("overlap", F.round(overlap(F.col("ta"), F.col("tb")), 6)).filter(F.col("overlap") >= least).select("subject", "first_id", "second_id", "overlap")


def subject(raw: str | None, own: str = "self") -> str:
    """A subject as one lower-case word; the speaker's own words for themselves give `own`."""
    import re

    clean = re.sub(r"[^a-z0-9 _-]", " ", (raw or "").lower()).strip()
    return own if clean in ("", "user", "me", "i", "the user") else clean.split()[0]


def known(candidates: DataFrame, comparators: DataFrame, least: float = 0.85) -> DataFrame:
    """candidates: (id, subject, content), with whether a comparator (subject, content) of the subject has tokens that overlap enough. A pair meets through one of the candidate's or comparator's rarest tokens; only whether there is one leaves the join."""
    new = candidates.withColumn("tokens", commitment_tokens(F.col("content")))
    old = comparators.select("subject", "content").distinct().select("subject", commitment_tokens(F.col("content")).alias("other")).filter(F.size("other") > 0)
    df = old.select("subject", F.explode("other").alias("t")).groupBy("subject", "t").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, tokens: str, keep: list[str]) -> DataFrame:
        """The first n - ceil(least * n) + 1 tokens by rarity, one of which the larger set has where the overlap is enough."""
        each = rows.select(*keep, tokens, F.explode(tokens).alias("t")).join(df, ["subject", "t"], "left")
        order = each.groupBy(*keep, tokens).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))
        return order.select(*keep, tokens, F.explode(F.slice("o.t", F.lit(1), F.size("o") - F.ceil(least * F.size("o")).cast("int") + 1)).alias("t"))

    mine = new.select("id", "subject", "tokens")
    small = rare(mine, "tokens", ["id", "subject"]).join(old.select("subject", "other", F.explode("other").alias("t")), ["subject", "t"])
    large = mine.select("id", "subject", "tokens", F.explode("tokens").alias("t")).join(rare(old, "other", ["subject"]), ["subject", "t"])
    hit = small.select("id", "tokens", "other").unionByName(large.select("id", "tokens", "other")).filter(overlap(F.col("tokens"), F.col("other")) >= least).select("id").distinct()
    return new.join(hit.withColumn("_hit", F.lit(True)), "id", "left").select("id", "subject", "content", F.coalesce("_hit", F.lit(False)).alias("duplicate"))
