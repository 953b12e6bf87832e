"""Column expressions shared by the operators. None of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions import fixed

DAY = 86400


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(normalised(text), " "), "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4 * 1.1)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def stability(kind: Column, kept: Column) -> Column:
    by_kind = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in fixed.STABILITY.items()])
    return F.coalesce(kept, by_kind)


def retrievability(now: int, accessed: Column, created: Column, stable: Column) -> Column:
    """0.9 ** (days since the last access / stability); 1 for the future."""
    days = (F.lit(now) - F.coalesce(accessed, created)) / F.lit(float(DAY))
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.9), days / stable))


def confidence(base: Column, accesses: Column, r: Column) -> Column:
    return base * F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * accesses) * r


def retrieval_score(match: Column, r: Column, importance: Column) -> Column:
    return F.lit(0.55) * match + F.lit(0.25) * r + F.lit(0.20) * importance


def transient(text: Column) -> Column:
    t = F.trim(text)
    out = t.rlike(fixed.TRANSIENT[0])
    for p in fixed.TRANSIENT[1:]:
        out = out | t.rlike(p)
    return out


def noise_name(name: Column) -> Column:
    t = F.trim(name)
    return (F.length(t) <= 1) | t.rlike(fixed.NOISE_PATTERN) | F.lower(t).isin(*fixed.NOISE_NAMES)


def visible(scope: Column, scopes: list[str]) -> Column:
    """A row without a scope is global."""
    return F.coalesce(scope, F.lit("global")).isin(*scopes)


def iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def edge_weight(mentions: Column, days: Column, conf: Column, importance: Column) -> Column:
    frequency = F.least(F.lit(1.0), F.log2(1 + mentions) / F.log2(F.lit(11.0)))
    recency = F.pow(F.lit(0.9), days / 90)
    return F.greatest(F.lit(0.01), F.lit(0.35) * frequency + F.lit(0.25) * recency + F.lit(0.20) * conf + F.lit(0.20) * importance)


def commitment_tokens(text: Column) -> Column:
    raw = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    kept = F.filter(raw, lambda w: (F.length(w) >= 2) & ~w.isin(*fixed.COMMITMENT_STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set's size; 0 where a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def query_phrases(query: str, most: int = 24, shortest: int = 2) -> list[list[str]]:
    """The parts of a free-text query that are worth looking up, between spaces and in lower case; all of them if none is. Each is a list of the words that its punctuation leaves, as texts are cut."""
    parts = [t.lower() for t in re.sub("['\"]", "", query).split()]
    bare = {p: re.sub(r"[^\w]|_", "", p) for p in parts}
    kept = [p for p in bare if len(bare[p]) >= shortest and bare[p] not in fixed.QUERY_STOP_WORDS][:most]
    found = (re.findall(r"[^\W_]+", p) for p in kept or list(bare)[:most])
    return [list(x) for x in dict.fromkeys(tuple(f) for f in found if f)]


def query_terms(query: str, most: int = 24, shortest: int = 2) -> list[str]:
    """The words of the phrases, each once."""
    return list(dict.fromkeys(w for p in query_phrases(query, most, shortest) for w in p))


def l2_to_cosine(distance: Column) -> Column:
    """The cosine of two unit vectors at a distance."""
    return 1 - distance * distance / 2
