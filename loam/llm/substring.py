"""Substring deduplication: Rabin-Karp hashes of every window of 13 words, counted in Spark; repeated windows merge into maximal removal intervals.

A word is removed if a window that covers it has a word sequence that also starts in a document with a smaller doc_id. To keep the shuffles below the size of the texts, the windows that Spark counts are found in three exact steps:

1. Texts with equal word sequences are one text: the copies of the smallest id are wholly covered by its windows.
2. Every window has an anchor: the smallest hash among its runs of 5 words, so equal windows have equal anchors. Anchors that occur in one document only rule out their windows.
3. The remaining windows are hashed (two Rabin-Karp hashes of 64 bits), counted with the smallest document of each, and joined back to their documents.

Equal 128-bit hashes are taken as equal windows. Rows are told apart by their id and a hash of their text, so rows that share an id each get the windows and copies of their own text. Defined results: null and empty texts have no words; a text of under 13 words has no window and stays whole; rows that share a doc_id never remove each other's words; rows with a null doc_id stay whole and remove nothing; a text of any length is one row; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import arrow, column, content_keys, hashed, map_batches, release, rolling, sliding_min, spill, texts

WINDOW, RUN = 13, 5
_ANCHOR_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_ROW = ["doc_id", "_loam_t1"]
_NOTES = ["_loam_windows", "_loam_copied"]


def words(text: str) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13, as UTF-8: exactly what bytes.split() cuts at."""
    return text.encode("utf-8", "replace").split()


def anchors(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Each window's anchor."""
    return sliding_min(rolling(h, RUN, _ANCHOR_BASE), window - RUN + 1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in more than one document, with the smallest one."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(*keys, "first")


def removable(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, _loam_t1). (doc_id, _loam_t1, first hashes of its windows that also start in a smaller document), and (doc_id, _loam_t1) of the copies of an earlier document's words."""

    def describe(b):
        n, one, two, a = [], [], [], []
        for t in texts(b):
            w = words(t)
            d = xxhash.xxh3_128_digest(b" ".join(w))
            n.append(len(w))
            one.append(int.from_bytes(d[:8], "little", signed=True))
            two.append(int.from_bytes(d[8:], "little", signed=True))
            a.append(np.unique(anchors(hashed(w), window)))
        return {c: column(b, c) for c in _ROW} | {"n_words": n, "d1": one, "d2": two, "anchors": _lists(a)}

    def candidates(b):
        one, two = [], []
        for t, keep in zip(texts(b), column(b, "keep").to_pylist(), strict=True):
            h = hashed(words(t))
            at = np.flatnonzero(np.isin(anchors(h, window), np.array(keep, np.int64).view(np.uint64)))
            w, first = np.unique(rolling(h, window)[at], return_index=True)
            one.append(w)
            two.append(rolling(h, window, _SECOND_BASE)[at][first])
        return {c: column(b, c) for c in _ROW} | {"w1": _lists(one), "w2": _lists(two)}

    docs = docs.filter("doc_id IS NOT NULL")
    seen = spill(map_batches(docs, describe, "doc_id long, _loam_t1 long, n_words long, d1 long, d2 long, anchors array<long>").filter(F.col("n_words") >= window), "anchors")
    groups = spill(_shared(seen, "d1", "d2"), "copies")
    copies = spill(seen.select(*_ROW, "d1", "d2").join(groups, ["d1", "d2"]).filter("doc_id > first").select(*_ROW).distinct(), "copied")
    each = seen.select(*_ROW, F.explode("anchors").alias("h"))
    shared = spill(_shared(each, "h").select("h"), "shared")
    # Copies of a text add nothing that its first document doesn't have, but must not count as further documents of its own windows; they are left out from here on.
    mine = spill(each.join(shared, "h").groupBy(*_ROW).agg(F.collect_set("h").alias("keep")).join(copies, _ROW, "left_anti"), "mine")
    release(seen, groups, shared)
    found = spill(map_batches(docs.join(mine, _ROW), candidates, "doc_id long, _loam_t1 long, w1 array<long>, w2 array<long>", 200).filter(F.size("w1") > 0), "windows")
    release(mine)
    rows = found.select(*_ROW, F.explode(F.arrays_zip("w1", "w2")).alias("w")).select(*_ROW, "w.w1", "w.w2")
    first = spill(_shared(rows, "w1", "w2"), "repeated")
    hits = rows.join(first, ["w1", "w2"]).filter("doc_id > first").groupBy(*_ROW).agg(F.collect_set("w1").alias("windows"))
    hits = spill(hits, "removable")
    release(found, first)
    return hits, copies


def intervals(gone: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal removal intervals [start, end) over words, from the flags of the windows by their starts."""
    if not gone.any():
        return []
    edge = np.zeros(len(gone) + window, np.int64)
    edge[: len(gone)] += gone
    edge[window:] -= gone
    covered = np.cumsum(edge) > 0
    cut = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    return [(int(a), int(b)) for a, b in zip(cut[::2], cut[1::2], strict=True)]


def _cut(text: str, repeated: list[int] | None, copied: bool, window: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    w = words(text)
    if copied:
        return w, [(0, len(w))]
    if not repeated:
        return w, []
    return w, intervals(np.isin(rolling(hashed(w), window), np.array(repeated, np.int64).view(np.uint64)), window)


def _with_hits(docs: DataFrame, window: int) -> DataFrame:
    """docs with what is to go: the columns _loam_t1 and _NOTES."""
    docs = docs.withColumn("_loam_t1", content_keys()[0])
    hits, copies = removable(docs.select("doc_id", "text", "_loam_t1"), window)
    notes = hits.withColumn("copied", F.lit(False)).unionByName(copies.select(*_ROW, F.lit(None).cast("array<long>").alias("windows"), F.lit(True).alias("copied")))
    notes = notes.groupBy(*_ROW).agg(F.first("windows", True).alias(_NOTES[0]), F.max("copied").alias(_NOTES[1]))
    return docs.join(notes, _ROW, "left")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: (doc_id, n_words, n_removed, kept_sha256, removed), where removed lists the intervals as start:end."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(b):
        rows = []
        for t, r, c in zip(texts(b), *(column(b, c).to_pylist() for c in _NOTES), strict=True):
            w, gone = _cut(t, r, bool(c), window)
            kept, low = [], 0
            for s, e in gone:
                kept += w[low:s]
                low = e
            kept += w[low:]
            rows.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), ",".join(f"{s}:{e}" for s, e in gone)))
        return {"doc_id": column(b, "doc_id")} | dict(zip(("n_words", "n_removed", "kept_sha256", "removed"), map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(_with_hits(docs, window), run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string", 200)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents (doc_id, text, ...) with the removal intervals cut out of their texts, separators and all; n_chars follows. Rows that lose nothing stay as they are, and rows that lose every word go."""
    import re

    cols = docs.columns
    out_schema = docs.schema
    word = re.compile(r"[^\x20\x09-\x0d]+")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out, keep = [], []
                for t, r, c in zip(*(column(part, c).to_pylist() for c in ("text", *_NOTES)), strict=True):
                    gone = _cut(t or "", r, bool(c), window)[1]
                    if gone:
                        spots = [m.span() for m in word.finditer(t)]
                        pieces, low = [], 0
                        for s, e in gone:
                            pieces.append(t[low : spots[s][0]])
                            low = spots[e][0] if e < len(spots) else len(t)
                        t = "".join([*pieces, t[low:]]).strip()
                    out.append(t)
                    keep.append(not gone or bool(t))
                new = {"text": pa.array(out, pa.string())}
                if "n_chars" in cols:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in out], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(c, column(part, c)) for c in cols], names=cols).filter(pa.array(keep, pa.bool_()))

    return arrow(_with_hits(docs, window), run, out_schema)
