"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours for each seed document, which greedily fill its window.

Documents are encoded where they are read, and counted there too: the BM25 statistics (documents, average length, documents of each term) are those of all documents. Spark deals the documents to shards by the terms that weigh most in them, so that a shard holds at most about `SHARD_TOKENS` tokens whatever the input's size; a term with more than a shard is split by the second term, and then by a digest. Neighbours in other shards are not searched. Inside a shard every term of two documents or more has postings, and a seed asks with all of its terms. The first unused document seeds a window; the best-scoring unused documents follow until the window is full, and what no longer fits of the last one seeds the next window. So only a shard's last window can be padded, and related texts share windows.

Defined results: a null text counts as empty; an empty document is its end token; documents longer than a window fill several; rows that repeat an id are packed like any others; rows with a null id too; an empty table makes no sequence.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import arrow, column, map_batches, release, spill, texts

WINDOW, END = 2048, 1
SHARD_TOKENS = 3_000_000
TOGETHER = 8_000_000  # bytes of texts whose distinct words are encoded together
K1, B = 1.2, 0.75


class Encoder:
    """Ids of texts, a batch at a time: Arrow cuts the texts into words, and the batch's distinct words are encoded in one call by the rank-merging form of the same vocabulary, whose ids equal the tokenizers library's."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from loam.llm import bpe

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import public_tokenizers

        stands = bpe._byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(stands.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
        if max(*ranks.values(), *special.values()) >= 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.exact = bpe.coder(path)
        self.odd = bpe._ODD.search
        self.after_space = np.zeros(1 << 16, bool)
        self.after_space[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True

    def __call__(self, text: str) -> bytes:
        """Ids of one text as 16-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0].as_py()[:-2]

    def plain(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def whole(self, text: str) -> bytes:
        """Of a text that isn't cut: one that holds a special token, or a space before other white space or its end."""
        if any(s in text for s in self.exact.special):
            return np.frombuffer(self.exact.words([text])[0], "<u4").astype("<u2").tobytes()
        return self.plain(text).tobytes()

    def words(self, words: pa.Array) -> pa.BinaryArray:
        """Of words after a space each. They are encoded as one text: a space that no white space follows begins a piece of the pre-tokeniser, and no word holds a space, so that each word's ids begin with the only one whose piece begins with a space."""
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self.plain(" " + said) if len(words) else np.zeros(0, "<u2")
        starts = np.flatnonzero(self.after_space[ids])
        if len(starts) != len(words):
            raise RuntimeError("words and their ids differ in number")
        return _binary(ids, np.append(starts, len(ids)))

    def batch(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Of every text, with the end token, as 16-bit integers."""
        texts = texts.cast(pa.string()).fill_null("")
        special = functools.reduce(pc.or_, [pc.match_substring(texts, s) for s in self.exact.special])
        known = texts.to_pylist()
        uncut = [s or self.odd(t) is not None for s, t in zip(special.to_pylist(), known, strict=True)]
        cut = pc.split_pattern(pc.if_else(pa.array(uncut, pa.bool_()), "", texts), " ")
        first = np.zeros(len(cut.flatten()), bool)
        first[cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()] = True  # every text has a first word, if an empty one
        rest = cut.flatten().filter(pa.array(~first)).dictionary_encode()
        heads = [self.whole(t if u else t.partition(" ")[0]) for t, u in zip(known, uncut, strict=True)]
        # Codes of words, then of heads, then of the end token; a text is its head, its words and an end.
        n = len(rest.dictionary)
        code = np.empty(len(first) + len(heads), np.int64)
        at = np.flatnonzero(first) + np.arange(len(heads))
        ends = np.append(at[1:], len(code)) - 1
        word = np.ones(len(code), bool)
        word[at] = word[ends] = False
        code[word], code[at], code[ends] = rest.indices.to_numpy(), n + np.arange(len(heads)), n + len(heads)
        every = pa.concat_arrays([self.words(rest.dictionary), pa.array([*heads, np.array([END], "<u2").tobytes()], pa.binary())])
        runs = every.take(pa.array(code))
        bounds = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset :][: len(runs) + 1]
        return _binary(np.frombuffer(runs.buffers()[2], "<u2"), bounds[np.append(at, len(code))] // 2)


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Runs of 16-bit ids between bounds."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids, df): ids with the end token, 16 bits each (vocabularies of up to 65,536 ids). A task ends in a row of its own, without an n, whose df holds in how many of the task's documents each id occurs."""

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        none = pa.array([None], pa.int64())
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(column(b, text_col)), 0).to_numpy(zero_copy_only=False)) // TOGETHER
            starts = [*np.flatnonzero(np.diff(size, prepend=-1)).tolist(), b.num_rows]
            for low, high in zip(starts, starts[1:]):
                part = b.slice(low, high - low)
                ids = encoder(path).batch(column(part, text_col))
                for at in range(0, len(ids), 500):
                    df += np.bincount(_terms([np.frombuffer(x, "<u2") for x in ids[at : at + 500].to_pylist()])[1], minlength=1 << 16)
                yield pa.RecordBatch.from_arrays([column(part, id_col).cast(pa.int64()), pc.divide(pc.binary_length(ids), 2).cast(pa.int64()), ids, pa.nulls(len(ids), pa.binary())], names=["doc_id", "n", "ids", "df"])
        yield pa.RecordBatch.from_arrays([none, none, pa.array([b""], pa.binary()), pa.array([df.tobytes()], pa.binary())], names=["doc_id", "n", "ids", "df"])

    return arrow(docs.select(id_col, text_col), run, "doc_id long, n long, ids binary, df binary")


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every distinct id of every document, end tokens apart, in order; one sort for all of them."""
    sizes = [len(d) - 1 for d in docs]
    keys = np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(16), sizes)
    keys |= np.concatenate([d[:-1] for d in docs]) if docs else np.zeros(0, np.uint64)
    if len(docs) < 1 << 16:
        keys = keys.astype(np.uint32)
    keys.sort()
    at = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    u = keys[at]
    return (u >> keys.dtype.type(16)).astype(np.int64), (u & keys.dtype.type(0xFFFF)).astype(np.int64), np.diff(np.append(at, len(keys)))


def statistics(coded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, their average length, and how many of them hold each id (end tokens apart)."""

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in column(b, "df").to_pylist():
                df += np.frombuffer(x, np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    n, mean = coded.agg(F.count("n"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    df = np.zeros(1 << 16, np.int64)
    for term, k in arrow(coded.select("df").filter("df IS NOT NULL"), run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = k
    return n, mean, df


def _weights(term: np.ndarray, tf: np.ndarray, size: np.ndarray | int, stats: tuple[int, float, np.ndarray]) -> np.ndarray:
    n, mean, df = stats
    idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


_NO_TERM = 1 << 16


def heaviest(docs: list[np.ndarray], stats: tuple[int, float, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The two heaviest terms of each document of those in at least `least` documents; where it has none, of those in two."""
    doc, term, tf = _terms(docs)
    df = stats[2]
    size = np.array([len(d) for d in docs])
    common = df[term] >= least
    has = np.bincount(doc[common], minlength=len(docs)) > 0
    use = common | (~has[doc] & (df[term] > 1))
    doc, term, tf = doc[use], term[use], tf[use]
    out = np.full((2, len(docs)), _NO_TERM)
    weight = _weights(term, tf, size[doc], stats)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
    for k in range(2 if len(doc) else 0):  # the largest of each document in linear time; terms are in order, so of equals the first is the smallest
        best = np.flatnonzero((weight == np.maximum.reduceat(weight, starts)[which]) & (weight > -np.inf))
        best = best[np.append(True, which[best[1:]] != which[best[:-1]])] if len(best) else best
        out[k, doc[best]] = term[best]
        weight[best] = -np.inf
    return out[0], out[1]


def deal(coded: DataFrame, stats: tuple[int, float, np.ndarray], shard_tokens: int) -> tuple[DataFrame, int]:
    """The rows with their shard, and the number of shards. A document goes where the heaviest of its terms goes that fill a fair part of a shard; rarer ones would scatter the documents that share the others. Only sums by term reach the driver."""
    least = max(2, int(shard_tokens / stats[1] / 4))
    coded = coded.filter("n IS NOT NULL").select("doc_id", "n", "ids")

    def keys(b):
        k1, k2 = heaviest([np.frombuffer(x, "<u2") for x in column(b, "ids").to_pylist()], stats, least)
        return {"n": column(b, "n"), "k1": k1, "k2": k2}

    sums = spill(map_batches(coded, keys, "n long, k1 long, k2 long").groupBy("k1", "k2").agg(F.sum("n").alias("n")), "sums")
    # A term with more than a shard is split by the second term: a multiplicative hash of it, as in `placed`, into 64 parts at most, so that the plan has a bounded size (vocabulary times 64) whatever the input's.
    width = {k: 1 if t <= shard_tokens else min(64, 16 * -(-t // shard_tokens)) for k, t in sums.groupBy("k1").agg(F.sum("n")).collect()}
    wide = sums.join(F.broadcast(coded.sparkSession.createDataFrame([(k, w) for k, w in width.items()] or [(0, 1)], "k1 long, width long")), "k1")
    part = (F.col("k2") * F.lit(2654435761) % F.lit(1 << 32)) % F.col("width")
    plan, shard, filled = {}, 0, 0
    for k, q, t in sorted(map(tuple, wide.groupBy("k1", part.alias("part")).agg(F.sum("n")).collect())):
        if filled and filled + t > shard_tokens:
            shard, filled = shard + 1, 0
        pieces = -(-t // shard_tokens)
        plan[k, q] = shard, pieces
        shard, filled = (shard + pieces, 0) if pieces > 1 else (shard, filled + t)

    def placed(b):
        raw = column(b, "ids").to_pylist()
        k1, k2 = heaviest([np.frombuffer(x, "<u2") for x in raw], stats, least)
        out = []
        for i, x, a, z in zip(column(b, "doc_id").to_pylist(), raw, k1.tolist(), k2.tolist(), strict=True):
            first, pieces = plan[a, z * 2654435761 % (1 << 32) % width[a]]
            # The content salts the hash, so that rows which repeat one id spread too.
            out.append(first + (zlib.crc32(x, zlib.crc32(str(i).encode())) % pieces if pieces > 1 else 0))
        return {c: column(b, c) for c in ("doc_id", "n", "ids")} | {"shard": out}

    return map_batches(coded, placed, "shard long, doc_id long, n long, ids binary"), max(1, shard + (filled > 0))


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, stats: tuple[int, float, np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length). Every window but the last is full. stats: of all documents; where None, of these."""
    n = len(docs)
    size = np.array([len(d) for d in docs])
    doc, term, tf = _terms(docs)
    df = np.bincount(term, minlength=1 << 16)
    weight = _weights(term, tf, size[doc], stats or (n, size.mean(), df))
    ends = np.searchsorted(doc, np.arange(n + 1))
    # Ids of more than an eighth of the documents are rows of a dense table (at most 8 values a posting), the others lists of postings.
    hot = np.flatnonzero(df > max(1, n // 8))
    row = np.full(1 << 16, -1)
    row[hot] = np.arange(len(hot))
    dense = np.zeros((len(hot), n), np.float32)
    of_hot = row[term] >= 0
    dense[row[term[of_hot]], doc[of_hot]] = weight[of_hot]
    listed = np.flatnonzero((df[term] > 1) & ~of_hot)
    listed = listed[np.argsort(term[listed].astype(np.uint16), kind="stable")]
    post_term, post_doc, post_weight = term[listed], doc[listed], weight[listed]
    starts = np.searchsorted(post_term, np.arange((1 << 16) + 1))
    names = np.arange(n)  # of the documents that the index still holds

    def neighbours(seed: int):
        """Unused documents that share a term with the seed, the best first; sorted as far as they are asked for."""
        t = term[ends[seed] : ends[seed + 1]]
        held = row[t]
        scores = dense[held[held >= 0]].sum(0)
        low = starts[t]
        many = starts[t + 1] - low
        total = int(many.sum())
        if total:
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
            scores = scores + np.bincount(post_doc[at], post_weight[at], len(names))
        at = np.flatnonzero((scores > 0) & unused[names])
        near, scores = names[at], scores[at]
        some = 64
        while len(near) > some:
            cut = np.argpartition(-scores, some)
            best, cut = np.sort(cut[:some]), cut[some:]
            yield from near[best[np.argsort(-scores[best], kind="stable")]].tolist()
            near, scores = near[cut], scores[cut]
            some *= 2
        order = np.argsort(near)
        near, scores = near[order], scores[order]
        yield from near[np.argsort(-scores, kind="stable")].tolist()

    unused = np.ones(n, bool)
    left, following = n, 0
    windows: list[list[tuple[int, int, int]]] = []
    seed, at = -1, 0
    while True:
        if seed < 0:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                break
            seed, at = following, 0
            unused[seed] = False
            left -= 1
        if left < 0.7 * len(names):  # used documents leave the index
            stay = unused[names]
            new = np.cumsum(stay) - 1
            keep = stay[post_doc]
            post_term, post_doc, post_weight = post_term[keep], new[post_doc[keep]], post_weight[keep]
            starts = np.searchsorted(post_term, np.arange((1 << 16) + 1))
            dense, names = np.ascontiguousarray(dense[:, stay]), names[stay]
        now, room = [], window
        ranked = None
        take, start = seed, at
        seed, at = -1, 0
        while True:
            part = min(room, int(size[take]) - start)
            now.append((take, start, part))
            room -= part
            if start + part < size[take]:
                seed, at = take, start + part
            if not room:
                break
            if ranked is None:
                ranked = neighbours(take)
            take = next(ranked, -1)
            if take < 0:
                while following < n and not unused[following]:
                    following += 1
                if following == n:
                    break
                take, ranked = following, None
            unused[take] = False
            left -= 1
            start = 0
        windows.append(now)
    return windows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; sequence_id is the shard's number times 2**32 plus the window's."""
    coded = spill(encode(docs, path, id_col, text_col), "ids")
    stats = statistics(coded)
    dealt, shards = deal(coded, stats, shard_tokens)
    dealt = dealt.repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", "doc_id", "n")

    def shard_rows(shard: int, ids: list, raw: list[bytes]) -> pa.RecordBatch:
        tokens = [np.frombuffer(x, "<u2") for x in raw]
        out = []
        for w, pieces in enumerate(pack_shard(tokens, window, stats)):
            offset = 0
            for d, start, n in pieces:
                out.append((ids[d], start, n, zlib.crc32(tokens[d][start : start + n].astype("<u4").tobytes()), len(tokens[d]), (shard << 32) + w, offset))
                offset += n
        cols = list(map(list, zip(*out, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        shard, ids, raw = None, [], []
        for b in batches:
            for s, i, x in zip(*(column(b, c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if s != shard and ids:
                    yield shard_rows(shard, ids, raw)
                    ids, raw = [], []
                shard = s
                ids.append(i)
                raw.append(x)
        if ids:
            yield shard_rows(shard, ids, raw)

    return arrow(dealt.select("shard", "doc_id", "ids"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
