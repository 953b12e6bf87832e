"""BPE encoding and decoding through distinct-word tables.

Spark splits the texts into words inside its tasks: a word is cut before every space that a non-space follows, which is always a boundary of the vocabulary's own pre-tokeniser. A task's distinct words are encoded once each, into a table of id runs; a text's ids are that table joined back by word position. A task keeps the table of its first `KEPT` words for its later batches; further words get a table of their batch. Decoding joins each id to its piece in the vocabulary's fixed table (50,257 pieces), and joins the pieces by position.

A corpus-wide table is `word_table`, for corpora whose words recur; joining it to every position costs a shuffle larger than the texts, which is why the encoder's tables are per task.

Defined results: null and empty texts have no ids; a special token's string inside a text is that token, as the library reads it; texts of any length are whole; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import column, map_batches, texts

KEPT = 200_000

_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split(text: str) -> list[str]:
    """Words without the one space that every word but the first had before it."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


@functools.cache
def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The fixed id-to-piece table of one vocabulary, and its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        names = spec["model"]["vocab"]
        stands, special = _byte_of(), {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pieces = np.full(max([*names.values(), *special]) + 1, b"", object)
        for s, i in names.items():
            if i not in special:
                self.pieces[i] = bytes(map(stands.__getitem__, s))
        for i, s in special.items():
            self.pieces[i] = s.encode()

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of the ids, joined by position; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(self.pieces[ids[ids < len(self.pieces)]]).decode("utf-8", "replace")


class Coder(Vocabulary):
    """Encodes words by the tokenizers library and keeps a distinct-word table."""

    def __init__(self, path: str):
        import os

        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.table: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, batch: Iterable[str]) -> list[bytes]:
        """Ids of each text, likewise, through the distinct-word table."""
        cut, fresh = [], {}
        for text in batch:
            if any(s in text for s in self.special):
                first, rest = text, []  # what surrounds a special token is split apart from it: such a text is one word
            else:
                first, *rest = split(text)
            cut.append((first, rest))
            for w in rest:
                if w not in self.table:
                    fresh[w] = b""
        new = list(fresh)
        fresh = dict(zip(new, self.words([" " + w for w in new]), strict=True))
        room = KEPT - len(self.table)
        if len(new) <= room:
            self.table |= fresh
            get = self.table.__getitem__
        else:
            self.table |= {w: fresh[w] for w in new[: max(0, room)]}
            get = Both(self.table, fresh).__getitem__ if new[max(0, room) :] else self.table.__getitem__
        firsts = self.words([first for first, _ in cut])
        return [head + b"".join(map(get, rest)) for head, (_, rest) in zip(firsts, cut, strict=True)]


class Both(dict):
    """A batch's table over the task's table."""

    def __init__(self, table: dict, fresh: dict):
        super().__init__(fresh)
        self.table = table

    def __missing__(self, w):
        return self.table[w]


@functools.cache
def pieces(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as a binary of little-endian unsigned 32-bit integers."""

    def run(b):
        ids = coder(path).encode(texts(b, text_col))
        return {"doc_id": column(b, id_col), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, n_tokens long, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of encoded rows."""

    def run(b):
        c = pieces(path)
        return {n: column(b, n) for n in ("doc_id", "n_tokens", "ids")} | {"decoded": [c.decode(np.frombuffer(x or b"", "<u4")) for x in column(b, "ids").to_pylist()]}

    return map_batches(ids.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def word_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every distinct word of the corpus once: (word, n, ids), where n is how often it occurs and a word but the first of a text starts with its space."""

    def count(b):
        n: dict[str, int] = {}
        for t in texts(b, text_col):
            first, *rest = split(t)
            for w in [first, *(" " + r for r in rest)]:
                n[w] = n.get(w, 0) + 1
        return {"word": list(n), "n": list(n.values())}

    def code(b):
        return {"word": column(b, "word"), "n": column(b, "n"), "ids": coder(path).words(column(b, "word").to_pylist())}

    words = map_batches(docs.select(text_col), count, "word string, n long", 2000).groupBy("word").agg(F.sum("n").alias("n"))
    return map_batches(words, code, "word string, n long, ids binary", 5000)
