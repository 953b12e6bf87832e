"""The prefix trie against a plain dictionary of prefixes: long and shared conversations, odd rows, stretches and pieces of a few rows."""

import hashlib
import math
import random
import re
import zlib

import pytest

from loam.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, d long, words string, n1 string"


def plain(rows):
    own = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += gain
    out = []
    for p, members in nodes.items():
        ended = sorted(c for c in members if len(made[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)


def talks(seed, n, deepest):
    rng = random.Random(seed)
    trunk = [(rng.choice("ua"), " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 4)))) for _ in range(deepest)]
    rows = []
    for c in range(n):
        keep, more = rng.randint(0, deepest), rng.randint(0, 4)
        turns = trunk[:keep] + [("u", f"own {rng.randint(0, 3)}") for _ in range(more)]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("deepest", [1, 6, 37])
def test_equal_to_a_dictionary_of_prefixes(spark, monkeypatch, deepest):
    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = talks(deepest, 50, deepest)
    assert built(spark, rows) == plain(rows)


def test_hot_and_odd_rows(spark):
    rows = talks(5, 15, 5)
    rows += [(60 + i, 0, "u", "same") for i in range(30)]  # one node ends most of them
    rows += [(200, i, "u", f"t {i % 3}") for i in range(150)]  # a conversation of a third of the turns
    rows += [(None, 0, "u", "lost"), (101, None, "u", "b"), (101, None, "u", "a"), (101, 1, None, None), (101, 1, None, None), (101, 0, "", ""), (102, 3, "a", None), (103, None, None, None), (-5, 0, "u", "x"), (-5, 1, "u", "y z"), (0, 9, "u", "\x1c \x0b q"), (121, 0, "ab", "c"), (122, 0, "a", "bc")]
    assert built(spark, rows) == plain(rows)


def test_turnless_conversations(spark):
    few = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(few[0], 0, "u", "gone"), (few[1], 0, "u", "gone too")]  # the first of the block is absent, so nothing is left
    assert built(spark, rows) == plain(rows) == [(few[0], 0, None, 2, 0, 1, 0, hashlib.sha256(f"{few[0]},{few[1]}".encode()).hexdigest())]


def test_empty(spark):
    assert built(spark, []) == [] and built(spark, [(None, 0, "u", "x")]) == []
