"""The prefix tree of conversations against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from missiva.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, c int, pos int, n int"


def plain_tree(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += worth
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if seqs[c] == p))).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def conversations(seed, size, words="ab"):
    rng = random.Random(seed)
    rows = []
    for c in range(size):
        length = rng.choice([1, 1, 2, 3, 5, 9])
        # Long shared beginnings, so that hot prefixes have to be cut more than once.
        texts = ["a b"] * min(length, rng.choice([0, 4, 8])) + [rng.choice(words) + " x" * rng.randrange(3) for _ in range(length)]
        rows += [(c, k, "user" if k % 2 else "assistant", t, "clash", 1, 2, 3) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def tree(df, **more):
    return sorted(map(tuple, trie.conversation_tree(df, **more).collect()))


@pytest.mark.parametrize("load", [trie.LOAD, 25, 1])
def test_tree(spark, monkeypatch, load):
    monkeypatch.setattr(trie, "JOINED", 8)
    rows = conversations(load, 90)
    assert tree(spark.createDataFrame(rows, SCHEMA).repartition(5), load=load) == plain_tree(rows)


def test_awkward_turns(spark):
    x = ("clash", 1, 2, 3)
    rows = [
        (None, 0, "user", "gone", *x), (-21, 0, "user", "minus", *x), (7, None, None, None, *x), (7, 0, "user", "  ", *x), (7, 0, "user", "  ", *x),
        (7, 3, "tool", "w " * 40_000, *x), (8, 1, "user", "tie b", *x), (8, 1, "user", "tie a", *x), (9, 1, "user", "tie a", *x), (9, 1, "user", "tie b", *x),
        (20, 0, "a", "bc", *x), (21, 0, "ab", "c", *x), (22, 0, "ab", "c", *x), (40, 5, "", "", *x), (47, 0, "late", "one", *x),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert tree(df) == plain_tree(rows) == tree(df, load=1)
    assert tree(df.limit(0)) == []
    # Only a conversation without any turn left: the root alone.
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    only = [(lone, 0, "user", "taken away", *x)]
    assert tree(spark.createDataFrame(only, SCHEMA)) == plain_tree(only) and len(plain_tree(only)) == 1


def test_one_very_long_conversation(spark):
    rows = [(20, k, "user", f"turn {k % 7}", "clash", 1, 2, 3) for k in range(300)]
    rows += [(40, k, "user", f"turn {k % 7}", "clash", 1, 2, 3) for k in range(150)] + [(40, 150, "user", "other", "clash", 1, 2, 3)]
    assert tree(spark.createDataFrame(rows, SCHEMA), load=20) == plain_tree(rows)


def test_double_array():
    rng = np.random.default_rng(3)
    seqs = sorted({tuple(rng.integers(1, 40, rng.integers(1, 6)).tolist()) for _ in range(500)})
    lengths = np.array([len(s) for s in seqs])
    codes = np.concatenate([np.array(s) for s in seqs])
    made = trie.DoubleArray.of(codes, np.cumsum(lengths) - lengths, lengths)
    prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    found = {}
    for s in seqs:
        state = 0
        for d, c in enumerate(s):
            to = made.base[state] + c
            assert made.check[to] == state
            assert found.setdefault(to, s[: d + 1]) == s[: d + 1]
            state = to
    assert len(found) == len(prefixes) == sum(x != -1 for x in made.check) - 1
