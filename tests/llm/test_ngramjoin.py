"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pytest

from missiva.llm import ngramjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def plain_join(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted([(d, len(s), low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=repr)


def near_copies(seed):
    """Groups of copies with a few changed words around the threshold, a hot passage, and loners."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    hot = [f"licence{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(30):
        texts.append(" ".join([*hot, *[word() for _ in range(rng.choice([0, 1, 2, 3, 7, 30]))]]))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def join(df, **more):
    return sorted(map(tuple, ngramjoin.similar_documents(df, **more).collect()), key=repr)


@pytest.mark.parametrize("seed,size,search", [(1, 1024, 256), (2, 2, 3), (3, 5, 2)])
def test_similar_documents(spark, seed, size, search):
    rows = near_copies(seed)
    want = plain_join(rows)
    assert 12 < len({c for _, _, c in want}) < len(want) - 12
    assert join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=size, search=search) == want


def test_awkward_documents(spark, awkward, no_documents, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FAN_IN", 2)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert join(awkward.repartition(3)) == plain_join(rows)
    assert join(no_documents) == []
    assert join(awkward.filter("doc_id IN (2, 3)")) == [(2, 0, 2), (3, 0, 3)]


def test_divide_skip_counts_exactly():
    rng = np.random.default_rng(4)
    for _ in range(60):
        query = np.unique(rng.integers(0, 400, 120).astype(np.uint64))
        sets = []
        for _ in range(40):
            kept = query[rng.random(len(query)) < rng.choice([0.5, 0.9, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 400, rng.integers(1, 20)).astype(np.uint64)])))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 85 * len(np.union1d(s, query))]
        for mu in (0.0, 0.0085, 1.0):
            assert ngramjoin.divide_skip(query, sets, mu=mu).tolist() == want


def test_sketch_bounds_every_frequency(spark):
    rows = near_copies(7)
    made = ngramjoin._sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4)
    counts = ngramjoin._frequencies(made)
    grams = np.concatenate([ngramjoin.shingle_set(t) for _, t in rows])
    values, real = np.unique(grams, return_counts=True)
    assert (counts[(values % np.uint64(ngramjoin.SKETCH)).astype(np.int64)] >= real).all() and counts.sum() == len(grams)
