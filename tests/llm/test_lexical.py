"""Ranked lexical search against brute force."""

import math
import re

import numpy as np
import pytest

from missiva.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    docs = [(i, plain_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        scored = []
        for i, terms in docs:
            score = 0
            for q in plain_terms(text):
                tf = terms.count(q)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(q in t for _, t in docs) + 1)))
                    m = 100 - 75 + (75 * len(terms) * n_docs) // total
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


ITEMS = [
    (1, "Hello world, naïve words"), (2, None), (3, ""), (4, " - . "), (5, "漢字漢字 eight eight eight"), (5, "one two three"), (None, "no id here"),
    (6, "12.5 x nothing-known zzz"), (7, "the the " * 50 + "seven"),
]


@pytest.mark.parametrize("block,terms,tile,width", [(1024, 8192, 512, 4096), (2, 5, 2, 3)])
def test_rank_documents(spark, awkward, no_documents, block, terms, tile, width):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in ITEMS], "item_id long, text string, score string, rank int, item int")
    got = lexical.rank_documents(awkward, items, 3, block=block, terms=terms, tile=tile, width=width)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(got.collect()) == key(plain_ranking(docs, ITEMS, 3))
    assert lexical.rank_documents(no_documents, items).collect() == []
    assert lexical.rank_documents(awkward, items.limit(0)).collect() == []


def test_ties_over_many_tiles(spark):
    docs = [(i, "same words here" if i % 3 else "other words here now") for i in range(200, 0, -1)]
    items = [(1, "same words"), (2, "now")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = lexical.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), 10, tile=4)
    assert key(got.collect()) == key(plain_ranking(docs, items))


def test_products_stay_exact():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 2**33, (4, 30))
    w[0, 7] = 2**36
    term = np.sort(rng.integers(0, 30, 80))
    doc = np.arange(80) % 5
    at = np.unique(np.stack([term, doc]), axis=1)
    impact = rng.integers(0, 10**6, at.shape[1])
    dense = np.zeros((30, 5), np.int64)
    dense[at[0], at[1]] = impact
    assert (lexical.tile_scores(w, at[0], at[1], impact, 5) == w @ dense).all()
    tiles = lexical.vocabulary_tiles(w)
    assert [a for a, _ in tiles] == [0, *[b for _, b in tiles[:-1]]] and tiles[-1][1] == 30
    assert all(b - a == 1 or w[:, a:b].sum(1).max() * 10**6 < 2**53 for a, b in tiles)
