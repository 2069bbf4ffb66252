"""Searches and near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from missiva.llm import queries, simhash, topk

SF = "/root/testdata/sf0.001"


def plain_top(rows, k):
    data = {}
    for i, v in rows:
        if i is not None and v is not None:
            data[i] = min(data.get(i, v), v)
    out = []
    for q, a in data.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in data.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("block,cell,chunk", [(256, 32, 512), (4, 2, 3)])
def test_top_k(spark, block, cell, chunk):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-9, 9, 6).tolist()) for i in range(400)]
    rows += [(i, [1, 2, 3, 4, 5, 6]) for i in range(400, 460)] + [(50, rows[50][1]), (7, None), (None, [1] * 6), (500, [2, 2]), (550, [])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, v array<long>, score string, rank int")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=block, cell=cell, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows, 5))
    few = topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, few)) == sorted(plain_top([r for r in rows if r[0] is not None and r[0] < 3], 5))
    big = [(0, [2**30, 5]), (1, [2**31, 1]), (2, [2**31, 2])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, v array<long>"), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(big, 5))
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_scaling(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None],), (None,), ([float("inf")],), ([],)], "e array<float>")
    assert [r[0] for r in df.select(topk.scaled("e")).collect()] == [[128, -1], None, None, None, None, []]


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, fps):
    parent = {f: f for f in set(fps)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    each = sorted(parent)
    for i, a in enumerate(each):
        for b in each[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[root(f)] = min(low.get(root(f), i), i)
    return [low.get(root(f)) for f in fps]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_duplicates(spark, awkward, no_documents, bucket):
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        fps = [plain_fingerprint(t) for _, t in rows]
        want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components(rows, fps)))
        got = simhash.near_duplicates(docs, bucket=bucket)
        assert Counter(map(tuple, got.select("doc_id", simhash.hexadecimal("fp"), "component_id").collect())) == want
    assert simhash.near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_of_crowded_fingerprints(spark, bucket):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(3)]
    fps = {f for b in base for f in [b, *[b ^ sum(1 << x for x in random.sample(range(lo, lo + 24), random.randint(1, 6))) for lo in (0, 20, 40) for _ in range(60)]]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket).collect()]
    want = plain_components([(f, None) for f in fps], list(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    low = {}
    for f in fps:
        low[root(f)] = min(low.get(root(f), f), f)
    assert [low[root(f)] for f in fps] == want


def test_one_of_each_group_is_kept(spark, awkward):
    kept = simhash.keep_one_per_group(awkward)
    assert kept.columns == awkward.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(awkward.filter("doc_id is not null")).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i in found.values()} | {None: 1})


def test_registered_pairs(spark):
    assert queries.op2_topk(spark, SF).count() == 5 * 10
    assert queries.op7_simhash(spark, SF).count() == 200
