import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from missiva.operators import graph as G
from missiva.operators import retrieval as R
from missiva.operators import vectors as V


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(4, 8)).repeat(30, 0) + rng.normal(size=(120, 8)) * 0.2, np.tile(rng.normal(size=8), (60, 1)), np.zeros((2, 8))])
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def brute(x, k):
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    s = u @ u.T
    return {i: [round(s[i, j], 4) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:k]] for i in range(len(x))}


def check(found, want):
    got = {}
    for r in found.orderBy("id", "rank").collect():
        assert r["id"] != r["other"]
        got.setdefault(r["id"], []).append(r["score"])
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=2e-4) for k in want)


def test_neighbours_small_and_blocked(cloud):
    x, df = cloud
    want = brute(x, 5)
    check(V.related(df, "id", "v", 5), want)
    rows = df.select(F.col("id"), V.unit(F.col("v")).alias("v"))
    check(V._related_blocked(rows, "id", 5, 7, 4), want)


def test_neighbours_beyond_one_matrix(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 8)), 75, 0) + rng.normal(size=(4500, 8)) * 0.3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, 1)[:, :5]
    check(V.related(df, "id", "v", 5, block=400), {i: s[i, want[i]].round(4).tolist() for i in range(len(x))})
    got = {}
    for r in V.related_approximate(df, "id", "v", 5).collect():
        got.setdefault(r["id"], set()).add(r["other"])
        assert abs(r["score"] - s[r["id"], r["other"]]) < 2e-4
    assert np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(len(x))]) >= 0.9


def test_approximate_neighbours_of_few_and_of_copies(cloud, spark):
    x, df = cloud
    check(V.related_approximate(df, "id", "v", 5, lists=4, probes=4, parts=4, rerank=40, block=9), brute(x, 5))
    assert V.related_approximate(df.limit(0), "id", "v").collect() == []
    assert V.related_approximate(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], df.schema), "id", "v").collect() == []


@pytest.mark.parametrize("judged,sign", [(32768, 1.0), (7, -1.0)])
def test_ranks_of_judged_documents_are_counted(cloud, spark, judged, sign):
    x, df = cloud
    docs = df.select(F.col("id").alias("doc_id"), F.col("v").alias("vector")).repartition(5)
    queries = df.filter("id IN (0, 31, 150)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    qrels = spark.createDataFrame([(q, d, 1) for q in (0, 31, 150, 999) for d in range(q % 7, 190, 6)], "query_id long, doc_id long, grade int")
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    got = {(r["query_id"], r["doc_id"]): r["rank"] for r in R.judged_ranks(queries, docs, qrels, sign=sign, judged=judged).collect()}
    want = {}
    for q in (0, 31, 150):
        s = np.round(sign * (u @ u[q]), 12)
        order = sorted(range(len(x)), key=lambda d: (-s[d], d))
        want |= {(q, d): order.index(d) + 1 for d in range(q % 7, 190, 6) if d < len(x)}
    # Copies of one vector stand in order of their ids.
    assert got == want
    assert R.judged_ranks(queries, docs, qrels.limit(0)).collect() == []


def test_many_judgements_are_ranked_in_one_pass_over_the_documents(cloud, spark):
    x, df = cloud
    docs = df.select(F.col("id").alias("doc_id"), F.col("v").alias("vector"))
    queries = df.filter("id IN (0, 31, 150)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    qrels = spark.createDataFrame([(q, d) for q in (0, 31, 150) for d in range(0, len(x), 2)], "query_id long, doc_id long")
    many = R.judged_ranks(queries, docs, qrels, judged=7)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    want = sorted(R.judged_ranks(queries, docs, qrels).collect())
    assert sorted(many.collect()) == want
    # Blocks of sorted scores and several passes of queries give the same ranks; copies of a row share one.
    q, d = (f.select(F.col(c), R.unit(F.col("vector")).alias(v)) for f, c, v in ((queries, "query_id", "qv"), (docs, "doc_id", "dv")))
    assert sorted(R._sorted_ranks(q, d, qrels, 1.0, queries=2, limit=10).collect()) == want
    twice = sorted(R._sorted_ranks(q, d.union(d), qrels, 1.0, limit=10).collect())
    assert twice == [r for w in want for r in [(*w[:3], 2 * w[3] - 1)] * 2]


def test_search_ranks_and_only_the_tool_clamps(cloud):
    x, df = cloud
    q = df.filter("id IN (0, 60)").select(F.col("id").alias("q"), "v")
    assert V.search_tool(q, df, "q", "id", "v", 500).count() == 100
    assert V.search(q, df, "q", "id", "v", 500).count() == 2 * len(x)
    with pytest.raises(ValueError):
        V.search(q, df, "q", "id", "v", 0)
    top = V.search(q, df, "q", "id", "v", 1).collect()
    assert {r["q"]: r["id"] for r in top} == {0: 0, 60: 60}


def test_concept_vector_prefers_the_positive_pole(rows):
    df = rows([([1.0, 0.0], ["a", "b"]), ([0.0, 1.0], ["b"])], "v array<double>, l array<string>")
    got = V.concept_vector(df, "v", "l", ["a"], ["b"]).first()["vector"]
    assert np.allclose(got, [2 ** -0.5, -(2 ** -0.5)])
    with pytest.raises(ValueError):
        V.concept_vector(df, "v", "l", ["a"], ["b"], min_positive=5)


def test_ndcg_of_an_ideal_ranking_is_one(rows):
    run = rows([("q", i, i + 1) for i in range(20)] + [("z", i, i + 1) for i in range(3)], "query_id string, doc_id int, rank int")
    rel = rows([("q", 0, 2), ("q", 1, 1), ("q", 2, 0), ("z", 99, 1)], "query_id string, doc_id int, grade int")
    got = {r["query_id"]: r for r in R.ir_metrics(run, rel).collect()}
    assert abs(got["q"]["ndcg"] - 1) < 1e-12 and got["q"]["p5"] == 0.4 and got["q"]["rk"] == 1.0 and got["q"]["mrr"] == 1.0
    assert got["z"]["ndcg"] == 0.0 and got["z"]["mrr"] == 0.0


def test_compare_runs_dead_band(rows):
    sch = "level string, name string, " + ", ".join(f"{m} double" for m in R.METRICS)
    a = rows([("overall", "all", 0.1, 0.1, 0.1, 0.1, 0.1)], sch)
    b = rows([("overall", "all", 0.1005, 0.2, 0.0, 0.1, 0.1)], sch)
    got = {r["metric"]: r["verdict"] for r in R.compare_runs(a, b).collect()}
    assert (got["p5"], got["pk"], got["rk"]) == ("same", "better", "worse")


def test_clusters_elbow_and_components(cloud):
    x, df = cloud
    out, cost = V.kmeans(df, "id", "v", 5, restarts=2)
    assert out.count() == len(x) and abs(out.agg(F.sum("distance2")).first()[0] - cost) < 1e-6 * max(1, cost)
    e = {r["k"]: r["inertia"] for r in V.elbow(df, "v", (1, 2, 4)).collect()}
    assert e[1] >= e[2] >= e[4] and abs(e[1] - ((x - x.mean(0)) ** 2).sum()) < 1e-6 * e[1]
    scores, comp = V.pca_dimensions(df, "id", "v", 3)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    got = [r["explained"] for r in comp.orderBy("component").collect()]
    assert np.allclose(got, (s**2 / (s**2).sum())[:3])
    assert all(max(r["loadings"], key=abs) > 0 for r in comp.collect())


def test_sparse_components_match_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.random((30, 12)) * (rng.random((30, 12)) > 0.4)
    x[:, 0] *= 5
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]], "r int, c int, w double")
    got = np.array([(r["pc1"], r["pc2"]) for r in V.pca_long(long, "r", "c", "w", 2).orderBy("r").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert abs(abs(np.corrcoef(got[:, 0], u[:, 0] * s[0])[0, 1]) - 1) < 1e-4
    assert abs((got**2).sum() - (s[:2] ** 2).sum()) < 1e-2 * (s[:2] ** 2).sum()


def test_concept_contexts(rows):
    s = rows([(i, f"ordet krig{i} er her") for i in range(5)] + [(9, "fred")], "sid int, sentence string")
    v = rows([(i, [1.0, float(i)]) for i in range(5)] + [(9, [0.0, 1.0])], "sid int, vector array<double>")
    centre, near = V.concept_contexts(rows([("krig",), ("fred",), ("rig",)], "term string"), s, v, "sid")
    got = {r["term"]: list(r["vector"]) for r in centre.collect()}
    assert set(got) == {"krig", "fred"} and np.allclose(got["krig"], np.array([1, 2]) / 5**0.5)
    assert near.count() == 2


def test_concept_contexts_make_the_hits_once(rows, monkeypatch):
    s = rows([(i, f"Ordet krig{i} er her, krig og fred") for i in range(50)] * 2, "sid int, sentence string")
    v = rows([(i, [1.0, float(i)]) for i in range(50)], "sid int, vector array<double>")
    terms, pinned, real = rows([("Krig",), ("fred",), ("",), (None,)], "term string"), [], V.pin
    monkeypatch.setattr(V, "pin", lambda df: pinned.append(df.columns) or real(df))
    got = []
    for few in (64, 0):
        monkeypatch.setattr(V, "TERMS_IN_ROW", few)
        centre, near = V.concept_contexts(terms, s, v, "sid")
        got.append((sorted((r["term"], *np.round(r["vector"], 9), r["sentence"]) for r in centre.collect()), sorted(near.collect())))
    assert got[0] == got[1] and [g[0] for g in got[0][0]] == ["Krig", "fred"]
    # Every second one of 50 rows, 20 of them.
    assert np.allclose(got[0][0][0][1:3], np.array([1, 19]) / 362**0.5)
    # The rows that are sorted and sampled hold no sentence.
    assert pinned[0] == ["term", "sid", "_h"]


def test_approximate_neighbours_hold_few_distances(cloud, monkeypatch):
    x, df = cloud
    want = sorted(V.related_approximate(df, "id", "v", 5).collect())
    monkeypatch.setattr(V, "DISTANCES", 2560)
    assert sorted(V.related_approximate(df, "id", "v", 5).collect()) == want


def pairs_by_hand(docs, least):
    w = {}
    for d in docs.values():
        for a, b in itertools.combinations(sorted(d), 2):
            w[(a, b)] = w.get((a, b), 0) + 1
    return {k: v for k, v in w.items() if v >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("heavy", [2, 5, 256])
def test_edges_with_large_documents(spark, least, heavy):
    rng = np.random.default_rng(heavy)
    docs = {d: set(rng.choice(15, size=rng.integers(1, 12), replace=False).tolist()) for d in range(12)}
    docs[99] = set(range(15))
    df = spark.createDataFrame([(d, e, "2020-01-01") for d, es in docs.items() for e in es], "doc int, id int, date string")
    df = df.withColumn("date", F.col("date").cast("date"))
    got = G.comention_edges(G.pair_years(df, min_weight=least, heavy=heavy))
    assert {(r["a"], r["b"]): r["weight"] for r in got.collect()} == pairs_by_hand(docs, least)


def graph(spark, edges, n):
    e = spark.createDataFrame(edges, "a int, b int, weight long")
    return spark.createDataFrame([(i,) for i in range(n)], "id int"), e


def test_components(spark):
    nodes, e = graph(spark, [(0, 1, 1), (1, 2, 1), (5, 6, 1), (6, 7, 1), (7, 5, 1), (8, 3, 1), (3, 4, 1)] + [(i, i + 1, 1) for i in range(20, 60)], 61)
    got = {r["id"]: r["component"] for r in G.components(nodes, e).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 7, 8, 9)] == [0, 0, 0, 3, 3, 5, 5, 3, 9]
    assert all(got[i] == 20 for i in range(20, 61))
    s = G.graph_summary(nodes, e).first()
    assert s["nodes"] == 61 and s["edges"] == 47 and s["components"] == len(set(got.values()))


def test_pagerank_sums_to_one_and_matches_power_iteration(spark):
    edges = [(0, 1, 3), (1, 2, 1), (2, 0, 2), (2, 3, 5)]
    nodes, e = graph(spark, edges, 6)
    got = np.array([r["pagerank"] for r in G.pagerank(nodes, e, tol=1e-10).orderBy("id").collect()])
    w = np.zeros((6, 6))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    s = w.sum(1)
    r = np.full(6, 1 / 6)
    for _ in range(300):
        r = 0.85 * ((r / np.where(s > 0, s, 1)) @ w + r[s == 0].sum() / 6) + 0.15 / 6
    assert abs(got.sum() - 1) < 1e-9 and np.allclose(got, r, atol=1e-8)


def brute_betweenness(n, edges, cost):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    c = {}
    for a, b, w in edges:
        c[a, b] = c[b, a] = cost(w)
        d[a, b] = d[b, a] = cost(w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])

    def count(s, t):
        if s == t:
            return 1
        return sum(count(s, u) for u in range(n) if (u, t) in c and abs(d[s, u] + c[u, t] - d[s, t]) < 1e-9)

    out = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        if np.isfinite(d[s, t]):
            for v in set(range(n)) - {s, t}:
                if abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9:
                    out[v] += count(s, v) * count(v, t) / count(s, t)
    return out * 2 / ((n - 1) * (n - 2))


@pytest.mark.parametrize("batches", [1, 3])
def test_betweenness(spark, batches):
    edges = [(0, 1, 1), (1, 2, 2), (0, 3, 1), (3, 2, 2), (2, 4, 1), (4, 5, 4), (2, 5, 1)]
    nodes, e = graph(spark, edges, 7)
    for cost, f in (("1/weight", lambda w: 1 / w), ("weight", float)):
        got = np.array([r["betweenness"] for r in G.betweenness(nodes, e, cost, batches).orderBy("id").collect()])
        assert np.allclose(got, brute_betweenness(7, edges, f))


def test_sampled_betweenness_stays_within_its_bound(spark):
    rng = np.random.default_rng(11)
    # Two rings of 40 that meet in one node: its betweenness is far above all others.
    edges = [(a, (a + 1) % 40, 1) for a in range(40)] + [(40 + a, 40 + (a + 1) % 40, 1) for a in range(40)] + [(0, 40, 1), (0, 60, 1)]
    edges += [(int(a), int(b), 1) for a, b in rng.integers(0, 40, (6, 2)) if abs(a - b) > 1 and {a, b} != {0, 39}]
    edges = [(min(a, b), max(a, b), w) for a, b, w in dict.fromkeys(edges)]
    nodes, e = graph(spark, edges, 81)
    exact = {r["id"]: r["betweenness"] for r in G.betweenness(nodes, e).collect()}
    found = G.betweenness_sampled(nodes, e, 0.25, 0.05).collect()
    assert {r["sources"] for r in found} == {G.sample_size(81, 0.25, 0.05)} and found[0]["sources"] < 81
    assert max(exact.values()) > 0.4
    assert all(abs(r["betweenness"] - exact[r["id"]]) <= 0.25 * 81 / 80 for r in found)
    every = G.betweenness_sampled(nodes, e, 0.01).collect()
    assert all(r["sources"] == 81 and abs(r["betweenness"] - exact[r["id"]]) < 1e-9 for r in every)


def test_betweenness_of_a_held_graph_needs_no_relational_state(rows, monkeypatch):
    rng = np.random.default_rng(4)
    # Two parts with equal paths, a node without edges, one named twice and one without a name.
    edges = {(int(min(a, b)), int(max(a, b))): int(w) for a, b, w in rng.integers(0, (14, 14, 4), (40, 3)) + (0, 0, 1) if a != b}
    edges |= {(15, 16): 2, (16, 17): 1, (15, 18): 2, (17, 18): 1}
    nodes = rows([(i,) for i in range(20)], "id long")
    e = rows([(a, b, w) for (a, b), w in edges.items()] + [(None, 3, 1), (3, None, 1), (4, 5, None)], "a long, b long, weight long")
    used = []
    monkeypatch.setattr(G, "_dependencies", lambda *a: used.append(1) or e.limit(0).select(F.col("a").alias("id"), F.lit(0.0).alias("d")))
    for cost, f in (("1/weight", lambda w: 1 / w), ("weight", float)):
        got = np.array([r["betweenness"] for r in G.betweenness(nodes, e, cost).orderBy("id").collect()])
        assert not used and np.allclose(got, brute_betweenness(20, [(*k, w) for k, w in edges.items()], f)) and got.max() > 0
    odd = {(r["id"], r["betweenness"]) for r in G.betweenness(nodes.unionByName(rows([(3,), (None,)], "id long")), e, "weight").collect()}
    assert {k: v * 20 * 21 for k, v in odd} == pytest.approx({None: 0.0} | {i: v * 18 * 19 for i, v in enumerate(got)})
    # A larger graph is worked in batches.
    monkeypatch.setattr(G, "GRAPH_ARCS", 10)
    G.betweenness(nodes, e).collect()
    assert used
