"""Retrieval metrics over ranked runs and graded judgements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.operators.scale import GROUP_LIMIT, number_rows, ordered_blocks, top_rows
from missiva.operators.vectors import MATRIX_ROWS, unit
from missiva.session import pin

METRICS = ("p5", "pk", "rk", "mrr", "ndcg")
#: Judgements that are ranked by counting; they and their queries' vectors go to every task.
JUDGED = 32_768


def rank_run(scores: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(query_id, doc_id, score) to a full ranking, ties by document."""
    return number_rows(scores, ["query_id"], [F.col("score").desc(), "doc_id"], "rank", limit)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products that are the same for a pair of vectors wherever it stands in a batch."""
    return np.add.reduce(x * q, axis=1)


def judged_ranks(
    queries: DataFrame, docs: DataFrame, qrels: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector",
    sign: float = 1.0, judged: int = JUDGED,
) -> DataFrame:
    """(query_id, doc_id, score, rank) of every judged document in the cosine ranking of all documents, ties by document.

    A judged document's rank is the number of documents above it and one. Up to `judged` judgements travel sorted;
    every task places its documents among them by bisection, and the counts are added. More of them are cheaper to
    rank with all documents: scores are made once, and sorted in blocks. `sign` -1 ranks from the other end. Ids are
    unique in `queries` and in `docs`.
    """
    q = pin(queries.select(F.col(query_id).alias("query_id"), unit(F.col(vector)).alias("qv")).dropna())
    d = docs.select(F.col(doc_id).alias("doc_id"), unit(F.col(vector)).alias("dv")).dropna()
    asked = qrels.select("query_id", "doc_id").distinct().join(q.select("query_id"), "query_id", "left_semi")
    pairs = asked.join(d, "doc_id")
    n = pairs.count()
    if n == 0:
        return pairs.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    return _counted_ranks(q, d, pin(pairs), sign) if n <= judged else _sorted_ranks(q, d, pin(asked), sign)


def _counted_ranks(q: DataFrame, d: DataFrame, pairs: DataFrame, sign: float) -> DataFrame:
    """Ranks by counting, for judgements that one broadcast holds."""
    spark = d.sparkSession
    dt = dict(d.dtypes)["doc_id"]
    ours = {r["query_id"]: np.array(r["qv"]) for r in q.join(F.broadcast(pairs.select("query_id").distinct()), "query_id", "left_semi").collect()}
    held: dict = {}
    for r in pairs.select("query_id", "doc_id", "dv").toLocalIterator():
        held.setdefault(r["query_id"], []).append((float(sign * _scores(np.array([r["dv"]]), ours[r["query_id"]])[0]), r["doc_id"]))
    lists = []
    for name, marks in held.items():
        marks.sort(key=lambda m: (-m[0], m[1]))
        lists.append((name, ours[name], np.array([-m[0] for m in marks]), np.array([m[1] for m in marks])))
    sent = spark.sparkContext.broadcast(lists)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One more place for the documents below all judged ones.
        above = [np.zeros(len(low) + 1, np.int64) for _, _, low, _ in sent.value]
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = np.stack(pdf["dv"].to_numpy()).astype(np.float64), pdf["doc_id"].to_numpy()
            for (_, vector, low, docs_), count in zip(sent.value, above, strict=True):
                s = -sign * _scores(x, vector)
                at, end = np.searchsorted(low, s, "left"), np.searchsorted(low, s, "right")
                for i in np.flatnonzero(at < end):
                    # Equal scores: behind the judged documents of smaller ids, and behind itself.
                    at[i] += np.searchsorted(docs_[at[i] : end[i]], ids[i], "right")
                count += np.bincount(at, minlength=len(count))
        at = [(i, np.cumsum(c)[:-1]) for i, c in enumerate(above)]
        yield pd.DataFrame({"_q": np.concatenate([np.full(len(c), i) for i, c in at]), "_j": np.concatenate([np.arange(len(c)) for _, c in at]), "n": np.concatenate([c for _, c in at])})

    counts = d.mapInPandas(place, "_q long, _j long, n long").groupBy("_q", "_j").agg(F.sum("n").alias("n"))
    flat = [(i, j, name, docs_[j].item(), float(-low[j])) for i, (name, _, low, docs_) in enumerate(lists) for j in range(len(low))]
    named = spark.createDataFrame(pd.DataFrame(flat, columns=["_q", "_j", "query_id", "doc_id", "score"]), f"_q long, _j long, query_id {dict(q.dtypes)['query_id']}, doc_id {dt}, score double")
    return counts.join(F.broadcast(named), ["_q", "_j"]).select("query_id", "doc_id", "score", (F.col("n") + 1).alias("rank"))


def _sorted_ranks(q: DataFrame, d: DataFrame, asked: DataFrame, sign: float, queries: int = MATRIX_ROWS, limit: int = GROUP_LIMIT) -> DataFrame:
    """Ranks by sorting the scores of all documents, in passes of `queries` queries."""
    kinds = f"query_id {dict(q.dtypes)['query_id']}, doc_id {dict(d.dtypes)['doc_id']}, _s double, _judged boolean"
    # Each document goes along with the queries that judge it, so scores need no join.
    docs = pin(d.join(asked.groupBy("doc_id").agg(F.collect_list("query_id").alias("_asked")), "doc_id", "left"))
    names = asked.select("query_id").distinct()
    chunks = -(-names.count() // max(1, queries // 2))
    part = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    plain = docs.count() <= limit
    parts = []
    for c in range(chunks):
        ours = {r["query_id"]: np.array(r["qv"]) for r in q.join(names.filter(part == c), "query_id", "left_semi").collect()}
        sent = d.sparkSession.sparkContext.broadcast(ours)

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x, ids = np.stack(pdf["dv"].to_numpy()).astype(np.float64), pdf["doc_id"].to_numpy()
                lists = [a if a is not None else [] for a in pdf["_asked"]]
                rows, flat = np.repeat(np.arange(len(pdf)), [len(a) for a in lists]), [name for a in lists for name in a]
                judging: dict = {}
                for row, name in zip(rows, flat, strict=True):
                    judging.setdefault(name, []).append(row)
                for name, vector in sent.value.items():
                    marked = np.zeros(len(pdf), bool)
                    marked[judging.get(name, [])] = True
                    yield pd.DataFrame({"query_id": [name] * len(pdf), "doc_id": ids, "_s": -sign * _scores(x, vector), "_judged": marked})

        scores = docs.mapInPandas(score, kinds)
        order = ["_s", "doc_id"]
        # Copies of a row share its rank.
        if plain:
            ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
        else:
            blocks = ordered_blocks(scores, ["query_id"], order)
            sizes = blocks.groupBy("query_id", "_blk").agg(F.count(F.lit(1)).alias("_n"))
            before = Window.partitionBy("query_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
            starts = sizes.select("query_id", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
            inside = F.rank().over(Window.partitionBy("query_id", "_blk").orderBy(*order))
            ranked = blocks.withColumn("_in", inside).filter("_judged").join(starts, ["query_id", "_blk"]).withColumn("rank", F.col("_in") + F.col("_before"))
        parts.append(ranked.filter("_judged").select("query_id", "doc_id", (-F.col("_s")).alias("score"), "rank"))
    return reduce(DataFrame.unionByName, parts)


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """P@5, P@k, R@k, MRR over the whole ranking and nDCG@k for every judged query.

    `run` needs the ranks of judged documents only, as `judged_ranks` counts them.
    """
    hit = run.select("query_id", "doc_id", "rank").join(qrels, ["query_id", "doc_id"])
    rel = F.col("grade") > 0
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = hit.groupBy("query_id").agg(
        F.count_if(rel & (F.col("rank") <= 5)).alias("h5"), F.count_if(rel & (F.col("rank") <= k)).alias("hk"),
        F.min(F.when(rel, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"),
    )
    ideal = top_rows(qrels, ["query_id"], [F.col("grade").desc(), "doc_id"], k)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    total = qrels.groupBy("query_id").agg(F.count_if(rel).alias("relevant"))
    j = total.join(ideal, "query_id").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id",
        zero(F.col("h5") / 5.0).alias("p5"), zero(F.col("hk") / float(k)).alias("pk"),
        zero(F.when(F.col("relevant") > 0, F.col("hk") / F.col("relevant"))).alias("rk"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, topics: DataFrame) -> DataFrame:
    """Means per tier, per dimension and over all; topics(query_id, tier, dimension)."""
    j = per_query.join(topics, "query_id")
    aggs = [F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS]]
    # Each query counts once per level, so one pass over the metrics is enough.
    levels = (("tier", F.col("tier")), ("dimension", F.col("dimension")), ("overall", F.lit("all")))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("name")) for n, c in levels]))
    return j.withColumn("_c", cells).groupBy("_c.level", "_c.name").agg(*aggs)


def compare_runs(a: DataFrame, b: DataFrame, band: float = 0.001) -> DataFrame:
    """Metric by metric difference of two mean tables with a dead band."""
    x = a.unpivot(["level", "name"], list(METRICS), "metric", "before")
    y = b.unpivot(["level", "name"], list(METRICS), "metric", "after")
    d = F.col("after") - F.col("before")
    verdict = F.when(d > band, "better").when(d < -band, "worse").otherwise("same")
    return x.join(y, ["level", "name", "metric"]).select("level", "name", "metric", d.alias("delta"), verdict.alias("verdict"))
