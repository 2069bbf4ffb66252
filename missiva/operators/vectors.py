"""Concept vectors, projections, exact neighbours, search, clusters and components."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.operators.scale import bounded_broadcast, top_rows
from missiva.session import pin

MATRIX_ROWS = 4096
#: Vectors of one band of the exact neighbour search.
BAND_ROWS = 65_536
#: Distinct terms that are looked for in the sentence itself.
TERMS_IN_ROW = 64
#: Distances or similarities that a task of the approximate search holds at once.
DISTANCES = 500_000
#: Columns of a long table that a round of its principal components broadcasts, about 100 bytes each.
BROADCAST_COLUMNS = 1_000_000
#: Weights of a task of those rounds.
WEIGHTS_PER_TASK = 8_000_000


def vector_means(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per key; sums are combined per dimension before the shuffle."""
    long = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    out = means.groupBy(*keys).agg(ordered.alias("_v"))
    return out.select(*keys, F.transform("_v", lambda s: s["_m"]).alias(vector))


def norm(col):
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(col):
    """Vector of length one; a zero vector stays."""
    n = norm(col)
    return F.transform(col, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def dot(a, b):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def concept_vector(
    vectors: DataFrame, vector: str, labels: str, positive: Sequence, negative: Sequence,
    min_positive: int = 1, min_negative: int = 1,
) -> DataFrame:
    """Unit vector from the negative pole's mean to the positive one's; a row with both labels is positive."""
    pos = F.arrays_overlap(labels, F.array(*[F.lit(p) for p in positive]))
    neg = ~pos & F.arrays_overlap(labels, F.array(*[F.lit(n) for n in negative]))
    rows = vectors.select(F.when(pos, "pos").when(neg, "neg").alias("_pole"), F.col(vector).alias("_v")).filter("_pole IS NOT NULL")
    size = {r[0]: r[1] for r in rows.groupBy("_pole").count().collect()}
    if size.get("pos", 0) < min_positive or size.get("neg", 0) < min_negative:
        raise ValueError(f"pole too small: {size}")
    side = lambda s: F.avg(F.when(F.col("_pole") == s, F.col("_x")))
    diff = rows.select("_pole", F.posexplode("_v").alias("_i", "_x")).groupBy("_i").agg((side("pos") - side("neg")).alias("_d"))
    whole = diff.agg(F.array_sort(F.collect_list(F.struct("_i", "_d"))).alias("_a"))
    return whole.select(unit(F.transform("_a", lambda s: s["_d"])).alias("vector"))


def matrix_of(df: DataFrame, name: str, vector: str) -> tuple[list, np.ndarray]:
    """A table of at most MATRIX_ROWS vectors as a matrix; larger ones are refused, callers chunk."""
    rows = df.select(name, vector).orderBy(name).limit(MATRIX_ROWS + 1).collect()
    if len(rows) > MATRIX_ROWS:
        raise ValueError(f"more than {MATRIX_ROWS} vectors on the small side")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def project(vectors: DataFrame, key: str, vector: str, concepts: DataFrame, name: str = "name", concept: str = "vector") -> DataFrame:
    """Dot product of every vector with every concept, long form; one matrix product per Arrow batch."""
    names, m = matrix_of(concepts, name, concept)
    kt, nt = dict(vectors.dtypes)[key], dict(concepts.dtypes)[name]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = np.stack(pdf[vector].to_numpy()).astype(np.float64) @ m.T
                yield pd.DataFrame(
                    {key: np.repeat(pdf[key].to_numpy(), len(names)), name: names * len(pdf), "score": s.ravel()}
                )

    return vectors.select(key, vector).mapInPandas(work, f"{key} {kt}, {name} {nt}, score double")


def cosine_matrix(vectors: DataFrame, name: str, vector: str, low: float = 0.15, high: float = 0.30) -> DataFrame:
    """Cosine of each pair of a small vector table with an independence class."""
    u = vectors.select(F.col(name).alias("a"), unit(F.col(vector)).alias("v"))
    sims = project(u, "a", "v", u.select(F.col("a").alias("b"), "v"), "b", "v").filter(F.col("a") < F.col("b"))
    size = F.abs("score")
    kind = F.when(size < low, "independent").when(size < high, "weak").otherwise("dependent")
    return sims.select("a", "b", F.col("score").alias("cosine"), kind.alias("relation"))


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest similarities per row, ties to the smaller id."""
    if sims.shape[1] > 4 * k + 32:
        part = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
        cand = [np.flatnonzero(row >= t) for row, t in zip(sims, part)]
    else:
        cand = [np.arange(sims.shape[1])] * len(sims)
    return [c[np.lexsort((ids[c], -row[c]))][:k] for row, c in zip(sims, cand)]


def _best(x: np.ndarray, xid: np.ndarray, y: np.ndarray, yid: np.ndarray, k: int) -> list[tuple]:
    """k best partners of every x among y, in slices that bound the similarity matrix."""
    step, out = max(1, 16_000_000 // max(1, len(y))), []
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ y.T
        s[xid[lo : lo + step, None] == yid[None, :]] = -2.0
        for i, js in enumerate(_top(s, yid, k)):
            out += [(xid[lo + i], yid[j], s[i, j]) for j in js if s[i, j] > -2.0]
    return out


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def related(vectors: DataFrame, key: str, vector: str, k: int = 5, block: int = 2000, dp: int = 4) -> DataFrame:
    """Exact k nearest neighbours by cosine, self excluded.

    Copies of one vector are searched once. Distinct vectors go to the cell of their
    nearest pivot, cells are cut into blocks of about `block` rows, and every block
    finds its own best k. A vector then visits another block only if the triangle
    inequality leaves room for something at least as near as its k-th find, so nothing
    is missed; a task holds two blocks at most.
    """
    rows = vectors.select(F.col(key).alias("id"), unit(F.col(vector)).alias("v"))
    if vectors.limit(MATRIX_ROWS + 1).count() <= MATRIX_ROWS:
        return _related_small(rows, key, k, dp)
    return _related_blocked(rows, key, k, block, dp)


def _related_small(rows: DataFrame, key: str, k: int, dp: int) -> DataFrame:
    """All vectors fit one checked matrix: every Arrow batch ranks against it, nothing is shuffled."""
    names, m = matrix_of(rows, "id", "v")
    ids, kt = np.array(names), dict(rows.dtypes)["id"]

    def work(batches):
        for pdf in batches:
            if len(pdf):
                best = pd.DataFrame(_best(_stack(pdf["v"]), pdf["id"].to_numpy(), m, ids, k), columns=["id", "other", "sim"])
                best["rank"] = best.groupby("id", sort=False).cumcount() + 1
                yield best[["id", "rank", "other", "sim"]]

    out = rows.mapInPandas(work, f"id {kt}, rank int, other {kt}, sim double")
    return out.select(F.col("id").alias(key), "rank", "other", F.round("sim", dp).alias("score"))


def _distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the digest `g` of their vector, (g, rep, n) per vector, and (id, v) of each smallest id."""
    rows = pin(rows.withColumn("g", F.sha2(F.to_json("v"), 256)))
    groups = rows.groupBy("g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = rows.join(groups, (rows["id"] == groups["rep"]) & (rows["g"] == groups["g"]), "left_semi").select("id", "v")
    return rows, groups, reps


def _related_blocked(rows: DataFrame, key: str, k: int, block: int, dp: int) -> DataFrame:
    rows, groups, reps = _distinct_vectors(rows)
    n = reps.count()
    p = max(1, min(MATRIX_ROWS, int(math.sqrt(max(n, 1)) / 2)))
    block = max(block, n // MATRIX_ROWS)
    # Pivots only steer the search, any choice gives the same result: take the smallest hashes.
    pivots = reps.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(p).collect()
    piv = np.array([r[0] for r in pivots], dtype=np.float64)
    kt = dict(rows.dtypes)["id"]

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["v"])
                d2 = np.maximum(0, (x * x).sum(1)[:, None] + (piv * piv).sum(1)[None, :] - 2 * x @ piv.T)
                c = d2.argmin(1)
                yield pdf.assign(cell=c.astype(np.int32), d=np.sqrt(d2[np.arange(len(x)), c]))

    celled = pin(reps.mapInPandas(assign, f"id {kt}, v array<double>, cell int, d double"))
    size = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cut = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block)))
    blocked = celled.join(F.broadcast(size), "cell").select(
        "id", "v", "cell", "d", F.concat_ws(":", "cell", F.pmod(F.xxhash64("id"), cut).cast("string")).alias("blk")
    )
    blocked = pin(blocked)
    pair_t = f"id {kt}, other {kt}, sim double"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stack(pdf["v"]), pdf["id"].to_numpy()
        return pd.DataFrame(_best(x, ids, x, ids, k), columns=["id", "other", "sim"])

    first = pin(blocked.groupBy("blk").applyInPandas(within, pair_t))
    worst = first.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("s"))
    tau = F.when(F.col("c") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).otherwise(F.lit(9.0))
    tau = worst.select("id", tau.alias("tau"))
    # One row per block, n / block + pivots rows in all.
    shells = blocked.groupBy("blk", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("cell", "blk").collect()
    at = {r[0]: i for i, r in enumerate(shells)}
    home = np.array([r[1] for r in shells])
    lo, hi = np.array([r[2] for r in shells]), np.array([r[3] for r in shells])
    # Neighbouring blocks form a band; a task holds two bands, so a vector is sent at most once per band.
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = min(len(shells), max(math.isqrt(tasks), -(-n // BAND_ROWS)))
    band = np.arange(len(shells)) * bands // max(1, len(shells))

    def route(batches):
        for pdf in batches:
            if len(pdf):
                x, src = _stack(pdf["v"]), pdf["blk"].map(at).to_numpy()
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (piv * piv).sum(1)[None, :] - 2 * x @ piv.T))[:, home]
                gap = np.maximum(d - hi[None, :], lo[None, :] - d)
                go = gap <= pdf["tau"].to_numpy()[:, None] + 1e-9
                go[np.arange(len(x)), src] = False
                for b in range(bands):
                    inside = np.flatnonzero(band == b)
                    i = np.flatnonzero(go[:, inside].any(1))
                    if len(i):
                        to = [inside[np.flatnonzero(g)] for g in go[np.ix_(i, inside)]]
                        yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "own": band[src[i]], "band": b, "to": to})

    asked = blocked.join(tau, "id", "left").na.fill({"tau": 9.0}).select("id", "v", "blk", "tau")
    asked = pin(asked.mapInPandas(route, f"id {kt}, v array<double>, own int, band int, to array<int>"))

    def banded(batches):
        for pdf in batches:
            i = pdf["blk"].map(at).to_numpy()
            yield pdf.assign(no=i.astype(np.int32), bband=band[i].astype(np.int32))[["bid", "bv", "no", "bband"]]

    bases = blocked.select(F.col("id").alias("bid"), F.col("v").alias("bv"), "blk").mapInPandas(banded, f"bid {kt}, bv array<double>, no int, bband int")
    visits = asked.select(F.col("own").alias("bown"), F.col("band").alias("bband")).distinct()
    bases = bases.join(bounded_broadcast(visits), "bband")

    def across(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        x, ids, y, yid, no = _stack(q["v"]), q["id"].to_numpy(), _stack(b["bv"]), b["bid"].to_numpy(), b["no"].to_numpy()
        to = np.concatenate(q["to"].to_numpy())
        of = np.repeat(np.arange(len(q)), q["to"].map(len))
        out = []
        for t in np.unique(to):
            i, j = of[to == t], np.flatnonzero(no == t)
            out += _best(x[i], ids[i], y[j], yid[j], k)
        return pd.DataFrame(out, columns=["id", "other", "sim"])

    second = asked.groupBy("own", "band").cogroup(bases.groupBy("bown", "bband")).applyInPandas(across, pair_t)
    best = top_rows(first.unionByName(second), ["id"], [F.col("sim").desc(), "other"], k, "_r").drop("_r")
    return _ranked_copies(rows, groups, reps, best, key, k, dp)


def _ranked_copies(rows: DataFrame, groups: DataFrame, reps: DataFrame, best: DataFrame, key: str, k: int, dp: int) -> DataFrame:
    """Neighbours of all rows from those of one row per distinct vector."""
    if groups.filter("n > 1").limit(1).count() == 0:
        found = best
    else:
        # Copies: a group offers its k+1 smallest ids, enough for any k neighbours.
        members = top_rows(rows.select("id", "g"), ["g"], ["id"], k + 1, "_r").drop("_r")
        of = groups.select("g", F.col("rep"))
        offers = best.withColumnRenamed("id", "rep").join(of.select(F.col("rep").alias("other"), F.col("g").alias("og")), "other")
        far = offers.join(members.select(F.col("g").alias("og"), F.col("id").alias("m")), "og").select("rep", F.col("m").alias("other"), "sim")
        # A copy has similarity one, unless the vector is zero.
        self_sim = reps.select(F.col("id").alias("rep"), F.round(dot(F.col("v"), F.col("v"))).alias("sim"))
        own = of.join(self_sim, "rep").join(members, "g").select("rep", F.col("id").alias("other"), "sim")
        short = top_rows(far.unionByName(own), ["rep"], [F.col("sim").desc(), "other"], k + 1, "_r").drop("_r")
        ids = rows.select("id", "g").join(of, "g").select("id", "rep")
        found = ids.join(short, "rep").filter(F.col("id") != F.col("other")).select("id", "other", "sim")
    ranked = top_rows(found, ["id"], [F.col("sim").desc(), "other"], k)
    return ranked.select(F.col("id").alias(key), "rank", "other", F.round("sim", dp).alias("score"))


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of a plain k-means run over a bounded sample."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class ResidualCodes:
    """Inverted lists around coarse centres, and product-quantised codes of what a centre leaves of a vector."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int):
        rng = np.random.default_rng(seed)
        self.centres = _lloyd(sample, lists, 10, rng)
        left = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [_lloyd(left[:, c], 256, 8, rng) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = _nearest(x, self.centres)
        left = x - self.centres[home]
        return home, np.stack([_nearest(left[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        s = (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T
        return np.argsort(s, 1, kind="stable")[:, :n]

    def products(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the coded vectors of one list."""
        out = np.repeat((x @ self.centres[home])[:, None], len(codes), 1)
        for p, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (x[:, c] @ b.T)[:, codes[:, p]]
        return out


def related_approximate(
    vectors: DataFrame, key: str, vector: str, k: int = 5, lists: int | None = None, probes: int = 12, parts: int = 16, rerank: int = 12,
    sample: int = 16_384, block: int = 4096, seed: int = 42, dp: int = 4,
) -> DataFrame:
    """k near neighbours by cosine, self excluded: inverted lists, residual codes, then exact cosines.

    Every vector is indexed by its nearest coarse centre with one byte per part. A query visits its `probes` nearest
    lists, keeps `rerank * k` candidates by coded products, and ranks these by their full vectors; so scores are
    exact, and only neighbours in lists not visited are missed. Centres and code books are fitted on at most `sample`
    vectors with the smallest id hashes; there are about sqrt(n) lists, 4096 at most. Copies of a vector are searched
    once. Lists are cut into blocks and their queries into chunks of about `block` rows, so no task holds a crowded list.
    """
    rows = vectors.select(F.col(key).alias("id"), unit(F.col(vector)).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows, groups, reps = _distinct_vectors(rows)
    reps = pin(reps)
    n = reps.count()
    if n == 0:
        return rows.select(F.col("id").alias(key), F.lit(0).alias("rank"), F.col("id").alias("other"), F.lit(0.0).alias("score"))
    fitted = np.array([r[0] for r in reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], dtype=np.float64)
    # Sent once per executor; a few megabytes at 4096 lists.
    index = reps.sparkSession.sparkContext.broadcast(vars(ResidualCodes(fitted, lists or min(MATRIX_ROWS, max(1, math.isqrt(n))), parts, seed)))
    kt, keep = dict(rows.dtypes)["id"], rerank * k

    def loaded() -> ResidualCodes:
        codes = ResidualCodes.__new__(ResidualCodes)
        codes.__dict__.update(index.value)
        return codes

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A distance to every list is held per row, so rows are taken few at a time.
        step = max(1, DISTANCES // max(len(index.value["centres"]), 256))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                yield pdf.iloc[lo : lo + step]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            if len(pdf):
                home, codes = loaded().encode(_stack(pdf["v"]))
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "list": home.astype(np.int32), "code": [c.tobytes() for c in codes]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            if len(pdf):
                near = loaded().probes(_stack(pdf["v"]), probes).astype(np.int32)
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), near.shape[1]), "v": [v for v in pdf["v"] for _ in range(near.shape[1])], "list": near.ravel()})

    coded = pin(reps.mapInPandas(encode, f"id {kt}, list int, code binary"))
    asked = pin(reps.mapInPandas(ask, f"id {kt}, v array<double>, list int"))
    # At most MATRIX_ROWS rows.
    cut = lambda d, name: d.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    plan = F.broadcast(cut(coded, "blocks").join(cut(asked, "chunks"), "list"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = coded.join(plan, "list").select("list", deal("blocks").alias("b"), upto("chunks").alias("c"), F.col("id").alias("other"), "code")
    wanted = asked.join(plan, "list").select("list", upto("blocks").alias("b"), deal("chunks").alias("c"), "id", "v")

    def scan(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        x, ids, others = _stack(q["v"]), q["id"].to_numpy(), s["other"].to_numpy()
        codes = np.frombuffer(b"".join(s["code"]), np.uint8).reshape(len(s), -1)
        out, step = [], max(1, DISTANCES // max(len(s), 256))
        for a in range(0, len(x), step):
            sims = loaded().products(x[a : a + step], int(q["list"].iloc[0]), codes)
            sims[ids[a : a + step, None] == others[None, :]] = -9.0
            top = [js[sims[i, js] > -9.0] for i, js in enumerate(_top(sims, others, keep))]
            row, js = np.repeat(np.arange(len(top)), [len(t) for t in top]), np.concatenate(top)
            out.append(pd.DataFrame({"id": ids[a + row], "other": others[js], "sim": sims[row, js]}))
        return pd.concat(out, ignore_index=True)

    pair_t = f"id {kt}, other {kt}, sim double"
    near = wanted.groupBy("list", "b", "c").cogroup(stored.groupBy("list", "b", "c")).applyInPandas(scan, pair_t)
    near = top_rows(near, ["id"], [F.col("sim").desc(), "other"], keep, "_r").select("id", "other")
    both = near.join(reps.select(F.col("id").alias("other"), F.col("v").alias("w")), "other").join(reps, "id")
    exact = both.select("id", "other", dot(F.col("v"), F.col("w")).alias("sim"))
    best = top_rows(exact, ["id"], [F.col("sim").desc(), "other"], k, "_r").drop("_r")
    return _ranked_copies(rows, groups, reps, best, key, k, dp)


def search(
    queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vector: str, k: int | None = 10
) -> DataFrame:
    """Cosine ranking of all documents for each query vector; None for k ranks everything.

    Query vectors travel in chunks of MATRIX_ROWS; each Arrow batch keeps its best k.
    """
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    q = queries.select(query_id, unit(F.col(vector)).alias("v"))
    chunks = max(1, -(-q.count() // (MATRIX_ROWS // 2)))
    part = F.pmod(F.xxhash64(query_id), F.lit(chunks))
    parts = [_search(q.filter(part == i) if chunks > 1 else q, docs, query_id, doc_id, vector, k) for i in range(chunks)]
    hits = reduce(lambda a, b: a.unionByName(b), parts)
    return hits if k is None else top_rows(hits, [query_id], [F.col("score").desc(), doc_id], k)


def search_tool(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vector: str, k: int = 10) -> DataFrame:
    """`search` as a tool offers it: k is taken into 1 to 50, whatever was asked for."""
    return search(queries, docs, query_id, doc_id, vector, min(max(k, 1), 50))


def _search(q: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vector: str, k: int | None) -> DataFrame:
    names, m = matrix_of(q, query_id, "v")
    qt, dt = dict(q.dtypes)[query_id], dict(docs.dtypes)[doc_id]
    qn = np.array(names)

    def work(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = _stack(pdf[vector]), pdf[doc_id].to_numpy()
            n = np.linalg.norm(x, axis=1)
            s = m @ (x / np.where(n > 0, n, 1)[:, None]).T
            if k is None:
                yield pd.DataFrame({query_id: np.repeat(qn, len(ids)), doc_id: np.tile(ids, len(qn)), "score": s.ravel()})
            else:
                out = [(qn[i], ids[j], s[i, j]) for i, js in enumerate(_top(s, ids, k)) for j in js]
                yield pd.DataFrame(out, columns=[query_id, doc_id, "score"])

    return docs.select(doc_id, vector).mapInPandas(work, f"{query_id} {qt}, {doc_id} {dt}, score double")


def kmeans(vectors: DataFrame, key: str, vector: str, k: int = 8, restarts: int = 5, max_iter: int = 50, seed: int = 42):
    """Assignments (key, cluster, distance2) and cost of the best of several seeded runs."""
    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    best, cost = None, None
    for s in range(seed, seed + restarts):
        model = KMeans(k=k, maxIter=max_iter, seed=s, featuresCol="features", predictionCol="cluster").fit(data)
        if cost is None or model.summary.trainingCost < cost:
            best, cost = model, model.summary.trainingCost
    data.unpersist()
    centers = data.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, center array<double>")
    out = best.transform(data).select(key, "cluster", vector_to_array("features").alias("v"))
    d2 = F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.join(F.broadcast(centers), "cluster").select(key, "cluster", d2.alias("distance2")), cost


def elbow(vectors: DataFrame, vector: str, ks: Sequence[int] = tuple(range(1, 10)), seed: int = 42) -> DataFrame:
    """Cost per number of clusters; one cluster is the total squared deviation."""
    data = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(vector).alias("_v")).persist()
    rows = []
    for k in ks:
        if k == 1:
            dims = data.select(F.posexplode("_v").alias("_i", "_x")).groupBy("_i").agg((F.var_pop("_x") * F.count("_x")).alias("_s"))
            rows.append((1, float(dims.agg(F.sum("_s")).first()[0])))
        else:
            model = KMeans(k=k, seed=seed, featuresCol="features").fit(data)
            rows.append((k, float(model.summary.trainingCost)))
    data.unpersist()
    return data.sparkSession.createDataFrame(rows, "k int, inertia double")


def pca_dimensions(vectors: DataFrame, key: str, vector: str, n: int = 10):
    """Scores (key, component, score) and components (component, explained, cumulative, loadings).

    Vectors are centred first; the largest loading of a component is positive.
    """
    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=False).fit(data)
    centred = scaler.transform(data).select(key, "x")
    model = PCA(k=n, inputCol="x", outputCol="y").fit(centred)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(n)])
    ev = model.explainedVariance.toArray()
    comp = [(i, float(ev[i]), float(ev[: i + 1].sum()), [float(v) for v in load[:, i] * sign[i]]) for i in range(n)]
    components = data.sparkSession.createDataFrame(comp, "component int, explained double, cumulative double, loadings array<double>")
    signs = F.array(*[F.lit(float(s)) for s in sign])
    scores = model.transform(centred).select(
        key, F.posexplode(F.zip_with(vector_to_array("y"), signs, lambda a, b: a * b)).alias("component", "score")
    )
    return scores, components


def group_extremes(df: DataFrame, group: str, key: str, value: str, n: int = 20) -> DataFrame:
    """(group, side, rank, key, value): the n highest ("top") and n lowest ("bottom") values of each group, ties by key.

    One pass: a task keeps 2n rows of each group it meets, and only these are ranked together. Null values take no
    part.
    """
    kinds = dict(df.dtypes)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            up = held.sort_values([value, key], ascending=[False, True], kind="stable").groupby(group, sort=False).head(n)
            down = held.sort_values([value, key], kind="stable").groupby(group, sort=False).head(n)
            held = held.loc[up.index.union(down.index)].reset_index(drop=True)
        if held is not None:
            yield held

    few = df.select(group, key, value).filter(F.col(value).isNotNull())
    few = pin(few.mapInPandas(keep, f"{group} {kinds[group]}, {key} {kinds[key]}, {value} {kinds[value]}"))
    side = lambda name, order: top_rows(few, [group], [order, key], n).select(group, F.lit(name).alias("side"), "rank", key, value)
    return side("top", F.col(value).desc()).unionByName(side("bottom", F.col(value).asc()))


def component_report(
    scores: DataFrame, components: DataFrame, concepts: DataFrame, key: str, name: str = "name", concept: str = "vector", n: int = 20,
) -> DataFrame:
    """(component, section, rank, item, value) of the components of `pca_dimensions`.

    Sections: `explained` and `cumulative` share, `top` and `bottom` with the n extreme rows, and `concept` with the
    cosine of the component's direction and each concept vector, concepts in order of their name.
    """
    none = F.lit(None).cast("string")
    shares = [components.select("component", F.lit(c).alias("section"), F.lit(1).alias("rank"), none.alias("item"), F.col(c).alias("value")) for c in ("explained", "cumulative")]
    ends = group_extremes(scores, "component", key, "score", n).select("component", F.col("side").alias("section"), "rank", F.col(key).cast("string").alias("item"), F.col("score").alias("value"))
    directions = components.select("component", unit(F.col("loadings")).alias("_d"))
    cosines = project(directions, "component", "_d", concepts.select(name, unit(F.col(concept)).alias("_c")), name, "_c")
    cosines = top_rows(cosines, ["component"], [name], MATRIX_ROWS).select("component", F.lit("concept").alias("section"), "rank", F.col(name).cast("string").alias("item"), F.col("score").alias("value"))
    return reduce(DataFrame.unionByName, [*shares, ends, cosines])


def pca_long(
    weights: DataFrame, row: str, col: str, value: str, n: int = 2, tol: float = 1e-5, max_rounds: int = 200, extra: int = 4,
) -> DataFrame:
    """First n principal scores of a sparse long table by subspace iteration.

    For tf-idf tables whose vocabulary is too wide for a covariance matrix. Centring uses the
    column means, and only matrices of n + `extra` rows reach the driver. The weights are dealt
    by row once; where the columns fit a broadcast, a round works on the rows where they lie and
    shuffles sums per task and column only. Otherwise a round is two joins with partial sums.
    Rounds end when the residual of each of the n directions is at most `tol` of the largest
    eigenvalue; a warning tells if `max_rounds` came first. The largest loading of a component is
    positive; components beyond the rank of the table are 0.
    """
    named = pin(weights.select(F.col(row).alias("r"), F.col(col).alias("name"), F.col(value).cast("double").alias("x")))
    total, size = named.select("r").distinct().count(), named.count()
    # Columns go by number from here on.
    means = pin(named.groupBy("name").agg((F.sum("x") / total).alias("mu")).withColumn("c", F.monotonically_increasing_id()))
    known = means.count()
    small = known <= BROADCAST_COLUMNS
    near = F.broadcast if small else lambda df: df
    dealt = named.join(near(means.select("name", "c")), "name").select("r", "c", "x")
    # Every task has sums of nearly all columns: no more tasks than cores and memory ask for.
    parts = max(weights.sparkSession.sparkContext.defaultParallelism, -(-size // WEIGHTS_PER_TASK))
    w = pin(dealt.repartition(parts, "r").sortWithinPartitions("r"))
    # A fixed pseudo-random start derived from the column name.
    start = [(F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2001)) / 1000.0 - 1).alias(f"z{i}") for i in range(n + extra)]
    step = pin(means.select("c", "mu", *start))
    basis = pin(_orthonormal(step, _products(step, "z", "z", n + extra)))
    for _ in range(max_rounds):
        m = len(basis.columns) - 2
        if small:
            back = _there_and_back(w, basis, m).groupBy("c").agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in range(m)])
        else:
            back = w.join(_scores(w, basis, m, near), "r").groupBy("c").agg(*[F.sum(F.col("x") * F.col(f"p{i}")).alias(f"z{i}") for i in range(m)])
        # Centred scores sum to zero over all rows, so the mean term of X^T p vanishes.
        step = pin(basis.join(back, "c"))
        inner, gram = _products(step, "b", "z", m), _products(step, "z", "z", m)
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:n], turn[:, ::-1][:, :n]
        off = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, gram, turn) - values**2, 0))
        if off.max(initial=0) <= tol * max(values.max(initial=0), 1e-300):
            break
        basis = pin(_orthonormal(step, gram))
    else:
        warnings.warn(f"principal directions still move after {max_rounds} rounds", stacklevel=2)
    found = turn.shape[1]
    loads = pin(step.select("c", "mu", *[_mix("b", turn[:, i]).alias(f"b{i}") for i in range(found)]))
    signs = loads.join(means.select("c", "name"), "c").agg(*[F.signum(F.max_by(f"b{i}", F.struct(F.abs(F.col(f"b{i}")), "name"))).alias(f"s{i}") for i in range(found)]).first()
    out = [F.col(f"p{i}") * float(signs[i] or 1) if i < found else F.lit(0.0) for i in range(n)]
    return _scores(w, loads, found, near).select(F.col("r").alias(row), *[x.alias(f"pc{i + 1}") for i, x in enumerate(out)])


def _scores(w: DataFrame, basis: DataFrame, m: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(r, p0..): the centred rows on each direction of the basis."""
    shift = basis.agg(*[F.sum(F.col("mu") * F.col(f"b{i}")).alias(f"s{i}") for i in range(m)])
    scores = w.join(near(basis), "c").groupBy("r").agg(*[F.sum(F.col("x") * F.col(f"b{i}")).alias(f"p{i}") for i in range(m)])
    return scores.crossJoin(F.broadcast(shift)).select("r", *[(F.col(f"p{i}") - F.col(f"s{i}")).alias(f"p{i}") for i in range(m)])


def _there_and_back(w: DataFrame, basis: DataFrame, m: int) -> DataFrame:
    """(c, z0..): every weight times its row's centred scores on the basis, for rows that lie together.

    The broadcast join keeps the order of the weights, so a row is a run of a task's records.
    """
    shift = np.array(basis.agg(*[F.sum(F.col("mu") * F.col(f"b{i}")) for i in range(m)]).first(), dtype=float)
    met = w.filter(F.col("r").isNotNull()).join(F.broadcast(basis.drop("mu")), "c").select("r", "c", "x", *[f"b{i}" for i in range(m)])

    def turned(records: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x = records.column("x").to_numpy()
        on = np.stack([records.column(f"b{i}").to_numpy() for i in range(m)])
        scores = np.add.reduceat(x * on, starts, axis=1) - shift[:, None]
        z = x * np.repeat(scores, np.diff(np.append(starts, len(x))), axis=1)
        return pa.RecordBatch.from_arrays([records.column("c").combine_chunks(), *map(pa.array, z)], names=["c", *[f"z{i}" for i in range(m)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            records = pa.Table.from_batches([*held, batch])
            rows = records.column("r").combine_chunks()
            starts = np.append(0, np.flatnonzero(pc.not_equal(rows[1:], rows[:-1]).to_numpy(zero_copy_only=False)) + 1)
            # The last row may go on in the next batch.
            held = records.slice(int(starts[-1])).to_batches()
            if len(starts) > 1:
                yield turned(records.slice(0, int(starts[-1])), starts[:-1])
        if held:
            yield turned(pa.Table.from_batches(held), np.array([0]))

    return met.mapInArrow(run, ", ".join(["c long", *[f"z{i} double" for i in range(m)]]))


def _products(df: DataFrame, a: str, b: str, m: int) -> np.ndarray:
    """The m x m sums of products of the columns a0.. and b0.., which are symmetric up to rounding."""
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = df.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{j}")) for i, j in pairs]).first()
    out = np.zeros((m, m))
    for (i, j), x in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = x or 0.0
    return out


def _mix(prefix: str, weights: np.ndarray) -> Column:
    return sum((F.col(f"{prefix}{i}") * float(x) for i, x in enumerate(weights)), F.lit(0.0))


def _orthonormal(step: DataFrame, gram: np.ndarray) -> DataFrame:
    """(c, mu, b0..): orthonormal columns that span z0.., fewer of them where those are dependent."""
    size, turn = np.linalg.eigh(gram)
    real = size > 1e-12 * max(size.max(initial=0), 1e-300)
    turn = turn[:, real] / np.sqrt(size[real])
    return step.select("c", "mu", *[_mix("z", turn[:, j]).alias(f"b{j}") for j in range(turn.shape[1])])


def seed_pole_check(scores: DataFrame, pole: str, score: str) -> DataFrame:
    """Mean and population deviation of the scores of each pole; the positive mean must exceed the negative."""
    return scores.groupBy(pole).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"),
        F.avg((F.col(score) > 0).cast("double")).alias("positive_share"),
    )


def cluster_profile(assignments: DataFrame, meta: DataFrame, key: str, nearest: int = 3) -> DataFrame:
    """Size, mean score, top sender and recipient, years, upper median year and nearest members, long by rank."""
    rows = assignments.join(meta, key)
    base = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("mean"), 1).alias("mean_score"),
        F.min(F.year("date")).alias("year_min"), F.max(F.year("date")).alias("year_max"),
    )
    out = base
    for who in ("sender", "recipient"):
        top = rows.groupBy("cluster", who).agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(
            F.min(F.struct((-F.col("k")).alias("k"), who)).alias("m")
        )
        out = out.join(top.select("cluster", F.col(f"m.{who}").alias(f"top_{who}")), "cluster")
    years = rows.groupBy("cluster", F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    # Years of one cluster are few rows, so this window is small.
    from pyspark.sql import Window

    w = Window.partitionBy("cluster").orderBy("y")
    cum = years.withColumn("hi", F.sum("k").over(w)).join(base.select("cluster", "size"), "cluster")
    median = cum.filter(F.col("hi") > F.floor(F.col("size") / 2)).groupBy("cluster").agg(F.min("y").alias("median_year"))
    near = top_rows(rows, ["cluster"], ["distance2", key], nearest, "_r").groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda s: s[key].cast("string")), "|").alias("nearest")
    )
    return out.join(median, "cluster").join(near, "cluster")


def concept_contexts(
    terms: DataFrame, sentences: DataFrame, vectors: DataFrame, key: str, n: int = 20, k: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Centroid of an even sample of the sentences a term starts a word of, and its nearest terms.

    terms(term), sentences(key, sentence), vectors(key, vector).
    """
    from missiva.functions import text as T
    from missiva.operators.series import even_sample, pick_example

    named = terms.select("term", F.lower("term").alias("_p")).filter(F.length("_p") > 0)
    starts = [r[0] for r in named.select("_p").distinct().limit(TERMS_IN_ROW + 1).collect()]
    if len(starts) <= TERMS_IN_ROW:
        # Few terms are looked for where the sentence lies; only those found become rows.
        known = F.array(*[F.lit(p) for p in starts]).cast("array<string>")
        found = sentences.withColumn("_w", T.words(F.lower("sentence")))
        found = found.withColumn("_f", F.filter(known, lambda p: F.exists("_w", lambda w: F.startswith(w, p))))
        met = found.select(key, "sentence", F.explode("_f").alias("_p"))
    else:
        # Prefix matches are equi-joins on the prefixes of each word up to the longest term.
        words = sentences.select(key, "sentence", F.explode(F.array_distinct(T.words(F.lower("sentence")))).alias("w"))
        longest = named.agg(F.max(F.length("_p"))).first()[0]
        prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("w"), F.lit(longest))), lambda i: F.substring(F.col("w"), F.lit(1), i))
        met = words.withColumn("_p", F.explode(prefixes))
    # Sample and sizes read the hits, so these are made once and leave the sentences where they are.
    hits = pin(met.join(bounded_broadcast(named), "_p").select("term", key, F.xxhash64("sentence").alias("_h")).distinct())
    few = pin(even_sample(hits, ["term"], [key, "_h"], n))
    texts = sentences.select(F.col(key).alias("_k"), "sentence", F.xxhash64("sentence").alias("_s"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_s"))
    texts = texts.join(bounded_broadcast(few.select(key, "_h").distinct()), same, "left_semi").distinct()
    some = bounded_broadcast(pin(few.join(texts, same).select("term", key, "sentence")))
    example = pick_example(some, ["term"], "sentence", key)
    centre = vector_means(some.join(vectors, key), ["term"], "vector")
    centre = centre.select("term", unit(F.col("vector")).alias("vector"))
    near = related(centre, "term", "vector", k)
    return centre.join(example.select("term", "sentence"), "term"), near


# Cluster labels by median year, then by mean score; None is open.
CLUSTER_LABELS = (
    (None, 1914, 20, None, "Førkrigstid, lys tone"),
    (None, 1914, None, None, "Tidlige breve"),
    (1914, 1916, None, 12, "Tidlig krig, alvorlig tone"),
    (1914, 1916, 22, None, "Tidlig krig, positiv tone"),
    (1914, 1916, None, None, "Tidlig krigsperiode"),
    (1916, 1918, None, 12, "Midt i krigen, tung stemning"),
    (1916, 1918, 22, None, "Midt i krigen, lys stemning"),
    (1916, 1918, None, None, "Midterste krigsår"),
    (1918, None, None, 12, "Sen krig, alvorlig tone"),
    (1918, None, 22, None, "Sen krig, håbefuld tone"),
    (1918, None, None, None, "Sene krigsbreve"),
)


def cluster_label(profile: DataFrame, rules: Sequence[tuple] = CLUSTER_LABELS) -> DataFrame:
    """Label of each cluster: first rule whose half-open year and score ranges fit, with the years added."""
    year, mean = F.col("median_year"), F.col("mean_score")
    label = F.lit("")
    for y0, y1, s0, s1, text in reversed(rules):
        fits = F.lit(True)
        for col, lo, hi in ((year, y0, y1), (mean, s0, s1)):
            fits = fits & (col >= lo if lo is not None else F.lit(True))
            fits = fits & (col < hi if hi is not None else F.lit(True))
        label = F.when(fits, text).otherwise(label)
    years = F.concat(F.lit(" ("), F.col("year_min").cast("string"), F.lit("-"), F.col("year_max").cast("string"), F.lit(")"))
    return profile.withColumn("label", F.concat(label, years))
