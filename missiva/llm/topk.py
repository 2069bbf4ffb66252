"""Exact top-k inner products with block-at-a-time pruning.

Candidates are put in an order that brings similar vectors together and cut into ranges (blocks). A block knows the
largest and smallest value of every dimension, and a query's summed maxima bound what any vector of the block can
score. Blocks are taken in falling order of that bound and scored through their forward index (the vectors
themselves) until the next bound lies below the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import staged

BLOCK = 256
CELL = 32
QUERIES = 512
PIVOTS = 64


def scaled(vector: str | Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as longs; null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    x = F.transform(vector, lambda v: v.cast("double") * factor)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 9.0e18))
    return F.when(~bad, F.transform(F.when(~bad, x), lambda v: F.floor(v).cast("long")))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows padded with zeros to one width."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where every sum stays below 2**53, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**52 else a @ b.T


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "v", block: int = BLOCK, cell: int = CELL, chunk: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` best candidates of each row that `queries` marks.

    `vectors` holds an id and an array<long>; null ids and vectors take no part, a repeated id counts once with its
    smallest vector, and shorter vectors are filled with zeros. Every id but the query's own is a candidate; equal
    scores go to the smaller id. Scores must fit into a long.

    Cells of `cell` blocks meet chunks of `chunk` queries, both of bounded size. A query's own block sets a floor for
    its k-th score beforehand, so a cell whose bounds all lie below it is skipped unscored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = staged(rows)
    shape = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not shape[1] or not shape[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = int(shape[0])
    # At most PIVOTS vectors, picked by hash: they only shape the order, never the result.
    pivots = _matrix([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()], width)
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)

    @F.pandas_udf("pivot int, near double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            m = _matrix(list(v), width)
            s = m @ unit.T / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
            best = s.argmax(1)
            yield pd.DataFrame({"pivot": best.astype(np.int32), "near": s[np.arange(len(s)), best]})

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shape[1] // (block * 4)))
    placed = rows.select("id", "v", "q", place("v").alias("_p"))
    ordered = placed.repartitionByRange(parts, "_p.pivot", "_p.near", "id").sortWithinPartitions("_p.pivot", "_p.near", "id").select("id", "v", "q")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vs, qs, n = [], [], [], 0
        task = TaskContext.get().partitionId()

        def made():
            m = _matrix(vs, width)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([qs], pa.list_(pa.bool_()))],
                names=["block", "ids", "m", "q"],
            )

        for batch in batches:
            for i, v, q in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), batch.column("q").to_pylist(), strict=True):
                ids.append(i)
                vs.append(v)
                qs.append(q)
                if len(ids) == block:
                    yield made()
                    ids, vs, qs, n = [], [], [], n + 1
        if ids:
            yield made()

    blocks = staged(ordered.mapInArrow(cut, "block long, ids array<long>, m binary, q array<boolean>"))

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k-th best score inside its own block: a floor for its result."""
        for batch in batches:
            for b, i, m, q in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "m", "q")], strict=True):
                at = np.flatnonzero(q)
                if not len(at):
                    continue
                m = np.frombuffer(m, np.int64).reshape(-1, width)
                s = _products(m[at], m)
                low = np.iinfo(np.int64).min
                s[np.arange(len(at)), at] = low
                floor = np.sort(s, 1)[:, -k] if s.shape[1] > k else np.full(len(at), low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * len(at)), pa.array(np.array(i)[at]), pa.array([r.tobytes() for r in m[at]], pa.binary()), pa.array(floor)],
                    names=["home", "query_id", "v", "floor"],
                )

    asked = blocks.mapInArrow(first_scores, "home long, query_id long, v binary, floor long")
    # Chunks of neighbours in the order: their bounds are alike, so they skip the same cells.
    asked = staged(asked)
    n_queries, n_blocks = asked.count(), blocks.count()
    chunks, cells = max(1, -(-n_queries // chunk)), max(1, -(-n_blocks // cell))
    by_home = asked.repartitionByRange(chunks, "home", "query_id").withColumn("chunk", F.spark_partition_id()).groupBy("chunk")
    packs = staged(by_home.agg(F.collect_list(F.struct("query_id", "v", "floor")).alias("queries")))
    dealt = blocks.repartitionByRange(cells, "block").withColumn("cell", F.spark_partition_id())
    held = dealt.groupBy("cell").agg(F.collect_list(F.struct("block", "ids", "m")).alias("blocks"))
    # The stated query set against all rows, in blocks: every cell is sent once to each chunk of queries.
    grid = held.join(packs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some, asked_here = batch.column("blocks")[row].as_py(), batch.column("queries")[row].as_py()
                q = np.stack([np.frombuffer(x["v"], np.int64) for x in asked_here])
                qid = np.array([x["query_id"] for x in asked_here])
                floor = np.array([x["floor"] for x in asked_here])
                found = _search_cell(q, qid, floor, [(np.array(b["ids"]), np.frombuffer(b["m"], np.int64).reshape(-1, width)) for b in some], k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    hits = grid.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_cell(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, blocks: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the cell for each query, of those that reach its floor."""
    tops = np.stack([m.max(0) for _, m in blocks])
    lows = np.stack([m.min(0) for _, m in blocks])
    bound = _products(np.maximum(q, 0), tops) + _products(np.minimum(q, 0), lows)
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(q), 0), 0, np.int64)
    best_i = np.full((len(q), 0), 0, np.int64)
    kth = floor.copy()
    # Round r takes each query's r-th block; queries that want the same block are scored together.
    for r in range(len(blocks)):
        want = order[:, r]
        live = bound[np.arange(len(q)), want] >= kth
        if not live.any():
            break
        width = max(len(ids) for ids, _ in blocks)
        s = np.full((len(q), width), np.iinfo(np.int64).min)
        i = np.full((len(q), width), np.iinfo(np.int64).max)
        for b in np.unique(want[live]):
            rows = np.flatnonzero(live & (want == b))
            ids, m = blocks[b]
            s[rows, : len(ids)] = _products(q[rows], m)
            i[rows, : len(ids)] = ids
        own = i == qid[:, None]
        s[own], i[own] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
        keep = np.lexsort((i, -s.astype(np.float64)), axis=1)[:, :k] if np.abs(s[i < np.iinfo(np.int64).max]).max(initial=0) < 2**53 else _exact_order(s, i, k)
        best_s, best_i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
        if best_s.shape[1] == k:
            full = best_i[:, -1] < np.iinfo(np.int64).max
            kth = np.where(full, np.maximum(kth, best_s[:, -1]), kth)
    row, col = np.nonzero((best_i < np.iinfo(np.int64).max) & (best_s >= floor[:, None])) if best_s.shape[1] else (np.empty(0, int), np.empty(0, int))
    return qid[row], best_i[row, col], best_s[row, col]


def _exact_order(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    return np.array([sorted(range(s.shape[1]), key=lambda j: (-int(a[j]), int(b[j])))[:k] for a, b in zip(s, i, strict=True)])
