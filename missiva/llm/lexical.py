"""Exact ranked lexical search: item weights times document impacts, tile by tile through BLAS.

Every document is cut down to the terms that some item asks for. A tile of documents becomes a dense matrix of
integer impacts (terms x documents) in float64, the items a dense matrix of integer weights (items x terms), and
their product holds the scores. The terms of a tile are cut into vocabulary tiles whose sums stay below 2**53, so
every product is exact; the tiles are added as 64-bit integers. Each tile keeps an item's best documents, ties by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import slices, staged
from missiva.operators.scale import running_sums

# Fixed values of the score: signs that end a term, and A-Z in lower case.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
EXACT = 2**53
TOP_IMPACT = 10**6
#: Items, and all their terms together, of one pass over the documents; they go to every task. A longer item goes alone.
ITEMS, TERMS = 1024, 8192
#: Documents of a tile, and terms of a vocabulary tile.
TILE = 512
VOCABULARY = 4096


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and signs beyond ASCII, A-Z in lower case."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m), with m from the document's length `n`; all in 64-bit integers."""
    m = 25 + (75 * n * documents) // total
    return (10**9 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def vocabulary_tiles(weights: np.ndarray, width: int = VOCABULARY, exact: int = EXACT) -> list[tuple[int, int]]:
    """Consecutive term ranges in which no item's summed weights times the highest impact reach `exact`."""
    out, start, held = [], 0, np.zeros(len(weights), np.int64)
    room = exact // TOP_IMPACT
    for t in range(weights.shape[1]):
        held = held + weights[:, t]
        if t > start and (t - start == width or held.max(initial=0) >= room):
            out.append((start, t))
            start, held = t, weights[:, t].copy()
    return [*out, (start, weights.shape[1])] if weights.shape[1] else out


def tile_scores(weights: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, width: int = VOCABULARY, exact: int = EXACT) -> np.ndarray:
    """weights @ impacts, exactly, as longs: in float64 within vocabulary tiles, added as integers.

    The impacts come as (term, doc, impact), ascending by term; only one vocabulary tile is dense at a time.
    """
    out = np.zeros((weights.shape[0], docs), np.int64)
    for a, b in vocabulary_tiles(weights, width, exact):
        w, (lo, hi) = weights[:, a:b], np.searchsorted(term, [a, b])
        # One term alone may be beyond the exact range of doubles: then in longs.
        kind = np.float64 if w.sum(1).max(initial=0) * TOP_IMPACT < exact else np.int64
        dense = np.zeros((b - a, docs), kind)
        dense[term[lo:hi] - a, doc[lo:hi]] = impact[lo:hi]
        out += (w.astype(kind) @ dense).astype(np.int64)
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's `k` highest scores above zero; equal scores by ascending id, all at the bound seen."""
    rows, cols = [], []
    for i, s in enumerate(scores):
        at = np.flatnonzero(s > 0)
        if len(at) > k:
            bound = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= bound]
            at = at[np.lexsort((ids[at], -s[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    row, col = np.concatenate([*rows, np.empty(0, int)]).astype(int), np.concatenate([*cols, np.empty(0, int)]).astype(int)
    return row, ids[col], scores[row, col]


def _cut_down(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): number of all terms, and the asked terms with their counts, as packed 32-bit numbers."""
    known = docs.sparkSession.sparkContext.broadcast(index)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, terms, tf = [], [], []
                for text in part.column("text").to_pylist():
                    words = terms_of(text)
                    found = sorted((place[w], c) for w, c in Counter(words).items() if w in place)
                    n.append(len(words))
                    terms.append(np.array([t for t, _ in found], np.int32).tobytes())
                    tf.append(np.array([c for _, c in found], np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return docs.mapInArrow(cut, "doc_id long, n long, terms binary, tf binary")


def _frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of `size` asked terms; a task sends one number a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            total += np.bincount(held, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _search(rows: DataFrame, weights: np.ndarray, documents: int, total: int, k: int, tile: int, width: int) -> DataFrame:
    """(item, doc_id, score): every task's `k` best documents for each item of the pass."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        none = np.iinfo(np.int64).max
        best = (np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            for a in range(0, batch.num_rows, tile):
                part = batch.slice(a, tile)
                terms = [np.frombuffer(x, np.int32) for x in part.column("terms").to_pylist()]
                sizes = [len(x) for x in terms]
                flat = np.concatenate(terms)
                if not len(flat):
                    continue
                col = np.repeat(np.arange(part.num_rows), sizes)
                n = part.column("n").to_numpy(zero_copy_only=False)[col]
                tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), np.int32).astype(np.int64)
                # Only the terms that the tile's documents hold.
                used, row = np.unique(flat, return_inverse=True)
                order = np.argsort(row, kind="stable")
                scores = tile_scores(w[:, used], row[order], col[order], impacts(tf, n, documents, total)[order], part.num_rows, width)
                ids = part.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False)
                found = best_of(scores, ids, k)
                best = _merge(*[np.concatenate(x) for x in zip(best, found, strict=True)], k)
        ids = pa.array(best[1], mask=best[1] == none)
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), ids, pa.array(best[2])], names=["item", "doc_id", "score"])

    return rows.mapInArrow(score, "item long, doc_id long, score long")


def _merge(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff([*start, len(row)]))
    keep = rank < k
    return row[keep], ids[keep], score[keep]


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block: int = ITEMS, terms: int = TERMS, tile: int = TILE, width: int = VOCABULARY,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `k` highest-scoring documents with a score above 0.

    Equal scores go to the smaller id, null ids last. Null and empty texts have no term: such documents count
    nowhere and are never returned, such items return nothing. Every row is a document or an item of its own, so
    repeated ids are ranked side by side, and an id or item without a value keeps its null. Other columns, whatever
    their names, are not read. Items are taken
    in blocks of up to `block` items and about `terms` terms, each of which passes over the documents once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    length = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")
    asked = staged(asked.filter(F.length("text") > 0).select("item_id", "text", length.alias("size"), F.monotonically_increasing_id().alias("row")))
    asked = running_sums(asked, [], ["item_id", "row"], {"item": F.lit(1).cast("long"), "upto": F.col("size")})
    alone = F.when(F.col("size") > terms, F.col("item")).otherwise(F.lit(0))
    asked = staged(asked.withColumn("block", F.struct(alone.alias("a"), F.floor(F.col("upto") / terms).alias("t"), F.floor(F.col("item") / block).alias("i"))))
    parts = []
    for (part,) in asked.select("block").distinct().collect():
        # At most `block` rows and 2 * `terms` terms, or one row.
        some = asked.filter((F.col("block.a") == part["a"]) & (F.col("block.t") == part["t"]) & (F.col("block.i") == part["i"])).orderBy("item").collect()
        counts = [Counter(terms_of(r["text"])) for r in some]
        index = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        rows = staged(_cut_down(source, index))
        documents, total = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not index:
            continue
        df = _frequencies(rows, len(index))
        weights = np.zeros((len(some), len(index)), np.int64)
        for i, c in enumerate(counts):
            for t, times in c.items():
                weights[i, index[t]] = weight(documents, int(df[index[t]])) * times
        found = _search(rows.filter(F.length("terms") > 0), weights, documents, total, k, tile, width)
        numbers = [r["item"] for r in some]
        parts.append(found.withColumn("item", F.element_at(F.lit(numbers), (F.col("item") + 1).cast("int"))))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
