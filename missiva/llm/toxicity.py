"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from missiva.llm.common import giving_back, held_out, learns, slices, staged, worker_cache

BITS = 20
TRAIN_DOCS = 15_000
# Features of fewer training documents are left out.
MIN_DOCS = 4
CACHE = 100_000
# Bytes of text whose features are held at once.
SLICE = 1 << 18
# Everything in ASCII that is no letter separates words.
SEPARATE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh32_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * MULTIPLIERS[0]) >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every word, pair of neighbours and pair with one word between, repeats included."""
    kept = worker_cache("words")
    hashes = kept.setdefault("hashes", _Hashes())
    words, sizes = [], []
    for t in texts:
        found = t.lower().encode().translate(SEPARATE).split() if t else []
        words += found
        sizes.append(len(found))
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    parts, rows = [_mixed(h, bits)], [row]
    for gap, salt in ((1, MULTIPLIERS[1]), (2, MULTIPLIERS[2])):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            both = (h[:-gap] * salt + h[gap:] * (salt ^ MULTIPLIERS[0]))[same]
            parts.append(_mixed(both, bits))
            rows.append(row[gap:][same])
    return np.concatenate(rows), np.concatenate(parts)


def ftrl(
    examples: list[tuple[np.ndarray, int]], size: int, epochs: int = 6, alpha: float = 4.0, beta: float = 1.0, l1: float = 10.0,
    l2: float = 0.01, positive: float = 3.0,
) -> tuple[np.ndarray, float]:
    """(weights, bias) after some passes over (distinct feature indices, label) in the given order.

    Every coordinate has its own rate from its own gradients; weights whose gradient sum stays within `l1` are
    exactly 0. The bias is a coordinate without L1. Gradients of positive examples count `positive` times.
    """
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    for _ in range(epochs):
        for index, y in examples:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha + l2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y) * (positive if y else 1.0)
            more = g * g
            z[index] = zi + g - (np.sqrt(ni + more) - root) / alpha * w
            n[index] = ni + more
            zb += g - ((nb + more) ** 0.5 - nb**0.5) / alpha * b
            nb += more
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + nb**0.5) / alpha + l2)


def common_features(lists: list[pa.ListArray], bits: int = BITS, least: int = MIN_DOCS) -> list[np.ndarray]:
    """The features of each example that at least `least` examples have."""
    seen = np.zeros(1 << bits, np.int64)
    for part in lists:
        # Some at a time: counting makes a wider copy.
        flat = part.flatten().to_numpy()
        for lo in range(0, len(flat), 1 << 20):
            seen += np.bincount(flat[lo : lo + (1 << 20)], minlength=1 << bits)
    common = seen >= least
    examples = []
    for part in lists:
        flat, ends = part.flatten().to_numpy(), np.cumsum(np.append(0, part.value_lengths().to_numpy(zero_copy_only=False)))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            # Only the common features of an example are copied.
            index = flat[lo:hi]
            examples.append(index[common[index]])
    return examples


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_docs: int = TRAIN_DOCS, bits: int = BITS,
) -> dict[int, float]:
    """Non-zero weights by feature index, the bias at -1.

    Learns from at most `max_docs` labelled rows that are not held out, those with the smallest id hashes, in that
    order; features are made in parallel, and one task passes over these bounded examples. A document with both
    labels counts as toxic. Without labelled rows there are no weights at all.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().filter(learns("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # At most `max_docs` rows of two numbers.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, index = features(part.column("text").to_pylist(), bits)
                key = np.unique(row << bits | index)
                sizes = np.bincount(key >> bits, minlength=part.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], names=["doc_id", "y", "index"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # A repeated id is one example, by its smallest text: the rows of the fit are bounded, not only its ids.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    examples = staged(rows.mapInArrow(giving_back(indexed), f"doc_id {kind}, y int, index array<int>"))

    def fit(group: pa.Table) -> pa.Table:
        order = np.lexsort((np.arange(group.num_rows), group.column("doc_id").to_numpy(), group.column("h").to_numpy()))
        y = group.column("y").to_numpy()
        examples = common_features(group.column("index").chunks, bits)
        w, bias = ftrl([(examples[i], int(y[i])) for i in order], 1 << bits)
        at = np.flatnonzero(w)
        return pa.table({"index": np.append(at, -1), "weight": np.append(w[at], bias)})

    # One task on purpose: the rows are bounded by `max_docs`.
    fitted = examples.withColumn("h", F.xxhash64("doc_id")).groupBy(F.lit(0).alias("all")).applyInArrow(fit, "index long, weight double")
    return {r["index"]: r["weight"] for r in fitted.collect()}


def score_texts(
    docs: DataFrame, weights: dict[int, float], doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, bits: int = BITS,
) -> DataFrame:
    """The columns `keep` of each row (default: the id) and `score`, the probability of toxicity in 0 to 1.

    A null or empty text has the score of the bias alone; without weights every score is 0. A feature counts once per
    text. Whole texts are scored, row by row, without a shuffle; the weights are sparse and bounded by the hash space.
    """
    names = [doc_id] if keep is None else keep
    # A text that is kept anyway goes to the workers once.
    read = text if text in names and docs.schema[text].dataType == StringType() else "_tox_text"
    more = [] if read == text else [F.col(f"`{text}`").cast("string").alias(read)]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *more)
    schema = StructType([source.schema[c] for c in names]).add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        table = np.zeros(1 << bits)
        for i, w in given.items():
            if i >= 0:
                table[i] = w
        telling = table != 0
        for batch in batches:
            for part in slices(batch, read, SLICE):
                row, index = features(part.column(read).to_pylist(), bits)
                hit = telling[index]
                key = np.unique(row[hit] << bits | index[hit])
                total = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], part.num_rows) + given.get(-1, 0.0)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if given else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(p)], names=[*names, "score"])

    return source.mapInArrow(giving_back(score), schema)


def judge_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_docs: int = TRAIN_DOCS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from the threshold on."""
    scored = score_texts(docs, train(docs, labels, doc_id, text, label, max_docs), doc_id, text)
    return scored.select(
        F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
