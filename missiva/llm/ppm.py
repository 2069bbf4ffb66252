"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: how often every byte followed every context of up to three bytes. A byte costs
-log2 of its probability in the longest context the tree knows; a byte that is new there costs an escape and is
looked up one byte shorter, down to a uniform guess. The statistics are frozen after training, so a text's code
length is a sum of table entries, and the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from missiva.llm.common import giving_back, held_out, learns, slices, worker_cache

ORDER = 3
TRAIN_DOCS = 400
MAX_GRAMS = 200_000
MAX_LANGUAGES = 64
MIN_CONTEXT = 4
# Bytes of text whose code lengths are held at once.
SLICE = 1 << 18
# What stands before the first byte of a text.
START = b" " * ORDER


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(lang, text) of at most `per_language` documents of a language, those with the smallest id hashes.

    Rows that repeat an id and a language are learnt once, with their smallest text.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    usable = rows.filter(learns("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Hashes below this mark hold about twice the documents wanted, so the ranking never sees a whole language.
    mark = F.lit(0)
    for r in sizes:
        mark = F.when(F.col("lang") == r.lang, int(min(1.0, 2 * per_language / max(r.n, 1)) * (1 << 40))).otherwise(mark)
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    near = usable.select("doc_id", "lang").filter(place < mark).distinct()
    picked = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).drop("_r")
    # At most `per_language` ids of each of at most MAX_LANGUAGES languages.
    return usable.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def count_grams(sample: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(lang, gram, n): the most frequent byte sequences of length ORDER + 1 of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by_lang: dict[str, list[bytes]] = {}
                for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(t.encode())
                for lang, texts in by_lang.items():
                    grams = []
                    for t in texts:
                        b = np.frombuffer(START + t, dtype=np.uint8).astype(np.int64)
                        if len(t):
                            grams.append(((b[:-3] * 256 + b[1:-2]) * 256 + b[2:-1]) * 256 + b[3:])
                    if grams:
                        gram, n = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return grams.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max_grams).drop("_r")


class ContextTables:
    """Code lengths of every byte after every kept context, for all languages side by side."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT):
        self.languages = sorted(grams)
        used = np.zeros(256, bool)
        used[list(START[:1])] = True
        for gram, _ in grams.values():
            for shift in (24, 16, 8, 0):
                used[np.unique(gram >> shift & 255)] = True
        # Class 0 holds all bytes that training never saw.
        self.classes = np.where(used, np.cumsum(used), 0).astype(np.int32)
        a = self.width = int(used.sum()) + 1
        coded, kept3, kept2 = {}, [], []
        for lang, (gram, n) in grams.items():
            c = [self.classes[gram >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
            coded[lang] = (c, n)
            three, total = _sums(((c[0] * a + c[1]) * a + c[2]), n)
            kept3.append(three[total >= min_context])
            two, total = _sums(c[1] * a + c[2], n)
            kept2.append(two[total >= min_context])
        three = np.unique(np.concatenate(kept3)) if kept3 else np.empty(0, np.int64)
        two = np.unique(np.concatenate(kept2)) if kept2 else np.empty(0, np.int64)
        # States: the kept triples, the kept pairs, every single class. A triple that is not kept acts as its last pair or class.
        pair_state = len(three) + len(two) + np.arange(a * a) % a
        pair_state[two] = len(three) + np.arange(len(two))
        self.state = np.tile(pair_state, a).astype(np.int32)
        self.state[three] = np.arange(len(three))
        self.bits = np.empty(((len(three) + len(two) + a) * a, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            c, n = coded[lang]
            zero = _blend(np.bincount(c[3], n, a)[None, :], np.full((1, a), 1 / 256))
            one = _blend(np.bincount(c[2] * a + c[3], n, a * a).reshape(a, a), zero)
            p2 = _blend(_rows(two, c[1] * a + c[2], c[3], n, a), one[two % a])
            # A triple falls back on its last pair; a pair that is not kept falls back on its last class.
            at = np.searchsorted(two, three % (a * a)) if len(two) else np.zeros(len(three), np.int64)
            hit = two[np.minimum(at, len(two) - 1)] == three % (a * a) if len(two) else np.zeros(len(three), bool)
            below = one[three % a]
            below[hit] = p2[at[hit]]
            p3 = _blend(_rows(three, (c[0] * a + c[1]) * a + c[2], c[3], n, a), below)
            self.bits[:, k] = -np.log2(np.concatenate([p3, p2, one])).ravel()

    def parts(self) -> tuple:
        """Plain values that can be sent to executors without a copy of the package."""
        return self.languages, self.width, self.classes, self.state, self.bits

    @classmethod
    def of(cls, parts: tuple) -> ContextTables:
        tables = cls.__new__(cls)
        tables.languages, tables.width, tables.classes, tables.state, tables.bits = parts
        return tables

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        filled = [i for i, t in enumerate(texts) if t]
        if not filled:
            return out
        c = self.classes[np.frombuffer(b"".join(START + texts[i] for i in filled), dtype=np.uint8)]
        a, sizes = self.width, np.array([len(texts[i]) + ORDER for i in filled])
        index = self.state[(c[:-3] * a + c[1:-2]) * a + c[2:-1]] * np.int64(a) + c[3:]
        costs = np.take(self.bits, index, axis=0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # Entry p stands for the byte at p + ORDER: a text's own bytes start at its offset, its START bytes lie before.
        ends = starts + sizes - ORDER
        bounds = np.stack([starts, ends], 1).ravel()
        bounds = bounds[:-1] if bounds[-1] >= len(costs) else bounds
        out[filled] = np.add.reduceat(costs, bounds, axis=0, dtype=np.float64)[::2]
        return out


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, n, len(found))


def _rows(kept: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, a: int) -> np.ndarray:
    """Counts per kept context and symbol."""
    at = np.searchsorted(kept, context)
    ok = at < len(kept)
    ok[ok] = kept[at[ok]] == context[ok]
    return np.bincount(at[ok] * a + symbol[ok], n[ok], len(kept) * a).reshape(len(kept), a)


def _blend(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities by method C: distinct symbols count as escapes; an unknown context passes on to the lower one."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    scale = np.maximum(total + distinct, 1)
    return np.where(total == 0, lower, np.where(counts > 0, counts / scale, distinct / scale * lower))


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS,
    max_grams: int = MAX_GRAMS,
) -> ContextTables:
    """Frozen tables from a bounded sample; at most MAX_LANGUAGES languages with `max_grams` counts each reach the driver."""
    grams: dict[str, tuple[list, list]] = {}
    counted = count_grams(training_sample(docs, doc_id, text, lang, per_language), max_grams)
    for r in counted.toLocalIterator():
        gram, n = grams.setdefault(r.lang, ([], []))
        gram.append(r.gram)
        n.append(r.n)
    return ContextTables({k: (np.array(g, np.int64), np.array(n, np.float64)) for k, (g, n) in grams.items()})


def identify_languages(
    docs: DataFrame, tables: ContextTables, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of each row (default: the id), `lang_pred`, `score` and `bits_per_byte`.

    The score is the probability of the language among the learnt ones, each as likely beforehand. A text that is
    null or has no letter, and any text when nothing was learnt, is `und` with score 0. Equal code lengths go to the
    alphabetically first language. Whole texts are scored, row by row, without a shuffle.
    """
    names = [doc_id] if keep is None else keep
    # A text that is kept anyway goes to the workers once.
    read = text if text in names and docs.schema[text].dataType == StringType() else "_ppm_text"
    more = [] if read == text else [F.col(f"`{text}`").cast("string").alias(read)]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *more)
    schema = StructType([source.schema[c] for c in names]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    shared = docs.sparkSession.sparkContext.broadcast(tables.parts())

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lets go what a former stage left in this worker.
        worker_cache("ppm")
        model = ContextTables.of(shared.value)
        for batch in batches:
            for part in slices(batch, read, SLICE):
                texts = [t or "" for t in part.column(read).to_pylist()]
                raw = [t.encode() for t in texts]
                found, scores, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if model.languages:
                    bits = model.code_lengths(raw)
                    best = bits.argmin(1)
                    odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
                    for i, t in enumerate(texts):
                        if any(map(str.isalpha, t)):
                            found[i], scores[i], rate[i] = model.languages[best[i]], float(1 / odds[i]), float(bits[i, best[i]] / len(raw[i]))
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rate, pa.float64())],
                    names=[*names, "lang_pred", "score", "bits_per_byte"],
                )

    return source.mapInArrow(giving_back(identify), schema)


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt from the labelled rows that are not held out."""
    found = identify_languages(docs, train(docs, doc_id, text, lang, per_language), doc_id, text)
    return found.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), "lang_pred", "score")
