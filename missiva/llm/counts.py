"""Token counts without token ids: pieces per distinct pre-token, joined to per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import slices, staged, worker_cache

FREQUENT = 200_000
SAMPLE_ROWS = 20_000


def load_tokenizer(path: str, kept: dict | None = None):
    """The tokenizer of a `.json` file without truncation or padding, loaded once per worker."""
    from tokenizers import Tokenizer

    kept = worker_cache("tokenizers") if kept is None else kept
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
        kept[path].no_truncation()
        kept[path].no_padding()
    return kept[path]


def count_pieces(path: str, words: list[str]) -> list[int]:
    """Tokens of each word, without special tokens of begin or end."""
    tokenizer = load_tokenizer(path)
    return [len(e.ids) for i in range(0, len(words), 4096) for e in tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]


def _with_pieces(words: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may hold very long words; count it in ranges of bounded text.
            for part in slices(batch, "word", 1 << 20):
                n = count_pieces(path, part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.array(n, pa.int64())], names=["word", "pieces"])

    return words.select("word").mapInArrow(count, "word string, pieces long")


def frequent_pieces(texts: DataFrame, path: str, top: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """pieces of at most `top` pre-tokens that are frequent in a bounded sample of rows.

    Only a plan: these words are summed where the text lies, all others go through the join, and the counts are the
    same whichever words are chosen. It keeps hot words out of the shuffle.
    """
    n = texts.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    words = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40))).select(
        F.explode(F.split("text", "[ \t\n\x0b\f\r]+")).alias("word")
    ).filter((F.col("word") != "") & (F.length("word") <= 64))
    best = words.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(top)
    return {r[0]: r[1] for r in _with_pieces(best, path).toLocalIterator()}


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text",
    top: int = FREQUENT, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, for tokenizers that drop white space between words.

    A pre-token is a run between ASCII blanks: the library's own splits never reach across one, so a text's count is
    the sum over its pre-tokens, special strings included. Frequencies are taken per row in one scan; frequent
    pre-tokens are summed there with a table of at most `top` words, the others are joined to the counts of the
    distinct pre-tokens. A null or empty text has 0 bytes and tokens; repeated rows are counted each on its own.
    """
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType
    # Chosen before the UDF sees it: the numbering holds only within one staged scan.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    known = rows.sparkSession.sparkContext.broadcast(frequent_pieces(rows, vocabulary, top, sample_rows))
    blanks = re.compile("[ \t\n\x0b\f\r]+")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        get = pieces.get
        for batch in batches:
            for part in slices(batch, "text"):
                size, base, offsets, word, times = [], [], [0], [], []
                for t in part.column("text").to_pylist():
                    size.append(len(t.encode()))
                    total = 0
                    for w, n in Counter(blanks.split(t)).items():
                        p = get(w)
                        if p is not None:
                            total += p * n
                        elif w:
                            word.append(w)
                            times.append(n)
                    base.append(total)
                    offsets.append(len(word))
                pairs = pa.StructArray.from_arrays([pa.array(word, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(base, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                    names=["doc_id", "n_bytes", "base", "rest"],
                )

    schema = f"doc_id {kind.simpleString()}, n_bytes long, base long, rest array<struct<word:string,n:long>>"
    counted = staged(rows.mapInArrow(frequencies, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = counted.select("row", F.explode("rest").alias("_r")).select("row", "_r.word", "_r.n")
    pieces = _with_pieces(rest.select("word").distinct(), vocabulary)
    sums = rest.join(pieces, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("base") + F.coalesce("more", F.lit(0))
    return counted.join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
