"""Byte-level BPE encoding and raw-byte decoding with a local rank file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import slices, worker_cache

SEGMENT = 1 << 16
# Before a blank that follows a word sign a new match always starts.
CUT = re.compile(r"(?<=\w)(?=[ \n])")


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a file with one base64 token and its rank per line."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encoding(path: str, pattern: str):
    """The encoder of a rank file without special tokens, loaded once per worker."""
    import tiktoken

    kept = worker_cache("tiktoken")
    if (path, pattern) not in kept:
        kept[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return kept[path, pattern]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of at most about `size` signs that start at match boundaries; a run without one stays whole."""
    start, n = 0, len(text)
    while n - start > size:
        cut = None
        # The last boundary within the size, else the next one after it.
        for lo in (start + size - 1024, start + 1):
            found = [m.start() for m in CUT.finditer(text, max(lo, start + 1), start + size)]
            if found:
                cut = found[-1]
                break
        if cut is None:
            after = CUT.search(text, start + size)
            if after is None:
                break
            cut = after.start()
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(enc, text: str, pattern: str, size: int = SEGMENT) -> list[int]:
    """Ids of a whole text. Long texts go in segments; a segment still too long is split by the pattern first."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text, size):
        if len(part) <= 2 * size:
            ids += enc.encode_ordinary(part)
        else:
            # One giant run: its matches are found here, and each is merged by the library on its own.
            import regex

            for match in regex.finditer(pattern, part):
                ids += enc._encode_single_piece(match.group().encode())
    return ids


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has no ids. No shuffle, repeated rows repeat."""
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, flat = [0], []
                for t in part.column("text").to_pylist():
                    ids = encode_text(enc, t, pattern) if t else []
                    flat.append(np.array(ids, dtype=np.int32))
                    offsets.append(offsets[-1] + len(ids))
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(encode, f"doc_id {kind.simpleString()}, ids array<int>")


def decode_ids(ids: str, vocabulary: str, pattern: str):
    """Column of the raw bytes that the ids stand for; null or empty ids give empty bytes, so broken UTF-8 survives."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            yield pa.array([enc.decode_bytes(x) if x else b"" for x in (v.as_py() for v in batch)], pa.binary())

    return decode(ids)
