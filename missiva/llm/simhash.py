"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of one of their halves. So every
fingerprint is filed under both halves, and looked up under all values one bit around them; what is found is checked
on the complete fingerprint. Where very many fingerprints share a half, the same argument is applied again to the
other half's quarters, and then to bytes, where at most 256 filed fingerprints share all the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import giving_back, slices, staged
from missiva.operators.graph import components

RADIUS = 3
BUCKET = 4096
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> bytes:
    """8 bytes, most significant first: a bit is set if it is in more than half of the shingles' hashes."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - SHINGLE + 1, 1)
    spans = zip(starts[:last].tolist(), ends[-last:].tolist(), strict=True)
    raw = np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 15):
        total += np.unpackbits(raw[i : i + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(raw)).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint as a signed long."""
    names = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_fp_text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_fp_text"):
                raw = b"".join([fingerprint(t) for t in part.column("_fp_text").to_pylist()])
                fp = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], fp], names=[*names, "fp"])

    return source.mapInArrow(giving_back(mark), source.drop("_fp_text").schema.add("fp", "long"))


def _entries(members: DataFrame, fields: list[tuple[int, int]]) -> DataFrame:
    """(key, fp, filed): every member under the exact value of each field (shift, width), and one bit beside it.

    The key holds the old key, the field's place and its value. Only exact entries of filed members are filed.
    """

    def under(shift: int, width: int):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = F.array(*[F.lit(bit).cast("long") for bit in [0, *[1 << i for i in range(width)]]])
        return F.transform(flips, lambda bit: F.struct(
            F.struct(F.col("key").alias("above"), F.lit(shift).alias("place"), value.bitwiseXOR(bit).alias("value")).alias("key"),
            (F.col("filed") & (bit == 0)).alias("filed"),
        ))

    return members.select("fp", F.explode(F.concat(*[under(*f) for f in fields])).alias("_e")).select("_e.key", "fp", "_e.filed")


def _links(buckets: DataFrame) -> DataFrame:
    """(a, b): for each bucket a forest that connects its fingerprints exactly as its verified links do."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column("members"):
                members = bucket.values
                fp = members.field("fp").to_numpy(zero_copy_only=False)
                part = np.arange(len(fp))
                for i in np.flatnonzero(members.field("filed").to_numpy(zero_copy_only=False)):
                    near = np.flatnonzero(np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= RADIUS)
                    roots = np.unique(part[near])
                    if len(roots) > 1:
                        a += [int(fp[roots[0]])] * (len(roots) - 1)
                        b += fp[roots[1:]].tolist()
                        part[np.isin(part, roots[1:])] = roots[0]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.select("members").mapInArrow(giving_back(link), "a long, b long")


def near_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges between the distinct fingerprints `fp` whose components are those of all pairs within RADIUS bits.

    Per bucket the edges are fewer than its members, so a large group of near copies gives no quadratic output.
    """
    members = distinct.select(F.lit(0).alias("key"), "fp", F.lit(True).alias("filed"))
    # Fields of each level: halves, then the quarters of the other half, then the bytes of the other quarter.
    level, out = 0, None
    while True:
        parts = [(F.lit(True), [(0, 32), (32, 32)])] if level == 0 else _next_fields(level)
        entries = reduce(DataFrame.unionByName, [_entries(members.filter(known), fields) for known, fields in parts])
        # An entry beside a value matters only where something is filed under it.
        held = entries.filter("filed").select("key").distinct()
        found = entries.filter("filed").unionByName(entries.filter("NOT filed").join(held, "key", "left_semi"))
        found = staged(found)
        sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # After the bytes, 256 filed fingerprints at most and those one bit around are left: bounded by construction.
        last = level == 2
        small = sizes if last else sizes.filter(F.col("n") <= bucket)
        gathered = found.join(small.select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("fp", "filed")).alias("members"))
        links = _links(gathered)
        out = links if out is None else out.unionByName(links)
        large = sizes.filter(F.col("n") > bucket)
        if last or large.limit(1).count() == 0:
            return out.distinct()
        members = found.join(large.select("key"), "key")
        level += 1


def _next_fields(level: int) -> list[tuple]:
    """Which members split which fields: those of the halves and quarters that their keys have not fixed yet."""
    if level == 1:
        return [(F.col("key.place") == s, [(32 - s, 16), (48 - s, 16)]) for s in (0, 32)]
    # At the bytes: the key fixes a half and one quarter of the other; the last quarter is split.
    return [(F.col("key.place") == s, [(s ^ 16, 8), ((s ^ 16) + 8, 8)]) for s in (0, 16, 32, 48)]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is named by the smallest id it can reach.

    Texts without words, null ones included, have fingerprint zero and are linked like any other. Fingerprints are
    linked once, however many rows share one; repeated rows repeat. A component of null ids only has a null name.
    """
    rows = staged(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"]))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = components(firsts.select(F.col("fp").alias("id")), near_links(firsts.select("fp"), bucket))
    named = firsts.join(named, firsts.fp == named.id).select("fp", "component", "first")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(names, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, and of several with that id the one with the smallest digest.

    Rows are told apart by id and text, so rows that share an id or have none are linked and kept like any other; rows
    equal in both are one, and a component without any id keeps the row with the smallest digest. Columns of any name
    are carried along.
    """
    of = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in (doc_id, text)]
    key = F.unhex(F.md5(F.concat(F.length(of[0]).cast("string"), F.lit(":"), *of).cast("binary")))
    ids = docs.select(key.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = near_duplicates(ids, "row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("id").isNull().alias("a"), "id", "row")
    kept = ids.select("row", order.alias("o")).join(found, "row").groupBy("component_id").agg(F.min("o").alias("o"))
    keyed = docs.select(key.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    return keyed.join(kept.select(F.col("o.row").alias("row")), "row", "left_semi").dropDuplicates(["row"]).select("r.*")
