"""Large JSON files, one array or one object each, read by many tasks.

A file is read in byte ranges, as text that ends at closing braces. Where a range begins, it is unknown whether the
text is inside a string and how deep it is nested. So every range is summed up for both cases in parallel, the
few sums give the state at each start, and a second pass cuts the entries. Entries that cross a range are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*?"', re.S)


def _step(text: str, inside: bool) -> tuple[bool, int]:
    """(inside a string, change of depth) after the text and the brace that closed it."""
    if inside:
        end = STRING_END.match(text)
        if end is None:
            return True, 0
        text = text[end.end() :]
    bare = STRING.sub("", text)
    begun = bare.find('"')
    inside = begun >= 0
    bare = bare[:begun] if inside else bare
    return inside, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]") - (0 if inside else 1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, bool]]:
    """((file, block), text, first of its block) in order."""
    before = None
    for batch in batches:
        for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            yield (file, block), text, (file, block) != before
            before = (file, block)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, entries): the inner text of the file's array or object, cut behind inner objects, commas around it gone.

    `[entries]` or `{entries}` is valid JSON of one or more entries. Values other than objects stay with the object
    before or behind them. Byte ranges have the size of `spark.sql.files.maxPartitionBytes`.
    """
    rows = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for start, (inside, depth, closed) in enumerate(cases):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (*key, start == 1, inside, depth)] + [pa.array([list(closed)], pa.list_(pa.int64())), pa.array([list(closed.values())], pa.list_(pa.int64()))],
                    names=["file", "block", "began", "inside", "depth", "levels", "counts"],
                )

        key, cases = None, []
        for now, text, first in _ranges(batches):
            if first:
                if key is not None:
                    yield from made()
                key, cases = now, [[False, 0, Counter()], [True, 0, Counter()]]
            for case in cases:
                case[0], change = _step(text, case[0])
                case[1] += change
                if not case[0]:
                    case[2][case[1]] += 1
        if key is not None:
            yield from made()

    # Two rows per byte range reach the driver.
    seen = rows.mapInArrow(sums, "file string, block long, began boolean, inside boolean, depth long, levels array<long>, counts array<long>").collect()
    of = {(r["file"], r["block"], r["began"]): r for r in seen}
    starts, state, file = {}, None, None
    for name, block in sorted({(r["file"], r["block"]) for r in seen}):
        if name != file:
            file, state = name, (False, 0, 0)
        starts[name, block] = state
        r = of[name, block, state[0]]
        closed = dict(zip(r["levels"], r["counts"], strict=True))
        state = (r["inside"], state[1] + r["depth"], state[2] + sum(n for level, n in closed.items() if level <= 1 - state[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        parts: list[str] = []
        key, whole, inside, depth, number = None, False, False, 0, 0
        for now, text, first in _ranges(batches):
            if first:
                if parts:
                    held.append((*key, number, False, depth, "".join(parts)))
                key, parts, whole = now, [], False
                inside, depth, number = starts[now]
                whole = depth == 0 and not inside
            inside, change = _step(text, inside)
            depth += change
            parts.append(text + "}")
            if not inside and depth <= 1:
                held.append((*key, number, whole, depth, "".join(parts)))
                parts, whole, number = [], True, number + 1
            if len(held) >= 4096:
                yield made(held)
                held = []
        if parts:
            held.append((*key, number, False, depth, "".join(parts)))
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["file", "block", "number", "whole", "depth", "text"])

    pieces = rows.mapInArrow(cut, "file string, block long, number long, whole boolean, depth long, text string")
    joined = pieces.filter("NOT whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text", "depth"))).alias("_p"))
    joined = joined.select("file", "number", F.element_at("_p", -1)["depth"].alias("depth"), F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))
    every = pieces.filter("whole").select("file", "number", "depth", "text").unionByName(joined)
    # The container's own brackets: its opening one stands before the first entry. What closes an object is the brace
    # that ends the text; an array's bracket stands before a brace that only the reading of the last line put there.
    text = F.when(F.col("number") == 0, F.regexp_replace("text", r"^\s*[\[{]", "")).otherwise(F.col("text"))
    text = F.when(F.col("depth") < 0, F.regexp_replace(text, r"\]?\s*\}$", "")).when(F.col("depth") == 0, F.regexp_replace(text, r"\}$", "")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"^[\s,]+", ""), r"[\s,]+$", "")
    return every.select("file", "number", text.alias("entries")).filter("entries <> ''")
