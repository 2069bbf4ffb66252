"""Text audits, corrections with provenance, validation and incremental work."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.text import match_positions
from missiva.rules import danish


def context(text: Column, position: Column, reach: int = 40) -> Column:
    """Up to `reach` characters on each side of a 0-based offset, on one line."""
    start = F.greatest(F.lit(0), position - reach)
    return F.replace(F.substring(text, start + 1, position + reach - start), F.lit("\n"), F.lit(" "))


def scan_characters(
    df: DataFrame, doc_id: str, text: str, chars: Sequence[tuple[str, str]] = danish.AUDIT_CHARS, reach: int = 40
) -> DataFrame:
    """One finding per listed character; `remove_eol` ones only at the end of a line."""
    listed = "[" + "".join(re.escape(c) for c, _ in chars) + "]"
    acts = F.create_map(*[F.lit(x) for pair in chars for x in pair])
    hits = df.select(doc_id, text, F.explode(match_positions(F.col(text), listed)).alias("_h")).select(doc_id, text, "_h.*")
    found = hits.withColumn("action", F.element_at(acts, F.col("original")))
    after = F.substring(F.col(text), F.col("position") + 2, F.lit(1))
    found = found.filter((F.col("action") != "remove_eol") | after.isin("", "\n"))
    return found.select(
        doc_id, "position", "original", "action", context(F.col(text), F.col("position"), reach).alias("context")
    )


def fingerprint(df: DataFrame, key: str, columns: Sequence[str], version: str = "") -> DataFrame:
    """SHA-256 of the named columns and a code version, per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("\u0001", *cells, F.lit(version)), 256)).select(
        key, *[c for c in df.columns if c != key], "fingerprint"
    )


def changed_rows(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows that are new or whose fingerprint differs from the stored (key, fingerprint) table."""
    return current.join(previous.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def merge_results(old: DataFrame, fresh: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Results of unchanged rows that still exist, and the recomputed ones."""
    kept = old.join(fresh.select(key), key, "left_anti").join(current.select(key), key, "left_semi")
    return kept.unionByName(fresh)


def validate_schema(df: DataFrame, key: str, spec: Sequence[Mapping]) -> DataFrame:
    """(key, field, problem) for each violated constraint.

    A spec entry names a field and any of required, cast (type name), prefix, enum, nonempty.
    """
    checks = []
    for s in spec:
        c = F.col(s["field"])
        text = F.coalesce(c.cast("string"), F.lit("")) if not s.get("nonempty") else None
        bad = lambda cond, problem, f=s["field"]: F.when(
            cond, F.struct(F.lit(f).alias("field"), F.lit(problem).alias("problem"))
        )
        if s.get("nonempty"):
            checks.append(bad(F.coalesce(F.size(c), F.lit(0)) <= 0, "empty"))
            continue
        have = F.trim(text) != ""
        if s.get("required"):
            checks.append(bad(~have, "missing"))
        if "cast" in s:
            checks.append(bad(have & text.try_cast(s["cast"]).isNull(), "type"))
        if "prefix" in s:
            checks.append(bad(have & ~text.startswith(s["prefix"]), "prefix"))
        if "enum" in s:
            checks.append(bad(have & ~text.isin(*s["enum"]), "enum"))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("v")).select(key, "v.*")


def require(df: DataFrame, min_rows: int = 1, distinct: tuple[str, int] | None = None) -> DataFrame:
    """The table itself, or an error if it has too few rows or distinct keys."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct:
        aggs.append(F.countDistinct(distinct[0]).alias("d"))
    got = df.agg(*aggs).first()
    if got["n"] < min_rows:
        raise ValueError(f"expected at least {min_rows} rows, found {got['n']}")
    if distinct and got["d"] < distinct[1]:
        raise ValueError(f"expected at least {distinct[1]} distinct {distinct[0]}, found {got['d']}")
    return df


def error_scan(df: DataFrame, doc_id: str, text: str, bad: Sequence[str]) -> DataFrame:
    """Line number (from 1) and 0-based offset in the line of each listed literal."""
    lines = df.select(doc_id, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "line"))
    found = F.filter(F.array(*[F.lit(b) for b in bad]), lambda b: F.col("line").contains(b))
    hits = lines.withColumn("bad", F.explode(found))
    return hits.select(doc_id, (F.col("_i") + 1).alias("line_no"), "bad", (F.expr("instr(line, bad)") - 1).alias("offset"))
