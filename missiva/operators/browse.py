"""Filters, facets, pages and single-row lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_view(df: DataFrame, hidden: Sequence[str] = ("text",)) -> DataFrame:
    """All columns but the body text; the scan never reads it."""
    return df.drop(*hidden)


def contains_ci(col: str, text: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit(""))).contains(text.lower())


def browse(
    df: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    like: Mapping[str, str] | None = None,
    offset: int = 0,
    limit: int = 20,
    order: str = "id",
    date: str = "date",
) -> DataFrame:
    """One page of matching rows with the total and a has_more flag on every row; a page has as many rows as asked for."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    rows = df
    if date_from:
        rows = rows.filter(F.col(date) >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.filter(F.col(date) <= F.lit(date_to).cast("date"))
    for col, text in (like or {}).items():
        rows = rows.filter(contains_ci(col, text))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def browse_tool(df: DataFrame, *args, offset: int = 0, limit: int = 20, **options) -> DataFrame:
    """`browse` as a tool offers it: limit is taken into 1 to 100, offset to 0 or more, whatever was asked for."""
    return browse(df, *args, offset=max(offset, 0), limit=min(max(limit, 1), 100), **options)


def facets(df: DataFrame, col: str, missing: str = "unknown") -> DataFrame:
    value = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(missing))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "value"
    )


def multi_field_search(
    df: DataFrame, text: str, fields: Sequence[str], equal: Mapping[str, str] | None = None,
    order: str = "id", offset: int = 0, limit: int = 25,
) -> DataFrame:
    rows = df
    for col, value in (equal or {}).items():
        rows = rows.filter(F.col(col) == value)
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(text.lower()) for f in fields])
    return rows.filter(hit).orderBy(order).offset(offset).limit(limit)


def score_list(
    letters: DataFrame, scores: DataFrame, sort: str, year: int | None = None, category: str | None = None,
    descending: bool = True, page: int = 1, size: int = 25, on: str = "id", date: str = "date",
) -> DataFrame:
    """A page of letters with scores; missing values sort as 0 and the page number is clamped."""
    from missiva.functions.dates import score_category

    rows = letters.join(scores, on, "left")
    if year is not None:
        rows = rows.filter((F.col(date) >= F.lit(f"{year:04d}-01-01").cast("date")) & (F.col(date) < F.lit(f"{year + 1:04d}-01-01").cast("date")))
    if category is not None:
        rows = rows.filter(score_category(F.coalesce(F.col("mean"), F.lit(0.0))) == category)
    total = rows.count()
    last = max(1, -(-total // size))
    page = min(max(page, 1), last)
    key = F.coalesce(F.col(sort), F.lit(0.0)) if sort != date else F.col(date)
    key = key.desc() if descending else key.asc()
    return rows.orderBy(key, on).offset((page - 1) * size).limit(size).withColumn("page", F.lit(page))


def get_document(
    letters: DataFrame, doc_id: int, analyses: Sequence[DataFrame] = (), on: str = "id"
) -> DataFrame:
    """One document; the analysis struct is there only if every score table has the row."""
    one = letters.filter(F.col(on) == doc_id)
    if not analyses:
        return one
    joined = analyses[0].filter(F.col(on) == doc_id)
    for a in analyses[1:]:
        joined = joined.join(a.filter(F.col(on) == doc_id), on)
    fields = [c for c in joined.columns if c != on]
    packed = joined.select(on, F.struct(*fields).alias("analysis"))
    return one.join(packed, on, "left")


def get_person(
    registry: DataFrame, who: str, mentions: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """Registry fields, then one row per document and per connection (no nested unbounded lists)."""
    one = registry.filter((F.col("id").cast("string") == who) | (F.lower("canonical") == who.lower()))
    out = one.select(
        "id", F.lit("person").alias("section"), F.col("canonical").alias("item"),
        F.col("letter_count").cast("double").alias("value"),
    )
    if mentions is not None:
        docs = mentions.join(F.broadcast(one.select("id")), "id").select("id", "doc_id").distinct()
        out = out.unionByName(
            docs.select("id", F.lit("document").alias("section"), F.col("doc_id").cast("string").alias("item"),
                        F.lit(None).cast("double").alias("value"))
        )
    if edges is not None:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(
            edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight")
        )
        near = both.join(F.broadcast(one.select("id")), "id")
        out = out.unionByName(
            near.select("id", F.lit("connection").alias("section"), F.col("other").cast("string").alias("item"),
                        F.col("weight").cast("double").alias("value"))
        )
    return out


def get_place(places: DataFrame, letters: DataFrame, name: str) -> DataFrame:
    """A place by id or name, one row per document written there."""
    one = places.filter((F.col("place_id").cast("string") == name) | (F.lower("place") == name.lower()))
    # One place, so the letters are thinned where they are read; the outer join then sees only its own.
    there = letters.join(F.broadcast(one.select("place").distinct()), "place", "left_semi")
    return one.join(there.select("place", F.col("id").alias("doc_id"), "date"), "place", "left")


def restrict(
    parents: DataFrame, children: DataFrame, keep: Column, parent_key: str, child_key: str
) -> tuple[DataFrame, DataFrame]:
    """Parents that pass, and the child rows of those parents."""
    kept = parents.filter(keep)
    ids = kept.select(F.col(parent_key).alias(child_key))
    return kept, children.join(ids, child_key, "left_semi")


def qualify(df: DataFrame, count: str, min_count: int, optional: str) -> DataFrame:
    present = F.col(optional).isNotNull() & (F.col(optional).cast("string") != "")
    return df.filter((F.col(count) >= min_count) | present)


def category_filter(df: DataFrame, category: str | None, col: str = "category") -> DataFrame:
    return df if category is None else df.filter(F.col(col) == category)


def sentences_of(sentences: DataFrame, doc_id: int, on: str = "id") -> DataFrame:
    return sentences.filter(F.col(on) == doc_id).orderBy("idx")


def text_filter_total(df: DataFrame, q: str, name: str, count: str) -> DataFrame:
    return df.filter(contains_ci(name, q)).agg(
        F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum(count), F.lit(0)).alias("total")
    )


def spotlight(notes: DataFrame, data: DataFrame, on: str) -> DataFrame:
    """A list of ids with notes; ids without data stay and say so."""
    out = notes.join(data.withColumn("_found", F.lit(True)), on, "left")
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")
