"""Corpus statistics, entity tables and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.functions import text as T
from missiva.operators.scale import top_rows
from missiva.session import pin


def _rows(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def corpus_statistics(
    letters: DataFrame, doc_id: str = "id", date: str = "date", text: str = "text",
    tops: Sequence[tuple[str, int]] = (("sender", 5), ("recipient", 5), ("place", 10)),
) -> DataFrame:
    """Long table of sections: top values, counts per year and month, lengths.

    One aggregate over (section, item) cells serves all counted sections.
    """
    base = letters.select(
        doc_id, *[c for c, _ in tops], D.year_key(F.col(date)).alias("year"), D.month_key(F.col(date)).alias("month"),
        F.col(date).alias("_d"), T.word_count(F.col(text)).alias("_w"),
    )
    dims = [c for c, _ in tops] + ["year", "month"]
    cells = base.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("section"), F.col(d).alias("item")) for d in dims])).alias("_c"), "_w"
    ).groupBy("_c.section", "_c.item").agg(F.count(F.lit(1)).alias("n"), F.avg("_w").alias("w"))
    cells = pin(cells)
    out = _rows(cells.filter("section = 'year'"), "year", F.col("item"), F.col("n"))
    out = out.unionByName(_rows(cells.filter("section = 'month'"), "month", F.col("item"), F.col("n")))
    for dim, k in tops:
        best = top_rows(cells.filter(F.col("section") == dim), [], [F.col("n").desc(), "item"], k)
        out = out.unionByName(_rows(best, dim, F.col("item"), F.col("n")))
    years = cells.filter(F.col("section") == "year")
    out = out.unionByName(_rows(years, "words_per_year", F.col("item"), F.col("w")))
    ends = base.agg(
        F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.avg("_w").alias("w"),
        F.min(F.struct((-F.col("_w")).alias("w"), F.col(doc_id).alias("i"))).alias("longest"),
        F.min(F.struct(F.col("_w").alias("w"), F.col(doc_id).alias("i"))).alias("shortest"),
    )
    none = F.lit(None).cast("double")
    tail = F.array(
        *[
            F.struct(F.lit(s).alias("section"), i.cast("string").alias("item"), v.cast("double").alias("value"))
            for s, i, v in (
                ("overall", F.concat(F.lit("first_date "), F.col("lo").cast("string")), none),
                ("overall", F.concat(F.lit("last_date "), F.col("hi").cast("string")), none),
                ("overall", F.lit("mean_words"), F.col("w")),
                ("longest", F.col("longest.i"), -F.col("longest.w")),
                ("shortest", F.col("shortest.i"), F.col("shortest.w")),
            )
        ]
    )
    return out.unionByName(ends.select(F.explode(tail).alias("r")).select("r.*"))


def monthly_density(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(D.month_key(F.col(date)).alias("month")).agg(F.count(F.lit(1)).alias("count"))


def frequency_table(df: DataFrame, item: str, by: Sequence[str] = ()) -> DataFrame:
    low = F.lower(F.trim(item))
    rows = df.select(*by, low.alias(item)).filter(F.col(item) != "")
    return rows.groupBy(*by, item).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), item)


def rollup_by_lemma(freq: DataFrame, lemma: DataFrame) -> DataFrame:
    """Frequencies (word, freq) summed by the lemma table (word, lemma)."""
    return freq.join(lemma, "word").groupBy("lemma").agg(F.sum("freq").alias("freq")).orderBy(F.col("freq").desc(), "lemma")


def place_counts(letters: DataFrame, place: str = "place", location: str = "location", doc_id: str = "id") -> DataFrame:
    return letters.groupBy(place).agg(
        F.count(F.lit(1)).alias("count"), F.min_by(location, doc_id).alias(location)
    ).orderBy(F.col("count").desc(), place)


def overview_cards(doc_scores: DataFrame) -> DataFrame:
    return doc_scores.agg(
        F.count(F.lit(1)).alias("documents"), F.avg("mean").alias("mean_score"),
        F.sum("sentence_count_substantive").alias("sentences"), F.avg("negative_ratio").alias("negative_ratio"),
    )


def sentence_stats(sentences: DataFrame, doc_id: str) -> DataFrame:
    return sentences.agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if("is_formulaic").alias("formulaic"),
        F.countDistinct(doc_id).alias("documents"),
    ).withColumn("per_document", F.col("sentences") / F.nullif(F.col("documents"), F.lit(0)))


def corpus_end(df: DataFrame, date: str) -> DataFrame:
    """Latest valid date; unparsable ones are skipped."""
    d = F.col(date) if dict(df.dtypes)[date] == "date" else D.parse_date(F.col(date))
    return df.agg(F.max(d).alias("corpus_end"))


def usage_stats(pairs: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Relevance classes, score brackets, ten most used and unused items."""
    bracket = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    # One pass over the pairs; the parts of the report are sums of these cells.
    cells = pin(pairs.groupBy(item, "relevance", bracket.alias("b")).agg(F.count(F.lit(1)).alias("_k")))
    n = F.sum("_k").alias("n")
    used = cells.groupBy(item).agg(n)
    row = lambda s, i, v: (F.lit(s).alias("section"), i.cast("string").alias("item"), v.cast("long").alias("n"))
    return (
        cells.groupBy("relevance").agg(n).select(*row("relevance", F.col("relevance"), F.col("n")))
        .unionByName(cells.groupBy("b").agg(n).select(*row("bracket", F.col("b"), F.col("n"))))
        .unionByName(top_rows(used, [], [F.col("n").desc(), item], 10).select(*row("top", F.col(item), F.col("n"))))
        .unionByName(items.join(used, item, "left_anti").select(*row("unused", F.col(item), F.lit(0))))
    )


def findings_summary(findings: DataFrame, doc_id: str) -> DataFrame:
    """Findings and documents touched, by category, by confidence and in all."""
    # Findings of one document and class become one counted row before anything is distinct.
    per_doc = findings.groupBy("category", "confidence", F.col(doc_id).alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
    sets = per_doc.groupingSets([["category"], ["confidence"], []], "category", "confidence").agg(
        F.sum("_k").alias("findings"), F.countDistinct("_d").alias("documents"), F.grouping_id().alias("_g")
    )
    name = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "confidence").otherwise("total")
    return sets.select(name.alias("section"), F.coalesce("category", "confidence").alias("item"), "findings", "documents")


def completeness_report(df: DataFrame, fields: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Filled and missing counts per field in one pass; an empty array is missing."""
    cells = [(f, F.count_if(F.trim(F.col(f).cast("string")) != ""), F.count_if(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "")) for f in fields]
    cells += [(a, F.count_if(F.size(a) > 0), F.count_if(F.coalesce(F.size(a), F.lit(0)) <= 0)) for a in arrays]
    packed = F.array(*[F.struct(F.lit(f).alias("field"), a.alias("filled"), b.alias("missing")) for f, a, b in cells])
    return df.agg(packed.alias("a")).select(F.explode("a").alias("r")).select("r.*")


def collect_entities(
    mentions: DataFrame, doc_id: str,
    kinds: Sequence[tuple[str, str]] = (("PER", "persons"), ("LOC", "locations"), ("ORG", "organizations")),
) -> DataFrame:
    """Sorted distinct names per type and the distinct (type, text) list of each document.

    Duplicates go before the lists are built; a list holds the distinct names of one document.
    """
    rows = mentions.select(doc_id, "type", "text").distinct()
    return rows.groupBy(doc_id).agg(
        *[F.sort_array(F.collect_set(F.when(F.col("type") == t, F.col("text")))).alias(n) for t, n in kinds],
        F.sort_array(F.collect_set(F.struct("type", "text"))).alias("entities"),
    )


def mention_nodes(mentions: DataFrame, entity: str, doc: str, date: str) -> DataFrame:
    """Distinct documents, first and last date and number of active years of each entity."""
    docs = mentions.groupBy(entity, doc).agg(F.min(date).alias(date))
    return docs.groupBy(entity).agg(
        F.count(F.lit(1)).alias("letter_count"), F.min(date).alias("first_mention"), F.max(date).alias("last_mention"),
        F.countDistinct(F.year(date)).alias("active_years"),
    )


def widen_stats(stats: DataFrame, extra: DataFrame, entity: str, add: Sequence[str]) -> DataFrame:
    """Take in extra counts and dates: added for the roles in `add`, otherwise the larger count wins."""
    e = extra.select(entity, F.col("count").alias("_c"), F.col("first_date").alias("_f"), F.col("last_date").alias("_l"))
    j = stats.join(e, entity, "full")
    have, more = F.coalesce("letter_count", F.lit(0)), F.coalesce("_c", F.lit(0))
    count = F.when(F.col(entity).isin(*add), have + more).otherwise(F.greatest(have, more)) if add else F.greatest(have, more)
    return j.select(
        entity, count.alias("letter_count"), F.least("first_mention", "_f").alias("first_mention"),
        F.greatest("last_mention", "_l").alias("last_mention"),
    )


def silence_analysis(nodes: DataFrame, end: DataFrame, threshold: int = 183, min_count: int = 5) -> DataFrame:
    """Days since the last mention, the disappeared flag and the regularity of each entity."""
    span = F.year("last_mention") - F.year("first_mention") + 1
    days = F.datediff("corpus_end", "last_mention")
    gone = (days > threshold) & (F.col("letter_count") >= min_count)
    rows = nodes.filter(F.col("last_mention").isNotNull()).crossJoin(F.broadcast(end))
    return rows.select(
        *nodes.columns, days.alias("silence_days"), gone.alias("disappeared"),
        F.round(F.least(F.lit(1.0), F.col("active_years") / span), 3).alias("regularity"),
        F.when(gone, F.year("last_mention")).alias("disappearance_year"),
    )


def silence_report(marked: DataFrame, entity: str = "id", cluster: int = 2, longest: int = 5) -> DataFrame:
    """Disappearances by year and category, crowded years and the longest silences."""
    gone = marked.filter("disappeared")
    year = gone.groupBy("disappearance_year").agg(F.count(F.lit(1)).alias("n"))
    cat = gone.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, s, i, v: df.select(F.lit(s).alias("section"), F.col(i).cast("string").alias("item"), F.col(v).cast("long").alias("n"))
    top = top_rows(gone, [], [F.col("silence_days").desc(), entity], longest)
    return (
        row(year, "year", "disappearance_year", "n")
        .unionByName(row(cat, "category", "category", "n"))
        .unionByName(row(year.filter(F.col("n") >= cluster), "cluster", "disappearance_year", "n"))
        .unionByName(row(top, "longest", entity, "silence_days"))
    )


def _between(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def range_summary(
    scores: DataFrame, start: str, end: str, measures: Sequence[str], doc_id: str = "id", date: str = "date"
) -> DataFrame:
    """Monthly trend, average, extreme documents and the dominant measure of a date range."""
    from missiva.operators.scores import dominant_measure

    rows = _between(scores, date, start, end)
    none = F.lit(None).cast("double")
    trend = rows.groupBy(D.month_key(F.col(date)).alias("m")).agg(F.avg("mean").alias("v"))
    one = rows.agg(
        F.avg("mean").alias("_avg"), F.min(F.struct("mean", doc_id)).alias("lo"),
        F.min(F.struct((-F.col("mean")).alias("m"), doc_id)).alias("hi"), *[F.avg(m).alias(m) for m in measures],
    ).withColumn("_dom", dominant_measure(measures))
    tail = F.array(
        *[
            F.struct(F.lit(s).alias("section"), i.cast("string").alias("item"), v.alias("value"))
            for s, i, v in (
                ("average", F.lit("mean"), F.col("_avg")), ("lowest", F.col(f"lo.{doc_id}"), none),
                ("highest", F.col(f"hi.{doc_id}"), none), ("dominant", F.col("_dom"), none),
            )
        ]
    )
    return _rows(trend, "trend", F.col("m"), F.col("v")).unionByName(one.select(F.explode(tail).alias("r")).select("r.*"))


def arc_range_summary(arcs: DataFrame, start: str, end: str, doc_id: str = "id", date: str = "date") -> DataFrame:
    """Share of each arc type, mean range and asymmetry, and the commonest type of each half of the range."""
    from missiva.operators.scale import number_rows

    rows = number_rows(_between(arcs, date, start, end).select(doc_id, date, "arc_type", "sentiment_range", "arc_asymmetry"), [], [date, doc_id])
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("sentiment_range").alias("_r"), F.avg("arc_asymmetry").alias("_a"))
    half = F.when(F.col("rn") <= F.floor(F.col("_n") / 2), "first_half").otherwise("second_half")
    typed = rows.crossJoin(F.broadcast(total)).groupBy(half.alias("half"), "arc_type").agg(
        F.count(F.lit(1)).alias("n"), F.first("_n").alias("_n")
    )
    share = typed.groupBy("arc_type").agg((F.sum("n") * 100.0 / F.first("_n")).alias("v"))
    top = typed.groupBy("half").agg(F.min(F.struct((-F.col("n")).alias("k"), "arc_type")).alias("m"))
    means = total.select(
        F.explode(
            F.array(
                F.struct(F.lit("mean").alias("section"), F.lit("sentiment_range").alias("item"), F.col("_r").alias("value")),
                F.struct(F.lit("mean").alias("section"), F.lit("arc_asymmetry").alias("item"), F.col("_a").alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    halves = top.select(F.col("half").alias("section"), F.col("m.arc_type").alias("item"), F.lit(None).cast("double").alias("value"))
    return _rows(share, "share", F.col("arc_type"), F.col("v")).unionByName(means).unionByName(halves)
