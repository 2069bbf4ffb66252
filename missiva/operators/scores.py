"""Per-document, per-period and global summaries of scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.operators.scale import percentiles, running_sums, top_rows
from missiva.session import pin


def substantive(sentences: DataFrame, doc_id: str, flag: str = "is_formulaic") -> DataFrame:
    """Non-formulaic sentences, or all of them for documents that have nothing else.

    A document's sentences come from one input row, so this window group is bounded.
    """
    any_plain = F.max(~F.col(flag)).over(Window.partitionBy(doc_id))
    return sentences.withColumn("_any", any_plain).filter(~F.col("_any") | ~F.col(flag)).drop("_any")


def aggregate_scores(
    sentences: DataFrame, doc_id: str, score: str = "score", flag: str = "is_formulaic", negative: float = -0.05
) -> DataFrame:
    """Mean, spread and negative share of a document's substantive sentences."""
    w = Window.partitionBy(doc_id)
    marked = sentences.select(
        doc_id,
        F.col(score).alias("_s"),
        (~F.max(~F.col(flag)).over(w) | ~F.col(flag)).alias("_use"),
    )
    used = F.when(F.col("_use"), F.col("_s"))
    return marked.groupBy(doc_id).agg(
        F.avg(used).alias("mean"),
        F.min(used).alias("min"),
        F.percentile(used, F.lit(0.1)).alias("p10"),
        F.percentile(used, F.lit(0.9)).alias("p90"),
        (F.max(used) - F.min(used)).alias("range"),
        F.avg(F.when(F.col("_use"), (F.col("_s") < negative).cast("double"))).alias("negative_ratio"),
        F.count(F.lit(1)).alias("sentence_count"),
        F.count(used).alias("sentence_count_substantive"),
    )


def aggregate_multi(
    sentences: DataFrame, doc_id: str, scores: Sequence[str], flag: str | None = "is_formulaic"
) -> DataFrame:
    """Mean, p10 and p90 of each named score; without a flag every sentence counts."""
    rows = substantive(sentences, doc_id, flag) if flag else sentences
    aggs = []
    for s in scores:
        aggs += [
            F.avg(s).alias(f"{s}_mean"),
            F.percentile(s, F.lit(0.1)).alias(f"{s}_p10"),
            F.percentile(s, F.lit(0.9)).alias(f"{s}_p90"),
        ]
    return rows.groupBy(doc_id).agg(*aggs, F.count(F.lit(1)).alias("sentence_count"))


def monthly_band(doc_scores: DataFrame, date: str) -> DataFrame:
    return (
        doc_scores.filter(F.col(date).isNotNull())
        .groupBy(D.month_key(F.col(date)).alias("month"))
        .agg(
            F.avg("mean").alias("mean"), F.avg("p10").alias("p10"), F.avg("p90").alias("p90"),
            F.count(F.lit(1)).alias("count"),
        )
        .orderBy("month")
    )


def fixed_width_histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Non-empty bins keyed by the integer bin number."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.floor(F.col(col) / F.lit(width)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin", (F.col("bin") * F.lit(width)).alias("lo"), ((F.col("bin") + 1) * F.lit(width)).alias("hi"), "count"
        )
    )


def period_compare(df: DataFrame, date: str, metrics: Sequence[str], onset: str) -> DataFrame:
    """Mean and count on each side of a date with the change in percent, one row per metric."""
    aggs = []
    for m in metrics:
        for side in ("pre", "post"):
            v = F.when(F.col("_side") == side, F.col(m))
            aggs += [F.avg(v).alias(f"{m}_{side}"), F.count(v).alias(f"{m}_{side}_n"), F.sum(v).alias(f"{m}_{side}_t")]
    one = df.withColumn("_side", D.period_split(F.col(date), onset)).agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"{m}_pre").alias("pre_mean"), F.col(f"{m}_post").alias("post_mean"),
                    F.col(f"{m}_pre_n").alias("pre_n"), F.col(f"{m}_post_n").alias("post_n"),
                    F.col(f"{m}_pre_t").cast("double").alias("pre_total"),
                    F.col(f"{m}_post_t").cast("double").alias("post_total"),
                )
                for m in metrics
            ]
        )
    )
    change = F.when(F.col("pre_mean") == 0, 0.0).otherwise(
        (F.col("post_mean") - F.col("pre_mean")) / F.abs("pre_mean") * 100
    )
    return one.select(rows.alias("r")).select("r.*").withColumn("change_pct", change)


def metric_by_period(df: DataFrame, period: Column, metrics: Sequence[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n")]
    return df.groupBy(period.alias("period")).agg(*aggs)


def group_means(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), *[F.avg(m).alias(f"{m}_mean") for m in metrics]
    )


def summary_minmax(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, min, max, total and documents above zero, one row per metric, in one pass."""
    aggs = []
    for m in metrics:
        c = F.col(m).cast("double")
        aggs.append(
            F.struct(
                F.lit(m).alias("metric"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
                F.sum(c).alias("total"), F.count_if(c > 0).alias("above_zero"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def describe_methods(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column."""
    aggs = []
    for m in columns:
        c = F.col(m).cast("double")
        aggs.append(
            F.struct(
                F.lit(m).alias("metric"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
            )
        )
    basic = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    kw = {} if limit is None else {"limit": limit}
    quart = percentiles(df, [], columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kw)
    return basic.join(quart, "metric", "left")


def average_ranks(df: DataFrame, col: str, out: str, limit: int | None = None) -> DataFrame:
    """Rank with ties averaged, through counts per distinct value."""
    kw = {} if limit is None else {"limit": limit}
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, [], [col], {"_hi": F.col("_n")}, **kw)
    ranks = cum.select(F.col(col), (F.col("_hi") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, col)


def correlate(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Pearson, Spearman and R2 of two columns; NULL below three pairs."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(both, x, "_rx", limit), y, "_ry", limit)
    enough = F.count(F.lit(1)) >= 3
    r2 = F.pow(F.corr(x, y), 2)
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.corr(x, y)).alias("pearson"),
        F.when(enough, F.corr("_rx", "_ry")).alias("spearman"),
        F.when(enough, r2).alias("r2"),
        (enough & (r2 > 0.5)).alias("confounded"),
    )


def minmax_scale(df: DataFrame, columns: Sequence[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Global min-max scaling; a constant column becomes 0. The bounds are one row."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    bounds = df.agg(*aggs)

    def scaled(c):
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span * (hi - lo) + lo)

    out = df.crossJoin(F.broadcast(bounds)).select(
        *df.columns, *[scaled(c).alias(f"{c}_scaled") for c in columns]
    )
    total = sum((F.col(f"{c}_scaled") for c in columns), F.lit(0.0))
    return out.withColumn("scaled_mean", total / len(columns))


def axis_normalize(points: DataFrame, axes: Sequence[str], dp: int = 4, flat: float | None = None) -> DataFrame:
    """Per-axis scaling to [0, 1]; a flat axis divides by 1, or becomes the value `flat`."""
    aggs = []
    for c in axes:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    bounds = points.agg(*aggs)

    def scaled(c):
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        at = F.col(c) - F.col(f"_lo_{c}")
        empty = at if flat is None else F.lit(flat)
        return F.round(F.when(span == 0, empty).otherwise(at / span), dp)

    keep = [c for c in points.columns if c not in axes]
    return points.crossJoin(F.broadcast(bounds)).select(*keep, *[scaled(c).alias(c) for c in axes])


def top_divergence(df: DataFrame, a: str, b: str, k: int, tie: str) -> DataFrame:
    gap = df.withColumn("divergence", F.abs(F.col(a) - F.col(b)))
    return top_rows(gap, [], [F.col("divergence").desc(), F.col(tie)], k)


def extremes(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """The k highest and k lowest rows."""
    rows = df.filter(F.col(col).isNotNull())
    high = top_rows(rows, [], [F.col(col).desc(), F.col(tie)], k).withColumn("side", F.lit("high"))
    low = top_rows(rows, [], [F.col(col), F.col(tie)], k).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def union_of_extremes(df: DataFrame, columns: Sequence[str], k: int, key: str, highest: bool = False) -> DataFrame:
    """The rows among the k lowest (or highest) of any of the measures, each row once.

    Nulls are no extremes; equal values go to the smaller key.
    """
    picked = [
        top_rows(df.filter(F.col(c).isNotNull()), [], [F.col(c).desc() if highest else F.col(c), F.col(key)], k).select(key)
        for c in columns
    ]
    # At most k keys a measure.
    return df.join(F.broadcast(reduce(DataFrame.unionByName, picked).distinct()), key, "left_semi").dropDuplicates([key])


def dominant_measure(measures: Sequence[str], default: str = "unknown") -> Column:
    """Name of the largest measure; first wins ties, `default` if none is present."""
    best = F.greatest(*[F.col(m) for m in measures])
    out = F.lit(default)
    for m in reversed(measures):
        out = F.when(F.col(m) == best, F.lit(m)).otherwise(out)
    return out


def metric_ranking(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Mean absolute divergence per metric, largest first."""
    aggs = [F.struct(F.lit(n).alias("metric"), F.avg(F.abs(c)).alias("mean_abs")) for n, c in metrics.items()]
    one = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return one.orderBy(F.col("mean_abs").desc(), "metric")


def notable(doc_scores: DataFrame, sentences: DataFrame, doc_id: str, k: int = 10) -> DataFrame:
    """Documents at the ends of four measures with their most extreme plain sentence."""
    specs = (
        ("lowest_mean", F.col("mean"), "min"),
        ("highest_mean", F.col("mean").desc(), "max"),
        ("widest_range", F.col("range").desc(), "min"),
        ("most_negative", F.col("negative_ratio").desc(), "min"),
    )
    picked = None
    doc_scores = pin(doc_scores.select(doc_id, "mean", "range", "negative_ratio"))
    for name, order, side in specs:
        part = top_rows(doc_scores, [], [order, F.col(doc_id)], k)
        part = part.withColumn("list", F.lit(name)).withColumn("side", F.lit(side))
        picked = part if picked is None else picked.unionByName(part)
    plain = sentences.filter(~F.col("is_formulaic"))
    ends = plain.join(F.broadcast(picked.select(doc_id).distinct()), doc_id, "left_semi").groupBy(doc_id).agg(
        F.min(F.struct("score", "idx", "sentence")).alias("_lo"),
        F.min(F.struct((-F.col("score")).alias("s"), "idx", "sentence")).alias("_hi"),
    )
    text = F.when(F.col("side") == "max", F.col("_hi.sentence")).otherwise(F.col("_lo.sentence"))
    return picked.join(ends, doc_id, "left").select("list", "rank", doc_id, "mean", text.alias("excerpt"))
