"""How two audiences, or one word over the years, differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.operators.scale import GROUP_LIMIT, bounded_broadcast, running_sums, top_rows, with_neighbours
from missiva.operators.sentences import tokens
from missiva.session import pin


def word_divergence(
    docs: DataFrame, group: str, a: str, b: str, period: str, text: str, top: int = 200, eps: float = 1e-10
) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (natural log) of word use per period.

    Over the `top` most frequent words of both sides together, with additive smoothing,
    for periods that have both sides. Words are counted before anything else moves.
    """
    rows = docs.filter(F.col(group).isin(a, b))
    counts = tokens(rows, [period, group], text).groupBy(period, "token").agg(
        F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb")
    )
    best = top_rows(counts, [period], [(F.col("na") + F.col("nb")).desc(), "token"], top, "_r").drop("_r")
    # At most `top` rows per period are left, so the totals are small groups.
    size = best.groupBy(period).agg(
        F.sum("na").alias("_ta"), F.sum("nb").alias("_tb"), F.count(F.lit(1)).alias("_n")
    ).filter((F.col("_ta") > 0) & (F.col("_tb") > 0))
    j = best.join(size, period)
    p = (F.col("na") + eps) / (F.col("_ta") + F.col("_n") * eps)
    q = (F.col("nb") + eps) / (F.col("_tb") + F.col("_n") * eps)
    m = (p + q) / 2
    term = (p * F.log(p / m) + q * F.log(q / m)) / 2
    return j.groupBy(period).agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term))).alias("jsd"), F.count(F.lit(1)).alias("words")
    )


def wasserstein_1d(
    df: DataFrame, group: str, a: str, b: str, period: str, value: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Distance of the two empirical distributions per period; 0 if a side is missing.

    Equal values become one row with two counts before the cumulative sums.
    """
    rows = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    pts = rows.groupBy(period, F.col(value).alias("x")).agg(
        F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb")
    )
    pts = pin(pts)
    size = pts.groupBy(period).agg(F.sum("na").alias("_ta"), F.sum("nb").alias("_tb"))
    cum = running_sums(pts, [period], ["x"], {"_ca": F.col("na"), "_cb": F.col("nb")}, limit)
    nxt = with_neighbours(cum, [period], ["x"], 1, {"_nx": lambda w: F.lead("x").over(w)}, limit)
    gap = F.abs(F.col("_ca") / F.col("_ta") - F.col("_cb") / F.col("_tb")) * (F.col("_nx") - F.col("x"))
    both = (F.col("_ta") > 0) & (F.col("_tb") > 0)
    return nxt.join(size, period).groupBy(period).agg(
        F.coalesce(F.sum(F.when(both, gap)), F.lit(0.0)).alias("wasserstein")
    )


def effect_size(
    df: DataFrame, group: str, a: str, b: str, period: str, metrics: Sequence[str]
) -> DataFrame:
    """Absolute mean difference over the pooled deviation, one row per period and metric."""
    aggs = []
    for m in metrics:
        va, vb = F.when(F.col(group) == a, F.col(m)), F.when(F.col(group) == b, F.col(m))
        aggs.append(
            F.struct(
                F.lit(m).alias("metric"), F.avg(va).alias("ma"), F.avg(vb).alias("mb"),
                F.var_samp(va).alias("sa"), F.var_samp(vb).alias("sb"), F.count(va).alias("na"), F.count(vb).alias("nb"),
            )
        )
    g = df.groupBy(period).agg(F.array(*aggs).alias("a")).select(period, F.explode("a").alias("r")).select(period, "r.*")
    na, nb = F.col("na"), F.col("nb")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pooled = F.sqrt(((na - 1) * zero("sa") + (nb - 1) * zero("sb")) / F.nullif(na + nb - 2, F.lit(0)))
    d = F.abs(F.col("ma") - F.col("mb")) / F.when(pooled > 0, pooled)
    return g.select(period, "metric", F.coalesce(F.when((na > 0) & (nb > 0), d), F.lit(0.0)).alias("effect"))


def word_context_shift(
    sentences: DataFrame, targets: DataFrame, year: str, sentence: str = "sentence", score: str = "score"
) -> DataFrame:
    """Count, mean and population deviation of the sentence scores per target word and year, with drift."""
    from pyspark.sql import Window

    from missiva.functions import text as T

    words = F.array_distinct(T.words(F.lower(F.col(sentence))))
    hit = sentences.select(year, score, F.explode(words).alias("word")).join(
        bounded_broadcast(targets.select(F.lower("word").alias("word")).distinct()), "word"
    )
    per = hit.groupBy("word", year).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd")
    )
    w = Window.partitionBy("word").orderBy(year)
    return per.withColumn("drift", F.col("mean") - F.lag("mean").over(w))


def shift_summary(per_year: DataFrame, year: str) -> DataFrame:
    """Total absolute drift and the slope of the deviation over the ordinal of the year (0 below two years)."""
    from pyspark.sql import Window

    w = Window.partitionBy("word").orderBy(year)
    rows = per_year.withColumn("_i", F.row_number().over(w) - 1)
    g = rows.groupBy("word").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("years"),
        F.coalesce(F.sum(F.abs("drift")), F.lit(0.0)).alias("total_drift"), F.regr_slope("sd", "_i").alias("_s"),
    )
    slope = F.when(F.col("years") >= 2, F.coalesce("_s", F.lit(0.0))).otherwise(0.0)
    return g.select("word", "n", "years", "total_drift", slope.alias("fossilisation"))


def shift_ranking(summary: DataFrame, k: int = 3) -> DataFrame:
    """Words that stiffen most (lowest slope) and words that drift most."""
    a = top_rows(summary, [], ["fossilisation", "word"], k).select(F.lit("fossilising").alias("list"), "rank", "word")
    b = top_rows(summary, [], [F.col("total_drift").desc(), "word"], k).select(F.lit("drifting").alias("list"), "rank", "word")
    return a.unionByName(b)
