"""Ordered-sequence operators over documents, sentences and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.functions.geo import haversine_km
from missiva.operators.scale import (
    GROUP_LIMIT,
    number_rows,
    running_sums,
    top_rows,
    with_neighbours,
)
from missiva.session import pin


def chronological_id(df: DataFrame, date: str, tie: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Ids 1..n in date order with links to the previous and next row's key."""
    rows = with_neighbours(
        df, [], [date, tie], 1,
        {"prev": lambda w: F.lag(tie).over(w), "next": lambda w: F.lead(tie).over(w)}, limit,
    )
    return number_rows(rows, [], [date, tie], "chrono_id", limit)


def centered_rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence, value: str, window: int = 15, limit: int = GROUP_LIMIT
) -> DataFrame:
    half = window // 2
    return with_neighbours(
        df, keys, order, half, {"smoothed": lambda w: F.avg(value).over(w.rowsBetween(-half, half))}, limit
    )


def velocity(
    df: DataFrame, keys: Sequence[str], order: Sequence, value: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Absolute step to the next row of the series; the last row has none."""
    return with_neighbours(
        df, keys, order, 1, {"step": lambda w: F.abs(F.lead(value).over(w) - F.col(value))}, limit
    ).filter(F.col("step").isNotNull())


def top_transitions(steps: DataFrame, tie: Sequence[str], k: int = 10) -> DataFrame:
    return top_rows(steps, [], [F.col("step").desc(), *tie], k)


def _positions(sentences: DataFrame, doc_id: str, flag: str, fallback: bool) -> DataFrame:
    """Substantive sentences with 1-based position and count; a document's rows are bounded."""
    w = Window.partitionBy(doc_id)
    use = ~F.col(flag)
    if fallback:
        use = use | ~F.max(~F.col(flag)).over(w)
    kept = sentences.withColumn("_use", use).filter("_use")
    o = w.orderBy("idx")
    return kept.select(
        doc_id, "score", F.row_number().over(o).alias("i"), F.count(F.lit(1)).over(w).alias("n"),
        F.lag("score").over(o).alias("prev"),
    )


def volatility_asymmetry(sentences: DataFrame, doc_id: str, flag: str = "is_formulaic") -> DataFrame:
    """Mean absolute step and second-half mean minus first-half mean; 0 below two plain sentences."""
    rows = _positions(sentences, doc_id, flag, fallback=False)
    mid = F.floor(F.col("n") / 2)
    got = rows.groupBy(doc_id).agg(
        F.avg(F.abs(F.col("score") - F.col("prev"))).alias("v"),
        (F.avg(F.when(F.col("i") > mid, F.col("score"))) - F.avg(F.when(F.col("i") <= mid, F.col("score")))).alias("a"),
        F.max("n").alias("n"),
    )
    enough = F.col("n") >= 2
    return sentences.select(doc_id).distinct().join(got, doc_id, "left").select(
        doc_id,
        F.coalesce(F.when(enough, F.col("v")), F.lit(0.0)).alias("volatility"),
        F.coalesce(F.when(enough, F.col("a")), F.lit(0.0)).alias("asymmetry"),
    )


def classify_arc(
    sentences: DataFrame, doc_id: str, flag: str = "is_formulaic", threshold: float = 0.1
) -> DataFrame:
    """Arc type from the means of three thirds; the remainder goes to the last third."""
    rows = _positions(sentences, doc_id, flag, fallback=True)
    third, mid = F.floor(F.col("n") / 3), F.floor(F.col("n") / 2)
    part = lambda c: F.avg(F.when(c, F.col("score")))
    i = F.col("i")
    g = rows.groupBy(doc_id).agg(
        part(i <= third).alias("f"), part((i > third) & (i <= 2 * third)).alias("m"), part(i > 2 * third).alias("l"),
        (part(i > mid) - part(i <= mid)).alias("a"),
        (F.max("score") - F.min("score")).alias("sentiment_range"), F.max("n").alias("n"),
    )
    f, m, last = F.col("f"), F.col("m"), F.col("l")
    arc = (
        F.when(F.col("n") < 3, "flat")
        .when(m < F.least(f, last) - threshold, "valley")
        .when(m > F.greatest(f, last) + threshold, "peak")
        .when(last > f + threshold, "rising")
        .when(f > last + threshold, "falling")
        .otherwise("flat")
    )
    return g.select(
        doc_id, arc.alias("arc_type"), F.coalesce("a", F.lit(0.0)).alias("arc_asymmetry"), "sentiment_range",
        F.col("n").alias("sentence_count_substantive"),
    )


def _fold_block(k: float, h: float):
    """Two-sided sums over an ordered array of z scores, starting from a given state."""

    def step(acc, x):
        p = F.greatest(F.lit(0.0), acc["p"] + x["z"] - k)
        n = F.greatest(F.lit(0.0), acc["n"] - x["z"] - k)
        up, down = p > h, (p <= h) & (n > h)
        hit = up | down
        return F.struct(
            F.when(hit, 0.0).otherwise(p).alias("p"),
            F.when(hit, 0.0).otherwise(n).alias("n"),
            F.when(
                hit,
                F.array_append(
                    acc["hits"],
                    F.struct(x["i"].alias("i"), F.when(up, "positive").otherwise("negative").alias("direction")),
                ),
            ).otherwise(acc["hits"]).alias("hits"),
        )

    return step


def cusum_change_points(
    df: DataFrame, keys: Sequence[str], order: Sequence, value: str, k: float = 0.5, h: float = 1.5,
    block: int = 5000, limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Two-sided CUSUM of population z scores; both sums restart after a hit.

    The recursion is cut into blocks of `block` rows. Each round folds every block at
    once, from the end state its predecessor had in the round before; when no end
    state changes, all blocks agree with the sequential run. Blocks forget their start
    at the first restart or common zero, so a few rounds are usual.
    """
    ks = list(keys)
    stats = df.groupBy(*ks).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    rows = number_rows(df, ks, order, "_rn", limit)
    rows = rows.join(stats, ks) if ks else rows.crossJoin(F.broadcast(stats))
    z = rows.filter((F.col("_sd") > 0) & (F.col("_rn") > 1)).select(
        *ks, (F.col("_rn") - 1).alias("i"), ((F.col(value) - F.col("_mean")) / F.col("_sd")).alias("z"),
        F.floor((F.col("_rn") - 1) / F.lit(block)).alias("_b"),
    )
    blocks = pin(
        z.groupBy(*ks, "_b").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("xs"))
    )
    hit_t = "array<struct<i:bigint,direction:string>>"
    zero = F.lit(0.0)
    ends = None
    while True:
        if ends is None:
            start = blocks.select("*", zero.alias("_p0"), zero.alias("_n0"))
        else:
            prev = ends.select(*ks, (F.col("_b") + 1).alias("_b"), F.col("p").alias("_pp"), F.col("n").alias("_pn"))
            start = blocks.join(prev, [*ks, "_b"], "left").select(
                *ks, "_b", "xs", F.coalesce("_pp", zero).alias("_p0"), F.coalesce("_pn", zero).alias("_n0")
            )
        init = F.struct(F.col("_p0").alias("p"), F.col("_n0").alias("n"), F.array().cast(hit_t).alias("hits"))
        folded = start.select(*ks, "_b", F.aggregate("xs", init, _fold_block(k, h)).alias("s"))
        now = pin(folded.select(*ks, "_b", "s.p", "s.n", "s.hits"))
        if ends is not None:
            old = ends.select(*ks, "_b", F.col("p").alias("_op"), F.col("n").alias("_on"))
            moved = now.join(old, [*ks, "_b"]).filter((F.col("p") != F.col("_op")) | (F.col("n") != F.col("_on")))
            if moved.limit(1).count() == 0:
                break
        elif blocks.filter("_b > 0").limit(1).count() == 0:
            break
        ends = now
    return now.select(*ks, F.explode("hits").alias("_h")).select(
        *ks, F.col("_h.i").alias("index"), F.col("_h.direction").alias("direction")
    )


def rolling_days(
    df: DataFrame, keys: Sequence[str], date: str, value: str, days: int, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Mean of all rows in [day - days, day], one row per key and day.

    Rows shrink to day totals first, so a window holds at most one row per calendar day.
    """
    daily = df.filter(F.col(date).isNotNull()).groupBy(*keys, F.col(date).cast("date").alias("day")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(D.day_number(F.col("day"))).rangeBetween(-days, 0)
    return daily.select(
        *keys, "day", (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("rolling_mean"),
        F.sum("_n").over(w).alias("rows_in_window"),
    )


def travel_log(
    df: DataFrame, keys: Sequence[str], date: str, tie: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Days and km since the previous stop, cumulative km and km per day (0 days count as 1)."""
    prev = {
        f"_p{c}": _lag(c) for c in (date, "lat", "lng")
    }
    rows = with_neighbours(df, keys, [date, tie], 1, prev, limit)
    km = haversine_km(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng"))
    days = F.datediff(F.col(date), F.col(f"_p{date}"))
    rows = rows.withColumn("km", F.coalesce(km, F.lit(0.0))).withColumn("days", F.coalesce(days, F.lit(0)))
    rows = rows.drop(*prev)
    out = running_sums(rows, keys, [date, tie], {"total_km": F.col("km")}, limit)
    return out.withColumn("km_per_day", F.col("km") / F.greatest(F.col("days"), F.lit(1)))


def path_segments(df: DataFrame, keys: Sequence[str], order: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Line from each point to the next of the same key."""
    nxt = {
        "to_lat": lambda w: F.lead("lat").over(w), "to_lng": lambda w: F.lead("lng").over(w),
        "to_id": lambda w: F.lead(order).over(w),
    }
    rows = with_neighbours(df, keys, [order], 1, nxt, limit).filter(F.col("to_id").isNotNull())
    return rows.select(*keys, F.col(order).alias("from_id"), "to_id", F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"), "to_lat", "to_lng")


def yearly_drift(per_year: DataFrame, key: str, year: str, mean: str) -> DataFrame:
    """Change of the mean from the previous year present; years per key are few."""
    w = Window.partitionBy(key).orderBy(year)
    return per_year.withColumn("drift", F.col(mean) - F.lag(mean).over(w))


def top_connections(edges: DataFrame, k: int = 10) -> DataFrame:
    """Heaviest neighbours of every node of an undirected edge table (a, b, weight)."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight")
    )
    return top_rows(both, ["id"], [F.col("weight").desc(), "other"], k)


def capped_selection(
    pairs: DataFrame, doc: str, item: str, score: str, cap_class: Column, caps: Sequence[tuple[str, int]], total: int = 8
) -> DataFrame:
    """Best rows per document under per-class quotas and a total; skipped rows use no quota."""
    rows = pairs.withColumn("_class", cap_class)
    order = [F.col(score).desc(), F.col(item)]
    w = Window.partitionBy(doc, "_class").orderBy(*order)
    quota = F.lit(None).cast("int")
    for name, cap in caps:
        quota = F.when(F.col("_class") == name, cap).otherwise(quota)
    free = rows.filter(quota.isNull())
    capped = [
        rows.filter(F.col("_class") == n).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= c).drop("_r")
        for n, c in caps
    ]
    kept = free
    for c in capped:
        kept = kept.unionByName(c)
    return top_rows(kept, [doc], order, total).drop("_class")


def first_seen(df: DataFrame, entity: str, period: str) -> DataFrame:
    """First period of each entity; see `new_per_period` for the counts."""
    return df.groupBy(entity).agg(F.min(period).alias("first_period"))


def new_per_period(df: DataFrame, entity: str, period: str) -> DataFrame:
    return first_seen(df, entity, period).groupBy(F.col("first_period").alias("period")).agg(
        F.count(F.lit(1)).alias("new_entities")
    )


def even_sample(
    df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 20, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Every floor(m/n)-th row of each key (at least every row), first n of them."""
    ks = list(keys)
    rows = number_rows(df, ks, order, "_rn", limit)
    size = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_m"))
    rows = rows.join(size, ks) if ks else rows.crossJoin(F.broadcast(size))
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / n))
    at = F.col("_rn") - 1
    return rows.filter((at % step == 0) & (at / step < n)).drop("_rn", "_m")


def pick_example(df: DataFrame, keys: Sequence[str], text: str, tie: str) -> DataFrame:
    """The row whose text length is nearest 90, with a heavy penalty above 200."""
    n = F.length(text)
    cost = F.abs(n - 90) + F.when(n > 200, 1000).otherwise(0)
    best = df.groupBy(*keys).agg(F.min(F.struct(cost.alias("cost"), F.col(tie), F.col(text))).alias("_b"))
    return best.select(*keys, "_b.*")


def activity_profile(mentions: DataFrame, entity: str, date: str) -> DataFrame:
    """Years in which an entity occurs, as sorted text, and their number."""
    years = F.sort_array(F.collect_set(F.year(date)))
    return mentions.groupBy(entity).agg(years.alias("_y")).select(
        entity, F.array_join(F.transform("_y", lambda y: y.cast("string")), "|").alias("years"),
        F.size("_y").alias("persistence"),
    )




def _lag(col: str):
    return lambda w: F.lag(col).over(w)
