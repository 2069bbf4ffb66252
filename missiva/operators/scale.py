"""Ordered and broadcast work that stays safe when one key holds most of the rows.

A plain Spark window sends a whole key to one task. Every ordered operator of the
package goes through this module: it measures the largest group first and keeps
the plain window for bounded groups. Beyond the bound, rows are range-partitioned
on (keys, order), so a hot key spreads over many blocks, and per-block totals
(a table with at most keys + blocks rows) carry the state from block to block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.session import pin

GROUP_LIMIT = 1_000_000
# The built-in percentile keeps every distinct value of a group in one hash map.
PERCENTILE_LIMIT = 100_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of one task where an operator sets the number of partitions itself.
TASK_ROWS = 500_000


def bounded_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring rows and text size; else leave the join as is."""
    width = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    if seen[0] <= rows and (seen[1] or 0) <= size:
        return F.broadcast(df)
    return df


def partitions(df: DataFrame, rows: int) -> int:
    """As many partitions as keep a task near TASK_ROWS; never fewer than the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def _order(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Range-partition on (keys, order) and pin, so `_blk` grows with the order."""
    cols = [F.col(k) for k in keys] + _order(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(df.repartitionByRange(n, *cols).withColumn("_blk", F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    sums: Mapping[str, Column],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Cumulative sums up to and with the current row; `order` must be unique within keys."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if largest_group(df, keys) <= limit:
        part = [F.col(k) for k in keys] or [F.lit(0)]
        w = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(*upto)
        return df.select("*", *[F.sum(c).over(w).alias(o) for o, c in sums.items()])
    blocks = ordered_blocks(df, keys, order)
    totals = blocks.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_blk").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums],
    )
    on = F.col("_blk") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, "_blk").orderBy(*_order(order)).rowsBetween(*upto)
    return blocks.join(starts, on).select(
        *df.columns, *[(F.sum(c).over(w) + F.col(f"_s_{o}")).alias(o) for o, c in sums.items()]
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn", limit: int = GROUP_LIMIT
) -> DataFrame:
    """1-based position of every row within its key."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("long")}, limit)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    reach: int,
    exprs: Mapping[str, Callable],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Window expressions that look at most `reach` rows to either side.

    `exprs` maps an output name to a function of the ordered window spec. Large
    groups are numbered and cut into chunks of `limit` rows; the `reach` rows on
    each side of a cut are copied into the neighbouring chunk.
    """
    limit = max(limit, 2 * reach + 1)
    if largest_group(df, keys) <= limit:
        part = [F.col(k) for k in keys] or [F.lit(0)]
        w = Window.partitionBy(*part).orderBy(*_order(order))
        return df.select("*", *[e(w).alias(o) for o, e in exprs.items()])
    rows = number_rows(df, keys, order, "_rn", limit)
    at = lambda shift: F.floor((F.col("_rn") - 1 + F.lit(shift)) / F.lit(limit))
    own = at(0)
    chunks = F.array_distinct(F.array(at(-reach), own, at(reach)))
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(chunks)).filter("_chunk >= 0")
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    done = rows.select("*", *[e(w).alias(o) for o, e in exprs.items()]).filter("_chunk = _own")
    return done.select(*df.columns, *exprs)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Mapping[str, float],
    limit: int = PERCENTILE_LIMIT,
) -> DataFrame:
    """Exact linear-interpolation percentiles, one row per (keys, metric)."""
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("_m"),
    ).select(*keys, "_m.metric", "_m.value").filter(F.col("value").isNotNull())
    by = [*keys, "metric"]
    if largest_group(long, by) <= limit:
        return long.groupBy(*by).agg(
            *[F.percentile("value", F.lit(p)).alias(o) for o, p in probs.items()]
        )
    counts = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, by, ["value"], {"_hi": F.col("_n")}, max(limit, GROUP_LIMIT) if limit >= PERCENTILE_LIMIT else limit)
    size = long.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    cum = cum.join(size, by)
    aggs = []
    for o, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        first = F.col("_hi") - F.col("_n")
        inside = lambda i: (i >= first) & (i < F.col("_hi"))
        frac = pos - lo
        part = F.when(inside(lo), F.col("value") * (1 - frac)).otherwise(0.0) + F.when(
            inside(hi), F.col("value") * frac
        ).otherwise(0.0)
        aggs.append(F.sum(part).alias(o))
    return cum.groupBy(*by).agg(*aggs)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """First k rows per key; Spark prunes to k rows per task before the shuffle."""
    if not keys:
        # A global top-k is a bounded sort of at most k rows per task.
        head = df.orderBy(*_order(order)).limit(k)
        return head.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order(order))))
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row work on an input with fewer splits than cores; large inputs stay as read."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
