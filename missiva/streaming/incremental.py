"""The same summaries kept up to date from a stream of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.operators.quality import changed_rows, fingerprint


def monthly_density_stream(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows per day with the month it belongs to; a day's state goes once the watermark has passed it."""
    w = F.window(F.col(ts), "1 day")
    daily = stream.withWatermark(ts, delay).groupBy(w).agg(F.count(F.lit(1)).alias("count"))
    return daily.select(D.month_key(F.col("window.start")).alias("month"), F.col("window.start").cast("date").alias("day"), "count")


def upsert_changed(state_path: str, key: str, columns: list[str], version: str = ""):
    """A foreachBatch function that appends only rows whose fingerprint differs from the latest one stored for their key.

    The order of writing is kept in `stored_at`. A batch that is tried again after its rows were written adds nothing,
    as they are the latest of their keys by then.
    """

    def run(batch: DataFrame, _epoch: int) -> None:
        from missiva.sources.readers import read_optional

        marked = fingerprint(batch, key, columns, version).dropDuplicates([key, "fingerprint"])
        marked = marked.withColumn("stored_at", F.current_timestamp())
        seen = read_optional(batch.sparkSession, state_path, marked.schema)
        latest = seen.groupBy(key).agg(F.max_by("fingerprint", "stored_at").alias("fingerprint"))
        changed_rows(marked, latest, key).write.mode("append").parquet(state_path)

    return run
