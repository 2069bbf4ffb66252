"""Writers for published tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet", partition: Mapping[str, str] | None = None) -> None:
    """Write each named table below `base`, partitioned where a column is named."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        if partition and name in partition:
            out = out.partitionBy(partition[name])
        out.format(fmt).save(f"{base}/{name}")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors as Parquet: typed, splittable and compressed, unlike a flat float file."""
    df.write.mode("overwrite").parquet(path)
