"""Readers for the file layouts of a letter collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missiva.functions import text as X
from missiva.operators.scale import number_rows
from missiva.sources.json_parts import json_entries

LETTERS = "id string, date string, sender string, recipient string, place string, location string, text string"
EVENTS = "Date string, EndDate string, Front string, Battle string, Location string, Coordinates string, wikipedia string"


def read_corpus_csv(spark: SparkSession, path: str, schema: str = LETTERS) -> DataFrame:
    """Letters from CSV with quoted, multi-line fields; rows without a numeric id are dropped."""
    raw = spark.read.csv(
        path, schema=schema, header=True, quote='"', escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    cols = [F.coalesce(X.strip(F.col(c)), F.lit("")).alias(c) for c in raw.columns if c not in ("id", "date")]
    return raw.select(
        F.col("id").try_cast("long").alias("id"), F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), *cols
    ).filter(F.col("id").isNotNull())


def read_corpus_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a JSON array with lower-case column names.

    With a schema, files of any size are read in byte ranges by many tasks; without one, a file is a task, as its
    columns have to be found first.
    """
    if schema is None:
        df = spark.read.option("multiLine", True).json(path)
    else:
        kind = schema if isinstance(schema, str) and schema.lower().startswith("struct") else schema.simpleString() if isinstance(schema, T.StructType) else f"struct<{_fields(schema)}>"
        rows = json_entries(spark, path).select(F.explode(F.from_json(F.concat(F.lit("["), "entries", F.lit("]")), f"array<{kind}>")).alias("r"))
        df = rows.select("r.*")
    return df.toDF(*[c.lower() for c in df.columns])


def _fields(schema: str) -> str:
    """"a int, b string" as the fields of a struct type."""
    return T.StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


GEOJSON = (
    "features array<struct<properties:struct<place_id:string,place:string,aliases:array<string>>,"
    "geometry:struct<type:string,coordinates:array<double>>>>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features as rows; coordinates are [lng, lat], aliases default to an empty list."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    at = lambda i: F.try_element_at(F.col("f.geometry.coordinates"), F.lit(i))
    return f.select(
        "f.properties.place_id", "f.properties.place",
        F.coalesce("f.properties.aliases", F.array().cast("array<string>")).alias("aliases"), at(2).alias("lat"), at(1).alias("lng"),
    )


def explode_keyed_json(df: DataFrame, col: str, value_type: str) -> DataFrame:
    """A `{key: value}` JSON text column to one row per key."""
    parsed = F.from_json(F.col(col), f"map<string,{value_type}>")
    return df.select(*[c for c in df.columns if c != col], F.explode(parsed).alias("key", "value"))


def read_keyed_json(spark: SparkSession, path: str, value_type: str, key: str = "id") -> DataFrame:
    """A file holding one `{id: struct}` object, as rows with the struct's fields; read in byte ranges by many tasks."""
    text = json_entries(spark, path).select(F.concat(F.lit("{"), "entries", F.lit("}")).alias("value"))
    rows = explode_keyed_json(text, "value", value_type).withColumnRenamed("key", key)
    return rows.select(key, "value.*") if value_type.lower().startswith("struct") else rows


def read_vector_csv(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """One-row CSV of numbers as a unit vector; the number of columns must be `dims`."""
    from missiva.operators.vectors import unit

    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(dims)])
    head = spark.read.text(path).limit(1).select(F.size(F.split("value", ",")).alias("n")).first()
    if head is None or head["n"] != dims:
        raise ValueError(f"expected {dims} columns in {path}, found {head and head['n']}")
    rows = spark.read.csv(path, schema=schema, header=True)
    return rows.select(unit(F.array(*rows.columns)).alias("vector"))


def read_packed_vectors(spark: SparkSession, path: str, index: DataFrame, dims: int) -> DataFrame:
    """Flat float32 records joined with index(id, position) to (id, vector).

    Records have a fixed length, so Spark splits the file; only the decoding is Python.
    """
    records = spark.sparkContext.binaryRecords(path, 4 * dims).zipWithIndex()
    rows = records.map(lambda r: (r[1], bytearray(r[0]))).toDF("position long, raw binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["vector"] = [np.frombuffer(bytes(b), dtype="<f4").tolist() for b in pdf["raw"]]
            yield pdf[["position", "vector"]]

    return index.join(rows.mapInPandas(decode, "position long, vector array<float>"), "position").drop("position")


def read_events_csv(spark: SparkSession, path: str, lat_lng: str = "coordinates") -> DataFrame:
    """Dated events with coordinates, numbered by start date; an open end is the start."""
    raw = spark.read.csv(path, schema=EVENTS, header=True, quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    day = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")).cast("date")
    part = lambda i: F.try_element_at(F.split(lat_lng, ","), F.lit(i)).try_cast("double")
    rows = raw.select(
        day("date").alias("start"), F.coalesce(day("enddate"), day("date")).alias("end"), "front", "battle", "location",
        part(1).alias("lat"), part(2).alias("lng"), "wikipedia",
    )
    return number_rows(rows.filter("start IS NOT NULL"), [], ["start", "battle"], "event_id")


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty table of the same type if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


