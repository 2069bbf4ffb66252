"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of
`documents`; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm import passages, ppm, simhash, toxicity
from missiva.llm.common import staged
from missiva.llm.queries import packed_documents

TOXIC = 0.7
# A text goes only if no learnt language is likelier than the others together.
UNSURE = 0.5
KEPT = ["doc_id", "text", "_rest"]


def carried(docs: DataFrame) -> DataFrame:
    """The id and text that the stages read, and all other columns as one beside them: no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below TOXIC; a null or empty text scores as the bias, and stays."""
    weights = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score_texts(carried(docs), weights, keep=KEPT).filter(F.col("score") < TOXIC)
    return restored(found, docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the learnt languages; null texts, texts without a letter and undecided ones go."""
    found = ppm.identify_languages(carried(docs), ppm.train(docs.select("doc_id", "text", "lang")), keep=KEPT)
    return restored(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= UNSURE)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, the one with the smallest id."""
    return simhash.keep_one_per_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay where they come first and are cut out elsewhere."""
    out = passages.without_repeats(carried(docs), mark="cut")
    if "n_chars" in docs.columns:
        n, kind = F.length("text"), docs.schema["n_chars"].dataType
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", F.when(F.col("cut"), n.cast(kind)).otherwise(F.col("_rest.n_chars"))))
    return restored(out, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("language_id", keep_languages), ("simhash", drop_near_copies), ("substring_dedup", drop_repeats),
    ("packing", pack_sequences),
]

# Trained scores and tokenizers have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
