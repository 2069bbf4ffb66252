"""How the driver tables stand in for letters, places, events and mentions.

Every view is a pure expression over a given table and has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators import lexical, sentences
from missiva.operators.scale import partitions, spread
from missiva.plans.catalog import table
from missiva.rules.danish import ABBREVIATIONS

# A small valence lexicon of words the documents contain.
VALENCE = {
    "the": 1, "and": 2, "of": -1, "is": 1, "in": -2, "with": 3, "by": -3, "that": -1, "le": 1,
    "la": -1, "de": 2, "des": -2, "un": 1, "elle": 3, "der": -1, "die": 1, "und": 2, "nicht": -3,
    "auch": 1, "el": 1, "que": -1, "los": 2, "para": -2, "con": 1, "no": -3,
}
GERMAN = ("der", "die", "und", "nicht", "sch", "auch", "für", "über")
FORMULAIC = (r"^(The|And|Le|La|De|Der|Die|El) ", r"(?i)(the|les|und)\.$")
OPEN_RE2 = r"^(The|And|Le|La|De|Der|Die|El) "
CLOSE_RE2 = r"(?i)(the|les|und)\.$"
AUDIENCES = (("english", ("en",)), ("romance", ("fr", "es")))
ONSET = "2021-07-01"

# White space that RE2's \s leaves out.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def letters(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    key = F.col("doc_id") % 25
    return d.select(
        F.col("doc_id").alias("id"),
        F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("doc_id") * 7919) % 1460).cast("int")).alias("date"),
        F.col("source").alias("sender"),
        F.col("lang").alias("recipient"),
        F.concat(F.lit("Place "), key.cast("string")).alias("place"),
        F.concat(
            ((key * 37) % 120 - 60).cast("string"), F.lit(","), ((key * 53) % 300 - 150).cast("string"), F.lit(",7")
        ).alias("location"),
        "text",
    )


LETTERS = """
letters AS (
  SELECT doc_id AS id, DATE '2020-01-01' + CAST((doc_id * 7919) % 1460 AS INTEGER) AS date,
         source AS sender, lang AS recipient, 'Place ' || (doc_id % 25) AS place,
         ((doc_id % 25) * 37) % 120 - 60 || ',' || (((doc_id % 25) * 53) % 300 - 150) || ',7' AS location, text
  FROM documents)"""


def sents(spark: SparkSession, sf: str) -> DataFrame:
    s = sentences.split_sentences(letters(spark, sf), "id", "text")
    return s.withColumn("is_formulaic", sentences.is_formulaic(F.col("sentence"), FORMULAIC))


_ABBR = "|".join(ABBREVIATIONS)
SENTS = f"""
marked AS (
  SELECT id, regexp_replace(text, '([.!?])({WS}+)([A-ZÆØÅ])', '\\1\x01\x02\\2\\3', 'g') AS t FROM letters),
guarded AS (
  SELECT id, regexp_replace(regexp_replace(t, '(^|[^\\p{{L}}])({_ABBR})\\.\x01', '\\1\\2.\x03', 'g'),
                            '(\\p{{Nd}})\\.\x01', '\\1.\x03', 'g') AS t FROM marked),
sent_lists AS (
  SELECT id, list_filter(
    list_transform(string_split_regex(t, '\x01\x02|\\n\\n+'),
      lambda x: trim(regexp_replace(replace(x, '\x03\x02', ''), '{WS}+', ' ', 'g'))), lambda x: length(x) >= 3) AS l
  FROM guarded),
sents AS (
  SELECT id, idx - 1 AS idx, l[idx] AS sentence,
         regexp_matches(l[idx], '{OPEN_RE2}') OR regexp_matches(l[idx], '{CLOSE_RE2}') AS is_formulaic
  FROM (SELECT id, l, unnest(generate_series(1, len(l))) AS idx FROM sent_lists))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with a lexicon score of about -1..1."""
    s = sents(spark, sf)
    keys = ["id", "idx", "is_formulaic"]
    v = lexical.lexicon_table(spark, VALENCE)
    raw = lexical.lexicon_sentiment(s, keys, "sentence", v)
    return raw.withColumn("score", F.col("score") / 10.0)


VALENCE_SQL = "valence(token, valence) AS (VALUES " + ", ".join(f"('{w}', {v})" for w, v in VALENCE.items()) + ")"
SCORED = f"""
{VALENCE_SQL},
toks AS (
  SELECT id, idx, is_formulaic, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM sents),
hits AS (SELECT id, idx, sum(valence) AS v FROM toks JOIN valence USING (token) GROUP BY id, idx),
scored AS (
  SELECT s.id, s.idx, s.is_formulaic, s.sentence, coalesce(h.v, 0) / 10.0::DOUBLE AS score
  FROM sents s LEFT JOIN hits h ON s.id = h.id AND s.idx = h.idx)"""

DOC_SCORES = """
flagged AS (SELECT *, bool_or(NOT is_formulaic) OVER (PARTITION BY id) AS anyp FROM scored),
doc_scores AS (
  SELECT id, avg(score) FILTER (use) AS mean, min(score) FILTER (use) AS min,
         quantile_cont(score, 0.1) FILTER (use) AS p10, quantile_cont(score, 0.9) FILTER (use) AS p90,
         max(score) FILTER (use) - min(score) FILTER (use) AS range,
         avg(CASE WHEN score < -0.05 THEN 1.0 ELSE 0.0 END) FILTER (use) AS negative_ratio,
         count(*) AS sentence_count, count(*) FILTER (use) AS sentence_count_substantive
  FROM (SELECT *, (NOT anyp OR NOT is_formulaic) AS use FROM flagged) GROUP BY id)"""


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body.strip()


def doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    from missiva.operators.scores import aggregate_scores

    return aggregate_scores(scored(spark, sf), "id")


def dated_scores(spark: SparkSession, sf: str) -> DataFrame:
    meta = letters(spark, sf).select("id", "date", "sender", "recipient", "place")
    return meta.join(doc_scores(spark, sf), "id")


DATED = "dated AS (SELECT l.id, l.date, l.sender, l.recipient, l.place, d.* EXCLUDE (id) FROM letters l JOIN doc_scores d ON l.id = d.id)"
BASE = (LETTERS, SENTS, SCORED, DOC_SCORES, DATED)


def rounded(df: DataFrame, *columns: str, dp: int = 9) -> DataFrame:
    """Rounding at the output only, so that both engines print the same digits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), dp) for c in columns})


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entity mentions: a supplier (id) named in an order (doc) on its date."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("date"))
    n = partitions(li, li.count())
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li, o = li.repartition(n, "doc"), o.repartition(n, "doc")
    return li.join(o, "doc")


MENTIONS = """
mentions AS (SELECT l_orderkey AS doc, l_suppkey AS id, CAST(o_orderdate AS DATE) AS date
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
