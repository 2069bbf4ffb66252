"""Syntax metrics on a token table, triage of findings, and the profile of a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from missiva.operators import lexical
from missiva.rules import danish

# Dependency labels and word classes.
SUBORDINATE = ("mark", "advcl", "ccomp", "xcomp", "acl", "relcl")
CLAUSES = (*SUBORDINATE, "ROOT", "conj")
CONTENT = ("NOUN", "VERB", "ADJ", "ADV")


def _deepest(head: dict) -> int:
    depth: dict[int, int] = {}
    for t in head:
        way, at = [], t
        while at not in depth and head.get(at, at) != at:
            way.append(at)
            at = head[at]
        d = depth.setdefault(at, 0)
        for w in reversed(way):
            d += 1
            depth[w] = d
    return max(depth.values(), default=0)


@F.pandas_udf(IntegerType())
def tree_depth(arcs: pd.Series, rest: pd.Series) -> pd.Series:
    """Longest way from a token to its root, for sentences given as arrays of numbers, i * 65536 + head, and of {i, head}."""

    def deepest(some, more):
        head = dict(zip((some >> 16 & 0xFFFF).tolist(), (some & 0xFFFF).tolist(), strict=True))
        return _deepest(head | {a["i"]: a["head"] for a in more} if len(more) else head)

    return pd.Series([deepest(a, r) for a, r in zip(arcs, rest, strict=True)], dtype="int32")


def syntax_metrics(tokens: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Dependency distances, sentence length, clause and tense ratios, content share and tree depth.

    tokens(doc_id, sent_id, i, head_i, dep, pos, tense). Sentences shrink to one row first; labels
    are sorted and shuffled as bits, an arc as one number, or as {i, head} where that has no room.
    """
    verb = F.col("pos") == "VERB"
    kinds = {
        "far": F.col("dep") != "ROOT", "sub": F.col("dep").isin(*SUBORDINATE), "cl": F.col("dep").isin(*CLAUSES),
        "past": verb & (F.col("tense") == "Past"), "pres": verb & (F.col("tense") == "Pres"), "content": F.col("pos").isin(*CONTENT),
    }
    bit = {c: 1 << k for k, c in enumerate(kinds)}
    bits = reduce(lambda a, b: a + b, [F.when(kinds[c], bit[c]).otherwise(0) for c in kinds])
    rows = tokens.select(doc_id, "sent_id", "i", "head_i", bits.alias("_bits"))
    has = lambda c: F.col("_bits").bitwiseAND(F.lit(bit[c])) != 0
    i, head = F.col("i"), F.col("head_i")
    far = F.when(has("far"), F.abs(i - head))
    short = F.coalesce(i.between(0, 0xFFFF) & head.between(0, 0xFFFF), F.lit(False))
    sent = rows.groupBy(doc_id, "sent_id").agg(
        F.sum(far).alias("ds"), F.count(far).alias("dn"), F.max(far).alias("dx"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(has(c)).alias(c) for c in ("sub", "cl", "past", "pres", "content")],
        F.collect_list(F.when(short, F.shiftleft(i.cast("int"), 16).bitwiseOR(head.cast("int")))).alias("arcs"),
        F.collect_list(F.when(~short, F.struct(i.alias("i"), head.alias("head")))).alias("rest"),
    ).withColumn("depth", tree_depth("arcs", "rest"))
    div = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    tense = F.col("past") + F.col("pres")
    return sent.groupBy(doc_id).agg(
        div("ds", "dn").alias("mean_dependency_distance"), F.coalesce(F.max("dx"), F.lit(0)).alias("max_dependency_distance"),
        F.avg("n").alias("mean_sentence_length"), div("sub", "cl").alias("subordinate_clause_ratio"),
        F.max("depth").alias("max_tree_depth"), div("past", tense).alias("past_tense_ratio"),
        div("pres", tense).alias("present_tense_ratio"), div("content", "n").alias("lexical_density"),
    )


def assemble_profile(
    letters: DataFrame, doc_id: str, text: str, tokens: DataFrame | None = None, volatility: DataFrame | None = None,
    lexicons: Mapping[str, Sequence[str]] = danish.MARKERS, phrases: Sequence[str] = danish.REASSURANCE,
    shift: tuple[str, str] = ("first_person_singular", "first_person_plural"), foreign: Sequence[str] = danish.GERMAN_MILITARY,
    keep: Sequence[str] = ("date", "recipient"), dp: int = 4,
) -> DataFrame:
    """One wide row of metrics per document; empty documents get zeros and no richness.

    Text metrics are computed where the text lies; only their numbers are joined.
    """
    spark = letters.sparkSession
    rich = lexical.lexical_richness(letters, doc_id, text)
    marks = lexical.marker_rates(letters, doc_id, text, lexicons, phrases, shift).drop("tokens")
    density = lexical.term_density(letters, doc_id, text, lexical.lexicon_table(spark, {w: 1.0 for w in foreign}))
    info = letters.select(doc_id, lexical.char_entropy(text).alias("char_entropy"), lexical.compression_ratio(text).alias("compression_ratio"))
    parts = [rich, marks, density, info]
    if tokens is not None:
        parts.append(syntax_metrics(tokens, doc_id))
    if volatility is not None:
        parts.append(volatility)
    out = reduce(lambda a, b: a.join(b, doc_id, "left"), parts, letters.select(doc_id, *keep))
    skip = {doc_id, *keep, "mattr", "mtld", "hdd", "ttr"}
    numeric = [c for c, t in out.dtypes if c not in skip]
    out = out.na.fill(0, numeric)
    return out.withColumns({c: F.round(c, dp) for c, t in out.dtypes if t == "double"})


# Points of the triage.
POS_POINTS = {
    "NOUN": 2, "VERB": 2, "ADJ": 2, "ADV": 2, "PROPN": 2, "NUM": 2,
    "DET": 1, "ADP": 1, "CCONJ": 1, "SCONJ": 1, "PART": 1, "AUX": 1, "PRON": 1,
}


def triage_candidates(findings: DataFrame, tokens: DataFrame, points: Mapping[str, int] = POS_POINTS) -> DataFrame:
    """Score findings by how well a parser knew the word: likely_valid or review_required.

    findings(doc_id, position, original, capital), tokens(doc_id, position, i, token, pos, lemma,
    ent, is_oov) with the parsed sentence of each finding. The token equal to the word counts,
    else the first that contains it or is contained in it without being much shorter.
    """
    target, tok = F.lower("original"), F.lower("token")
    fuzzy = (tok.contains(target) | target.contains(tok)) & (F.length(tok) >= F.length(target) - 2)
    kind = F.when(tok == target, 0).when(fuzzy, 1)
    j = findings.select("doc_id", "position", "original").join(tokens, ["doc_id", "position"]).withColumn("_k", kind)
    best = j.filter("_k IS NOT NULL").groupBy("doc_id", "position").agg(
        F.min(F.struct("_k", "i", "pos", F.lower("lemma").alias("lemma"), "ent", "is_oov")).alias("t")
    )
    rows = findings.join(best, ["doc_id", "position"], "left")
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    found, lemma = F.col("t").isNotNull(), F.coalesce(F.col("t.lemma"), F.lit(""))
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    valid = (
        F.coalesce(F.try_element_at(table, F.col("t.pos")), F.lit(0))
        + one(found & (lemma != "") & (lemma != target), 2)
        + one(found & (F.coalesce(F.col("t.ent"), F.lit("")) != ""), 2)
        + one(F.col("capital"), 1)
    )
    doubt = one(~found, 3) + one(F.col("t.pos") == "X", 2) + one(F.col("t.is_oov"), 1)
    rows = rows.withColumn("valid_score", valid).withColumn("suspicious_score", doubt)
    label = F.when((F.col("valid_score") >= 3) | (F.col("valid_score") - F.col("suspicious_score") >= 1), "likely_valid").otherwise("review_required")
    return rows.select("doc_id", "position", "original", F.col("t.pos").alias("pos"), "valid_score", "suspicious_score", label.alias("classification"))
