"""Person phrases such as "the old one": finding, classing and resolving them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.text import match_positions
from missiva.operators.scale import top_rows

# Phrase patterns.
PATTERNS = (
    ("den gamle", r"(?iU)\bden\s+gamle\b"),
    ("vor gamle", r"(?iU)\bvor\s+gamle\b"),
    ("min gamle", r"(?iU)\bmin\s+gamle\b"),
    ("den lille", r"(?iU)\bden\s+lille\b"),
    ("den unge", r"(?iU)\bden\s+unge\b"),
    ("den syge", r"(?iU)\bden\s+syge\b"),
    ("Bedstefar", r"(?iU)\bbedstefar\b"),
    ("Bedstemoder", r"(?iU)\bbedstemoder\b"),
    ("Bedstemor", r"(?iU)\bbedstemor\b"),
    ("Svigerfar", r"(?iU)\bsvigerfar\b"),
    ("Svigermor", r"(?iU)\bsvigermor\b"),
    ("Svigermoder", r"(?iU)\bsvigermoder\b"),
    ("Onkel", r"(?iU)\bonkel\b"),
    ("Tante", r"(?iU)\btante\b"),
    ("Stakkel", r"(?iU)\bstakkels?\b"),
)
# Phrases whose mentions are told apart one by one.
SPLIT = ("den gamle", "vor gamle", "min gamle")
CHECKED = ("den gamle", "den lille", "den unge", "den syge", "vor gamle", "min gamle")
# What the text after a phrase says about its use, first fit wins.
USAGE = (
    (
        r"(?iU)^\s+(kone|mand|dame|kvinde|herre|bager|backer|baker|præst|doktor|læge|ven|nabo|pige|dreng|karl|gaard|gård|"
        r"hus|kirke|vej|stol|maskine|tjæneste|tjeneste|gænge|gang|ordre|plads|stilling|historie|tid|vis|måde|maade|skik|"
        r"sæd|aftale|regel|system|bro|by|slot|rolle|bog|dur|rummel|sport|højde|høide|litevka|rønne|vane|tone|lov|ret)\b",
        "adjective",
    ),
    (r"(?U)^\s+(?!(?:Den|Det|Der|De|Da|Ja|Jeg|Vi|Han|Hun|Og|Men|Nu|Så|Saa)\b)[A-ZÆØÅ][a-zæøå]+\b", "adjective"),
    (r"(?U)^\s*(?:[.,;:!?)\-–(]|\z)", "substantive"),
    (
        r"(?iU)^\s+(er|var|har|havde|skal|vil|kan|må|maa|blev|blir|ved|siger|sagde|skriver|skrev|sidder|sad|gaar|går|gik|kom|"
        r"kommer|får|fik|gør|gjorde|ser|så|saa|sender|sendte|mener|mente|tænker|tænkte|laver|holdt|holder|ligger|faldt|"
        r"falder|kører|køre|rider|red|staar|står|sagt|fået|nok|nemlig|ellers|sig|ham|hende|det|at|i|op|af|til|på|paa|bort|"
        r"borte|afsted|oppe|endnu|igen|angaaende|angående|og)\b",
        "substantive",
    ),
)
# Context words that tell who is meant.
CONTEXT = {
    "family": r"(?iU)\b(far|faer|mor|moer|moder|fader|hjem|hjemme|hus|gaard|gård|børn|barn|familie|søster|broder|bror|"
    r"søndag|trine|musse|signe|bodil|roagger|obling)\b",
    "military": r"(?iU)\b(soldat|regiment|regt|kompagni|kaserne|feldt|felt|kommando|løjtnant|leutn|hauptm|feldw|feldv|"
    r"oberstl|krig|front|skyttegrav|gevær|kanon|batteri|konow|poulsen|petersen|madsen|braunsberg)\b",
    "community": r"(?iU)\b(nabo|kirke|præst|marked|fest|bryllup|begravelse|mejeri|skole|forening|møde)\b",
}
MALE = r"(?iU)\b(han|ham|hans|sin\s+mand|sin\s+far|sin\s+fader)\b"
FEMALE = r"(?iU)\b(hun|hende|hendes|sin\s+kone|sin\s+mor|sin\s+moder)\b"
FATHER_IN_TEXT = r"(?U)\b(Far|Faer)\b"
WAR_START = "1914-08-01"


def scan_epithets(
    df: DataFrame, doc_id: str, text: str, patterns: Sequence[tuple[str, str]] = PATTERNS,
    checked: Sequence[str] = CHECKED, usage: Sequence[tuple[str, str]] = USAGE, reach: int = 100, wide: int = 300,
) -> DataFrame:
    """One row per phrase with its use, a narrow and a wide context; found and classed inside the row."""
    groups = [F.transform(match_positions(F.col(text), rx), _labelled(name)) for name, rx in patterns]
    rows = df.withColumn("_h", F.explode(F.concat(*groups))).select(*df.columns, "_h.*")
    t, pos, end = F.col(text), F.col("position"), F.col("position") + F.length("matched")
    after = F.substring(t, end + 1, F.lit(50))
    kind = F.lit("ambiguous")
    for rx, name in reversed(list(usage)):
        kind = F.when(after.rlike(rx), name).otherwise(kind)
    kind = F.when(F.col("pattern").isin(*checked), kind).otherwise("substantive") if checked else F.lit("substantive")
    narrow0, wide0 = F.greatest(F.lit(0), pos - reach), F.greatest(F.lit(0), pos - wide)
    return rows.select(
        *[c for c in df.columns if c != text], "pattern", "position", "matched", kind.alias("usage"),
        F.substring(t, narrow0 + 1, end + reach - narrow0).alias("context"),
        F.substring(t, wide0 + 1, pos + wide - wide0).alias("wide_context"),
    )


def _labelled(name: str):
    return lambda h: F.struct(F.lit(name).alias("pattern"), h["position"].alias("position"), h["original"].alias("matched"))


def epithet_inventory(matches: DataFrame, doc_id: str) -> DataFrame:
    """Totals, documents and uses per pattern."""
    count = lambda u: F.count_if(F.col("usage") == u).alias(u)
    return matches.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct(doc_id).alias("documents"),
        count("substantive"), count("adjective"), count("ambiguous"),
    )


def strict_winner(scores: dict[str, Column], default: str = "ambiguous") -> Column:
    """Name of the score above all others."""
    out = F.lit(default)
    for name, s in scores.items():
        rest = [o for n, o in scores.items() if n != name]
        top = rest[0] if len(rest) == 1 else F.greatest(*rest)
        out = F.when(s > top, name).otherwise(out)
    return out


def resolve_epithets(
    matches: DataFrame, letters: DataFrame, doc_id: str, date: str, text: str, context: dict[str, str] = CONTEXT,
    male: str = MALE, female: str = FEMALE, named: str = FATHER_IN_TEXT, onset: str = WAR_START,
    entity_docs: DataFrame | None = None, split_patterns: Sequence[str] = SPLIT,
) -> DataFrame:
    """Referent of each substantive use of a split phrase: military_superior, father or other, for review.

    Votes of context words and pronouns around it, whether the father is named in the
    same document, and whether the war has begun decide in this order. Every mention of
    another phrase keeps its votes, with a NULL referent and confidence `unresolved`.
    """
    split = F.col("pattern").isin(*split_patterns)
    wide = F.col("wide_context")
    votes = {n: F.regexp_count(wide, F.lit(rx)) for n, rx in context.items()}
    gender = strict_winner({"male": F.regexp_count(wide, F.lit(male)), "female": F.regexp_count(wide, F.lit(female))}, "unknown")
    facts = letters.select(doc_id, F.col(date).alias("_date"), F.col(text).rlike(named).alias("_named"))
    rows = matches.filter(~split | (F.col("usage") == "substantive")).drop(date).join(facts, doc_id)
    if entity_docs is not None:
        told = entity_docs.select(doc_id).distinct().withColumn("_ent", F.lit(True))
        rows = rows.join(told, doc_id, "left").withColumn("_named", F.col("_named") | F.coalesce("_ent", F.lit(False)))
    rows = rows.withColumn("context_type", strict_winner(votes)).withColumn("gender", gender)
    kind = F.col("context_type")
    referent = (
        F.when(F.col("_named"), "military_superior")
        .when(F.col("gender") == "female", "other")
        .when(kind == "military", "military_superior")
        .when(kind == "family", "father")
        .when((kind == "ambiguous") & (F.col("_date") >= F.lit(onset).cast("date")), "military_superior")
        .otherwise("other")
    )
    return rows.select(
        doc_id, F.col("_date").alias(date), "pattern", "position", "context_type", "gender",
        F.col("_named").alias("co_occurs"), F.when(split, referent).alias("referent"),
        F.when(split, "review").otherwise("unresolved").alias("confidence"), "context",
    )


def resolution_summary(resolved: DataFrame, min_mentions: int = 3) -> DataFrame:
    """Counts per pattern and referent with the co-mention rate of the pattern; rare patterns are left out."""
    per = resolved.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.avg(F.col("co_occurs").cast("double")), 3).alias("co_occurrence_rate"),
        *[F.count_if(F.col("referent") == r).alias(r) for r in ("military_superior", "father", "other")],
    )
    return per.filter(F.col("mentions") >= min_mentions)


def resolution_evidence(
    resolved: DataFrame, doc_id: str, caps: Sequence[tuple[str, int]] = (("military_superior", 15), ("father", 10), ("other", 5))
) -> DataFrame:
    """First mentions of each referent in document order."""
    best = top_rows(resolved, ["pattern", "referent"], [doc_id, "position"], max(c for _, c in caps))
    cap = F.lit(0)
    for name, c in caps:
        cap = F.when(F.col("referent") == name, c).otherwise(cap)
    return best.filter(F.col("rank") <= cap)
