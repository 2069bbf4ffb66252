"""Pattern findings, corrections with provenance, and their checks. All of it stays inside the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators.quality import context
from missiva.rules import danish


@dataclass(frozen=True)
class ScanRule:
    """One finding rule. `lead` is what must stand directly before a hit and is not part of it, however long; a hit
    with `not_before` in the `window` characters before it, line ends included, does not count.

    `corrected` None only flags. `inner` is the pattern without context that
    rewrites the match with `corrected` as replacement; without it `corrected` is
    literal, capitalised like the match if `keep_case`.
    """

    pattern: str
    corrected: str | None
    category: str
    confidence: str = "high"
    method: str = "pattern_match"
    inner: str | None = None
    keep_case: bool = False
    lead: str | None = None
    not_before: str | None = None
    window: int = 40


def _corrected(rule: ScanRule, original: Column) -> Column:
    if rule.corrected is None:
        return F.lit(None).cast("string")
    if rule.inner is not None:
        return F.regexp_replace(original, rule.inner, rule.corrected)
    if rule.keep_case:
        first = F.substring(original, 1, 1)
        return F.when(first != F.lower(first), rule.corrected[:1].upper() + rule.corrected[1:]).otherwise(rule.corrected)
    return F.lit(rule.corrected)


def findings_array(text: Column, rules: Sequence[ScanRule]) -> Column:
    """All findings of a text in rule order."""
    groups = []
    for seq, r in enumerate(rules):
        build = _finding(seq, r)
        groups.append(F.transform(_hits(text, r), build))
    return F.concat(*groups)


def _hits(text: Column, r: ScanRule) -> Column:
    if r.lead is None:
        hits = T.match_positions(text, r.pattern)
    else:
        whole = T.match_positions(text, f"(?:{r.lead})(?:{r.pattern})")

        def bare(h: Column) -> Column:
            hit = F.regexp_replace(h["original"], f"^(?:{r.lead})", "")
            return F.struct((h["position"] + F.length(h["original"]) - F.length(hit)).alias("position"), hit.alias("original"))

        hits = F.transform(whole, bare)
    if r.not_before is None:
        return hits
    start = lambda h: F.greatest(F.lit(0), h["position"] - r.window)
    return F.filter(hits, lambda h: ~F.substring(text, start(h) + 1, h["position"] - start(h)).rlike(r.not_before))


def _finding(seq: int, r: ScanRule):
    return lambda h: F.struct(
        h["position"].alias("position"), F.lit(seq).alias("seq"), h["original"].alias("original"),
        _corrected(r, h["original"]).alias("corrected"), F.lit(r.category).alias("category"),
        F.lit(r.confidence).alias("confidence"), F.lit(r.method).alias("method"),
    )


def scan_patterns(df: DataFrame, doc_id: str, text: str, rules: Sequence[ScanRule], reach: int = 40) -> DataFrame:
    """One row per finding with its context."""
    rows = df.select(doc_id, F.col(text).alias("_t"), F.explode(findings_array(F.col(text), rules)).alias("f"))
    return rows.select(doc_id, "f.*", context(F.col("_t"), F.col("f.position"), reach).alias("context"))


# Up to so many fixes are cut from the text itself; for more it is split into characters once.
FEW_FIXES = 32


def _apart(fixes: Column) -> Column:
    """Whether fixes (p, o, ...) in order of their place leave each other alone."""
    rest = F.greatest(F.size(fixes) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(fixes, F.lit(1), rest), F.slice(fixes, F.lit(2), rest), lambda a, b: a["p"] + F.length(a["o"]) <= b["p"])
    return F.forall(pairs, lambda ok: ok)


def assembled(text: Column, fixes: Column) -> Column:
    """The text with fixes (p, o, c) put in, which lie apart and in order: cut once at their ends, joined once."""
    begins = F.concat(F.array(F.lit(0)), F.transform(fixes, lambda f: f["p"] + F.length(f["o"])))
    ends = F.concat(F.transform(fixes, lambda f: f["p"]), F.array(F.length(text)))
    put = F.concat(F.transform(fixes, lambda f: f["c"]), F.array(F.lit("")))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    whole = lambda between: F.array_join(F.zip_with(spans, put, lambda s, c: F.concat(between(s), c)), "")
    # A lambda's variable is made once, however many spans use it.
    many = F.transform(F.array(F.split(text, "")), lambda chars: whole(lambda s: F.array_join(F.slice(chars, s["a"] + 1, s["n"]), "")))[0]
    few = whole(lambda s: F.substring(text, s["a"] + 1, s["n"]))
    return F.when(F.size(fixes) == 0, text).when(F.size(fixes) <= FEW_FIXES, few).otherwise(many)


def _in_order(findings: Column) -> Column:
    fixes = F.filter(findings, lambda f: f["corrected"].isNotNull())
    return F.array_sort(F.transform(fixes, lambda f: F.struct(f["position"].alias("p"), f["original"].alias("o"), f["corrected"].alias("c"))))


def apply_corrections(df: DataFrame, doc_id: str, text: str, rules: Sequence[ScanRule]) -> DataFrame:
    """text_source, text_corrected and every finding.

    Fixes that lie apart are put in together, in one pass over the text. Where some overlap, all of the text's fixes
    go in one by one from the right, and only where the text still matches.
    """
    kept = df.select(doc_id, F.col(text).alias("text_source"), findings_array(F.col(text), rules).alias("_all"))
    kept = kept.withColumn("_fixes", _in_order(F.col("_all")))
    order = F.transform(
        F.filter("_all", lambda f: f["corrected"].isNotNull()),
        lambda f: F.struct((-f["position"]).alias("k"), f["seq"].alias("seq"), f["original"].alias("o"), f["corrected"].alias("c")),
    )

    def fix(t, f):
        pos, n = -f["k"], F.length(f["o"])
        fits = F.substring(t, pos + 1, n) == f["o"]
        put = F.concat(F.substring(t, F.lit(1), pos), f["c"], F.substring(t, pos + n + 1, F.length(t)))
        return F.when(fits, put).otherwise(t)

    one_by_one = F.aggregate(F.array_sort(order), F.col("text_source"), fix)
    fixed = F.when(_apart(F.col("_fixes")), assembled(F.col("text_source"), F.col("_fixes"))).otherwise(one_by_one)
    return kept.select(doc_id, "text_source", fixed.alias("text_corrected"), F.col("_all").alias("corrections"))


def correction_summary(corrected: DataFrame) -> DataFrame:
    """Findings per category, and how many of them change the text."""
    f = corrected.select(F.explode("corrections").alias("f"))
    return f.groupBy("f.category").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("f.corrected").isNotNull()).alias("applied")
    )


def validate_corrections(
    df: DataFrame, doc_id: str, allowed: str = danish.ALLOWED_CHARS, review: str = danish.REVIEW_CHARS,
    known_errors: Sequence[str] = danish.KNOWN_ERRORS, lo: float = 0.95, hi: float = 1.05,
) -> DataFrame:
    """(doc, check, message) for each failed check of text_source, text_corrected, corrections."""
    src, out = F.col("text_source"), F.col("text_corrected")
    rows = df.select(doc_id, "text_source", "text_corrected", "corrections", _in_order(F.col("corrections")).alias("_a"))

    def undo(acc, c):
        # Left of the position everything is source text again, so source offsets hold.
        fits = F.substring(acc, c["p"] + 1, F.length(c["c"])) == c["c"]
        back = F.concat(F.substring(acc, F.lit(1), c["p"]), c["o"], F.substring(acc, c["p"] + F.length(c["c"]) + 1, F.length(acc)))
        return F.when(fits, back).otherwise(acc)

    # A text that is its source with all fixes put in goes back to it; others are undone fix by fix.
    restored = (_apart(F.col("_a")) & (assembled(src, F.col("_a")) == out)) | (F.aggregate("_a", out, undo) == src)
    flagged = F.transform(F.filter("corrections", lambda c: c["corrected"].isNull()), lambda c: c["original"])
    strange = F.array_distinct(F.filter(F.split(F.regexp_replace(out, allowed, ""), ""), lambda c: c != ""))
    strange = F.filter(
        strange, lambda ch: ~(F.lit(review).contains(ch) & F.exists(flagged, lambda o: o.contains(ch)))
    )
    check = lambda name, msg: F.struct(F.lit(name).alias("check"), msg.alias("message"))
    none = F.array().cast("array<struct<check:string,message:string>>")
    off = F.filter("corrections", lambda c: F.substring(src, c["position"] + 1, F.length(c["original"])) != c["original"])
    nxt = F.zip_with(
        F.slice("_a", F.lit(1), F.greatest(F.size("_a") - 1, F.lit(0))), F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))),
        lambda a, b: F.struct((a["p"] + F.length(a["o"]) > b["p"]).alias("bad"), b["p"].alias("p")),
    )
    over = F.filter(nxt, lambda x: x["bad"])
    ratio = F.length(out) / F.nullif(F.length(src), F.lit(0))
    errors = F.filter(F.array(*[F.lit(e) for e in known_errors]), lambda e: out.contains(e))
    found = F.concat(
        F.when(~restored, F.array(check("round_trip", F.lit("reversal differs from source")))).otherwise(none),
        F.transform(strange, lambda c: check("alphabet", c)),
        F.transform(off, lambda c: check("position", c["position"].cast("string"))),
        F.transform(over, lambda x: check("overlap", x["p"].cast("string"))),
        F.transform(errors, lambda e: check("known_error", e)),
        F.when(~ratio.between(lo, hi), F.array(check("length_ratio", F.round(ratio, 4).cast("string")))).otherwise(none),
    )
    return rows.select(doc_id, F.explode(found).alias("v")).select(doc_id, "v.*")


def context_sentence(text: Column, position: Column, word: Column, window: int = 150) -> Column:
    """The sentence around a word at an offset, within a window of characters."""
    start = F.greatest(F.lit(0), position - window)
    before = F.substring(text, start + 1, position - start)
    after = F.substring(text, position + F.length(word) + 1, F.lit(window))
    head = F.regexp_replace(before, r"(?sU)^.*[.!?]\s+", "")
    tail = F.regexp_replace(after, r"(?sU)([.!?])\s.*$", "$1")
    whole = F.concat(head, F.substring(text, position + 1, F.length(word)), tail)
    return T.collapse(F.replace(whole, F.lit("<PARA>"), F.lit(" ")))


# Corrections of encoding and scanning errors.
DEFAULT_RULES = (
    ScanRule("\u0085", "", "encoding_artifact", method="encoding_scan"),
    ScanRule("´(?=[\\n\\r]|\\z)", "", "encoding_artifact", method="encoding_scan"),
    ScanRule(r"(?iU)\blove\.e\b", "lovede", "ocr_artifact", keep_case=True),
    ScanRule("á", "a", "encoding_artifact", method="encoding_scan"),
    ScanRule("¥", "W", "encoding_artifact", method="encoding_scan"),
    ScanRule(r"(?U)\bPakke\.n\b", "Pakken", "ocr_artifact"),
    ScanRule(r"\? \?", "?", "typing_error"),
    ScanRule(
        r"(?<![a-zæøå])[a-zæøå]{4,}+(?<!chl|egt|atl|att|omp|ffz|elv|efr|nf|iv|eg|es|az|an|ang)\.[A-ZÆØÅ][a-zæøå]",
        "$1. $2", "typing_error", inner=r"^(.*)\.(..)$", not_before="(?i)poststempel|absender|feldpost|konvolut",
    ),
    ScanRule(r"(?U)\bTor\b", "for", "typing_error", "medium", lead=r"(?iU)\btak\s++"),
    ScanRule(r"(?U)\bdia\b", "du", "typing_error", "medium"),
    ScanRule(r"(?U)\bDia\b", "Du", "typing_error", "medium", lead=r"(?U)[^\s.!?]\s*+"),
    ScanRule(r"(?iU)\bst\b(?=\s+\w)", "at", "typing_error", "medium", keep_case=True, lead=r"(?iU)\bude\s++"),
    # No farming word before it: another word, the hit before, or no word at all.
    ScanRule(
        r"(?iU)\bkorn\b", "kom", "typing_error", "medium", keep_case=True,
        lead=rf"(?iU)\b(?!(?:{'|'.join(danish.FARMING)})\s)\w++\s++|(?U)(?:\G|(?<=[^\w\s]))\s*+",
    ),
    ScanRule(r"(?iU)\blier\b", "her", "typing_error", "medium", keep_case=True, lead=rf"(?iU)\b(?:{'|'.join(danish.NOUN_MARKERS)})\s++"),
    ScanRule(r"(?iU)\bvj\b", "vi", "typing_error", "medium", keep_case=True),
    ScanRule("«", None, "encoding_artifact", "review", "encoding_scan"),
)
