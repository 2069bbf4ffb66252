"""Ordered rewrite rules with hit counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators.lexical import in_list_count


@dataclass(frozen=True)
class Rule:
    """One rewrite: kind "word" replaces a whole word literally, "regex" replaces every match."""

    category: str
    kind: str
    match: str
    replacement: str


def read_rules(df: DataFrame) -> list[Rule]:
    """Rules from a small ordered table (seq, category, kind, match, replacement)."""
    rows = df.orderBy("seq").select("category", "kind", "match", "replacement").collect()
    return [Rule(*r) for r in rows]


def stages(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Runs of word rules that may be looked up in one pass, and single regex rules.

    A word rule joins the running pass unless an earlier rule of the pass writes text
    containing its word or already maps it; so the order of rules still decides.
    """
    out: list[list[Rule]] = []
    for rule in rules:
        run = out[-1] if out and rule.kind == "word" and out[-1][0].kind == "word" else None
        blocked = run is not None and any(
            rule.match in r.replacement or rule.match == r.match for r in run
        )
        if run is None or blocked:
            out.append([rule])
        else:
            run.append(rule)
    return out


def apply_rewrite_rules(
    df: DataFrame, text: str, rules: Sequence[Rule], out: str = "text_normalized"
) -> DataFrame:
    """The rewritten text, changes and a map of hits per category, counted on the text as it goes.

    Literal word rules cost one lookup pass per run; only true regexes are staged.
    """
    cats = list(dict.fromkeys(r.category for r in rules))
    keep = df.columns
    cur = df.select("*", F.col(text).alias("_t"), *[F.lit(0).alias(f"_n{i}") for i in range(len(cats))])
    for stage in stages(rules):
        counts = [F.col(f"_n{i}") for i in range(len(cats))]
        if stage[0].kind == "word":
            cur = cur.withColumn("_p", T.pieces(F.col("_t")))
            table = {r.match: r.replacement for r in stage}
            lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
            new = F.array_join(
                F.transform("_p", lambda t: F.coalesce(F.try_element_at(lookup, t), t)), ""
            )
            for i, c in enumerate(cats):
                mine = [r.match for r in stage if r.category == c]
                if mine:
                    counts[i] = counts[i] + in_list_count(F.col("_p"), mine)
        else:
            rule = stage[0]
            new = F.regexp_replace(F.col("_t"), rule.match, rule.replacement)
            i = cats.index(rule.category)
            counts[i] = counts[i] + F.regexp_count(F.col("_t"), F.lit(rule.match))
        cur = cur.select(*keep, new.alias("_t"), *[c.alias(f"_n{i}") for i, c in enumerate(counts)])
    hits = F.create_map(*[x for i, c in enumerate(cats) for x in (F.lit(c), F.col(f"_n{i}"))])
    total = sum((F.col(f"_n{i}") for i in range(len(cats))), F.lit(0))
    return cur.select(*keep, F.col("_t").alias(out), total.alias("changes"), hits.alias("rule_hits"))


def rule_hits(rewritten: DataFrame) -> DataFrame:
    """Hits per category over all documents; zero marks a dead category."""
    long = rewritten.select(F.explode("rule_hits").alias("category", "hits"))
    return long.groupBy("category").agg(F.sum("hits").alias("hits"))


def normalize_corpus(
    raw: DataFrame,
    corrected: DataFrame | None,
    rules: Sequence[Rule],
    doc_id: str = "id",
    text: str = "text",
    cleanup: bool = True,
    digraph: bool = True,
) -> DataFrame:
    """Corrected text if there is one, else raw text; then cleanup, digraphs and rules with counts."""
    src = raw.select(doc_id, F.col(text).alias("_raw"))
    if corrected is None:
        src = src.withColumn("text_original", F.col("_raw"))
    else:
        fixed = corrected.select(doc_id, F.nullif(F.col("text_corrected"), F.lit("")).alias("_fixed"))
        src = src.join(fixed, doc_id, "left").withColumn("text_original", F.coalesce("_fixed", "_raw"))
    src = src.select(doc_id, "text_original", F.col("text_original").alias("_a"), F.lit(0).alias("_extra"))
    if cleanup:
        src = src.select(
            doc_id, "text_original", T.cleanup(F.col("_a")).alias("_a"),
            (F.col("_extra") + T.cleanup_hits(F.col("_a"))).alias("_extra"),
        )
    if digraph:
        src = src.withColumn("_b", T.digraph_rewrite(F.col("_a")))
        src = src.select(
            doc_id, "text_original", F.col("_b").alias("_a"),
            (F.col("_extra") + T.digraph_hits(F.col("_a"), F.col("_b"))).alias("_extra"),
        )
    done = apply_rewrite_rules(src, "_a", rules)
    return done.select(
        doc_id, "text_original", "text_normalized", (F.col("changes") + F.col("_extra")).alias("changes"), "rule_hits"
    )
