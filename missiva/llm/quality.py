"""Quality rules with certified cutoffs, in DataFrame functions only.

Every rule rejects a document whose signal exceeds a cutoff. A cutoff is taken from labelled documents: a grid of
candidates comes from one half of them, and on the other half an exact binomial test decides whether the rule
rejects more than its share of good documents. Candidates are tested from the largest down to the first that fails
(fixed-sequence testing; a smaller cutoff never rejects less), and the strata and rules share one error budget
(Bonferroni). So with probability `1 - delta` no rule rejects more than `risk / rules` of any stratum's good
documents, and all of them together no more than `risk`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import staged

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# A-Z and the capitals of the Latin-1 range.
CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7)
RULES = ("symbol_share", "capital_share", "exclamation_share", "dup_line_share")
QUANTILES = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0)


def _without(text: str, signs: str) -> Column:
    return F.translate(F.col(text), signs, "")


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the carried columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_capitals, n_exclamations of every row. A null text counts as empty; every count is then 0.

    All work stays in the row. Repeated windows are found on 64-bit hashes: a text without a repeated one (the
    common case) only builds a set, others sort their hashes once, so the time is n log n in a text's words.
    """
    carry = carry or {}
    kept = list(carry)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[c.alias(k) for k, c in carry.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = rows.select("*", F.btrim("_t", F.lit(BLANKS)).alias("_b"))
    rows = rows.select(
        "doc_id", *kept, F.length(_without("_t", BLANKS)).alias("word_chars"),
        (F.length("_t") - F.length(_without("_t", SYMBOLS))).alias("n_symbols"),
        (F.length("_t") - F.length(_without("_t", CAPITALS))).alias("n_capitals"),
        (F.length("_t") - F.length(_without("_t", "!"))).alias("n_exclamations"),
        F.filter(F.split("_t", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0).alias("_lines"),
        F.when(F.col("_b") != "", F.split("_b", r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW)))
    rows = rows.select(
        "doc_id", *kept, F.size("_w").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_exclamations",
        F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, windows).alias("_h"),
    )
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    others = [c for c in rows.columns if c != "_h"]
    rows = rows.select(*others, F.when(has, F.array_sort(placed)).alias("_s"))
    same = lambda j, k: F.get(F.col("_s"), j)["h"] == F.get(F.col("_s"), k)["h"]
    starts = F.transform(
        F.sequence(F.lit(0), F.size("_s") - 1),
        lambda j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), F.get(F.col("_s"), j)["i"]),
    )
    rows = rows.select(*others, F.when(F.col("_s").isNotNull(), F.array_sort(F.array_compact(starts))).alias("_p"))
    # Windows overlap: each adds the words up to the next repeated window, at most its own.
    covered = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW))))
    rows = rows.select(*others, covered.alias("_c"))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_exclamations")
    return rows.select(
        "doc_id", *kept, *[F.col(c).cast("long").alias(c) for c in counts], F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def signals() -> dict[str, Column]:
    """Rule name -> its signal on the columns of `base_counts`; a text without words has 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "n_words"), "capital_share": share("n_capitals", "word_chars"),
        "exclamation_share": share("n_exclamations", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact up to rounding, for integer columns 0 <= k <= n; 1 where k >= n * p."""
    ratio = math.log(p / (1 - p))
    step = lambda acc, i: F.struct(
        (acc["t"] + F.log(n - i + 1) - F.log(i) + ratio).alias("t"),
        (acc["s"] + F.exp(acc["t"] + F.log(n - i + 1) - F.log(i) + ratio)).alias("s"),
    )
    first = n * math.log1p(-p)
    start = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))
    # With k < n * p the sum is small: at most n * p terms, each from the one before.
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda acc: acc["s"])))


def certified_cutoffs(
    labelled: DataFrame, risk: float = 0.05, delta: float = 0.05, cost: float = 20.0,
) -> DataFrame:
    """(stratum, cutoffs map<rule, double>) from rows of (doc_id, stratum, good, the signals).

    Rows fall in a tuning or a holdout half by a hash of their id. Among the candidates whose test on the holdout
    passes, the one with the best tuning score (bad documents caught less `cost` times good ones lost) is taken, the
    larger one on a tie; a rule that catches nothing, or passes nowhere, has no cutoff in that stratum.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    long = labelled.select(
        "stratum", "good", half.alias("tune"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("_r"),
    ).select("stratum", "good", "tune", "_r.rule", "_r.value")
    grid = long.filter("tune").groupBy("rule").agg(
        F.array_sort(F.array_distinct(F.percentile_approx("value", F.array(*map(F.lit, QUANTILES)), F.lit(10_000)))).alias("grid")
    )
    # One row per rule.
    placed = long.join(F.broadcast(grid), "rule")
    bucket = F.size(F.filter("grid", lambda t: F.col("value") > t))
    counted = placed.groupBy("stratum", "rule", "grid", bucket.alias("bucket")).agg(
        F.count_if(~F.col("tune") & F.col("good")).alias("hold"), F.count_if(F.col("tune") & F.col("good")).alias("lost"),
        F.count_if(F.col("tune") & ~F.col("good")).alias("caught"),
    )
    # At most one entry per candidate and one more.
    cells = counted.groupBy("stratum", "rule", "grid").agg(F.collect_list(F.struct("bucket", "hold", "lost", "caught")).alias("_c"))
    above = lambda f: F.aggregate(
        F.filter("_c", lambda c: c["bucket"] > F.col("j")), F.lit(0).cast("long"), lambda a, c: a + c[f]
    )
    every = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c["hold"])
    tried = cells.select("*", F.posexplode("grid").alias("j", "cutoff")).select(
        "stratum", "rule", "cutoff", above("hold").alias("k"), every.alias("n"), above("lost").alias("lost"), above("caught").alias("caught")
    )
    strata = labelled.agg(F.count_distinct("stratum").alias("strata"))
    # With the cutoff the rejections grow and so does the tail: what passes is what a descent would have reached.
    tests = F.col("strata") * len(RULES)
    passed = tried.crossJoin(F.broadcast(strata)).filter(
        (F.col("caught") > 0) & (binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= F.lit(delta) / tests)
    )
    gain = F.col("caught") - cost * F.col("lost")
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("g"), F.col("cutoff").alias("c"))).alias("_b")).filter("_b.g > 0")
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "_b.c"))).alias("cutoffs"))


def judge_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
    label: str = "quality", min_words: int = 20, max_repeat_percent: int = 30, risk: float = 0.05, delta: float = 0.05,
) -> DataFrame:
    """The counts of every row, with `base_failed`, `kept` and the `reasons` that speak against it.

    A row fails the base with fewer than `min_words` words or more than `max_repeat_percent` percent repeated words.
    Else it is kept unless a signal exceeds the certified cutoff of its stratum; a stratum without cutoffs (none
    labelled, too few to certify, null labels) rejects nothing more. Cutoffs are fitted on all labelled documents; of
    conflicting labels the lower one counts. Null strata form one stratum, null ids have no label. Repeated rows are
    judged alike, each on its own.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("mark")).dropna()
    marks = marks.groupBy("doc_id").agg(F.min("mark").alias("mark"))
    place = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    # Counted once: a few numbers a row, for the cutoffs and for the verdicts.
    rows = staged(base_counts(docs, doc_id, text, {"stratum": place}))
    known = rows.join(marks, "doc_id")
    cutoffs = certified_cutoffs(known.select("doc_id", "stratum", (F.col("mark") > 0).alias("good"), *[c.alias(r) for r, c in signals().items()]), risk, delta)
    # No more strata than labelled rows.
    rows = rows.join(F.broadcast(cutoffs), "stratum", "left")
    over = [F.when(c > F.col("cutoffs")[r], F.lit(r)) for r, c in signals().items()]
    short = F.col("n_words") < min_words
    repeats = 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    reasons = F.array_compact(F.array(F.when(short, "too_short"), F.when(repeats, "repeats"), *over))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (short | repeats).alias("base_failed"), (F.size(reasons) == 0).alias("kept"), reasons.alias("reasons"),
    )
