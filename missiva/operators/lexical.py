"""Lexicon scores, marker rates, richness and document frequencies."""

from __future__ import annotations

import gzip
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from missiva.functions import text as T
from missiva.operators.scale import bounded_broadcast, partitions
from missiva.operators.sentences import tokens
from missiva.rules import danish
from missiva.session import pin


def lexicon_table(spark: SparkSession, valences: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame([(w, float(v)) for w, v in valences.items()], "token string, valence double")


def lexicon_variants(lexicon: DataFrame, word: str = "token") -> DataFrame:
    """The words and their forms without umlauts."""
    bare = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), danish.UMLAUT_FOLD, F.col(word))
    both = F.explode(F.array_distinct(F.array(F.col(word), bare)))
    return lexicon.select(*[c for c in lexicon.columns if c != word], both.alias(word)).distinct()


def lexicon_sentiment(df: DataFrame, keys: Sequence[str], text: str, valence: DataFrame) -> DataFrame:
    """Sum of word valences per key; keys without a lexicon word score 0."""
    toks = df.select(*keys, F.explode_outer(T.words(F.lower(F.col(text)))).alias("token"))
    hit = toks.join(bounded_broadcast(valence.select("token", "valence")), "token", "left")
    return hit.groupBy(*keys).agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("score"))


def document_mean_of_sentences(scores: DataFrame, doc_id: str) -> DataFrame:
    return scores.groupBy(doc_id).agg(F.avg("score").alias("mean_score"), F.sum("score").alias("total_score"))


def in_list_count(toks: Column, listed: Sequence[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(*listed)))


def marker_rates(
    df: DataFrame,
    doc_id: str,
    text: str,
    lexicons: Mapping[str, Sequence[str]] = danish.MARKERS,
    phrases: Sequence[str] = danish.REASSURANCE,
    shift: tuple[str, str] = ("first_person_singular", "first_person_plural"),
) -> DataFrame:
    """Hits per 100 white-space tokens for each lexicon, phrase counts and a two-class share.

    The lexicons are rule data of fixed size, so they are compiled into the row
    expression and the text never leaves its partition.
    """
    # Split once, then keep the listed tokens: each lexicon counts among those few only.
    split = df.select(doc_id, text, T.blank_tokens(F.lower(F.col(text))).alias("_toks"))
    listed = sorted({w for ws in lexicons.values() for w in ws})
    some = split.select(doc_id, text, F.coalesce(F.size("_toks"), F.lit(0)).alias("tokens"), F.filter("_toks", lambda t: t.isin(*listed)).alias("_hits"))
    counted = some.select(
        doc_id,
        "tokens",
        *[F.coalesce(in_list_count(F.col("_hits"), ws), F.lit(0)).alias(f"_{n}") for n, ws in lexicons.items()],
        F.coalesce(reduce(lambda a, b: a + b, [F.regexp_count(F.col(text), F.lit(p)) for p in phrases]), F.lit(0)).alias(
            "phrase_count"
        ),
    )
    per_100 = lambda c: F.when(F.col("tokens") > 0, F.col(c) * 100.0 / F.col("tokens")).otherwise(0.0)
    a, b = (F.col(f"_{s}") for s in shift)
    return counted.select(
        doc_id,
        "tokens",
        *[per_100(f"_{n}").alias(f"{n}_rate") for n in lexicons],
        F.when(a + b > 0, a / (a + b)).otherwise(0.0).alias("singular_share"),
        "phrase_count",
    )


def term_density(df: DataFrame, doc_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Hits and hits per 100 white-space tokens for a lexicon table with umlaut variants."""
    listed = lexicon_variants(lexicon.select("token")).withColumn("_hit", F.lit(1))
    toks = df.select(doc_id, F.explode_outer(T.blank_tokens(F.lower(F.col(text)))).alias("token"))
    hits = toks.join(bounded_broadcast(listed), "token", "left").groupBy(doc_id).agg(
        F.count("token").alias("tokens"), F.count("_hit").alias("term_count")
    )
    return hits.select(
        doc_id,
        "term_count",
        F.when(F.col("tokens") > 0, F.col("term_count") * 100.0 / F.col("tokens")).otherwise(0.0).alias("density"),
    )


@F.pandas_udf(DoubleType())
def char_entropy(texts: pd.Series) -> pd.Series:
    """Shannon bits per character over lower-cased characters, relative to the raw length."""

    def bits(t):
        if not t:
            return 0.0
        codes = np.frombuffer(t.lower().encode("utf-32-le"), dtype=np.uint32)
        # A table of the lowest plane is faster than a sort.
        k = np.bincount(codes) if codes.max() < 1 << 16 else np.unique(codes, return_counts=True)[1]
        p = k[k > 0] / len(t)
        return float(-(p * np.log2(p)).sum())

    return texts.map(bits).astype("float64")


def richness_words(text: Column) -> Column:
    """Lower-cased words without digits and punctuation."""
    return T.words(F.lower(F.regexp_replace(F.regexp_replace(text, r"[\p{Nd}]", ""), r"[\p{P}\p{S}]", " ")))


RICHNESS = "word_count long, type_count long, ttr double, mattr double, mtld double, hdd double, hapax_ratio double"


def _factors(words: Sequence[int], threshold: float) -> float:
    """Factors of one reading direction; the open rest counts in proportion."""
    seen: set[int] = set()
    add, n, types, factors = seen.add, 0, 0, 0.0
    for w in words:
        n += 1
        if w not in seen:
            # A new word never lowers the ratio.
            add(w)
            types += 1
        elif types / n <= threshold:
            seen.clear()
            n, types, factors = 0, 0, factors + 1.0
    return factors + (1 - types / n) / (1 - threshold) if n else factors


def _richness(words: Sequence[str], window: int, threshold: float, sample: int) -> tuple:
    n = len(words)
    if n == 0:
        return 0, 0, None, None, None, None, 0.0
    codes, _ = pd.factorize(np.asarray(words, dtype=object), use_na_sentinel=False)
    counts = np.bincount(codes)
    ttr = mattr = len(counts) / n
    if n >= window:
        # A word counts in the windows that hold it and no earlier copy of it.
        order = np.argsort(codes, kind="stable")
        before = np.full(n, -1)
        again = codes[order[1:]] == codes[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        at = np.arange(n)
        first = np.maximum(before + 1, np.maximum(at - window + 1, 0))
        total = int(np.maximum(np.minimum(at, n - window) - first + 1, 0).sum())
        mattr = total / window / (n - window + 1)
    words = codes.tolist()
    both = [_factors(words, threshold), _factors(words[::-1], threshold)]
    mtld = sum(n / (f or 1.0) for f in both) / 2
    hdd = None
    if n >= sample:
        # Types with equal counts share the chance of missing a sample drawn without replacement.
        ks, types = np.unique(counts.astype(float), return_counts=True)
        i = np.arange(sample)
        absent = np.prod(np.maximum(0.0, n - ks[:, None] - i) / (n - i), axis=1)
        hdd = float(np.sum(types * (1 - absent)) / sample)
    hapax = int((counts == 1).sum()) / n
    return n, len(counts), ttr, mattr, mtld, hdd, hapax


def lexical_richness(
    df: DataFrame, doc_id: str, text: str, window: int = 50, threshold: float = 0.72, sample: int = 42
) -> DataFrame:
    """Word and type counts, TTR, MATTR, MTLD, HD-D and hapax ratio of each document.

    The sliding window and the resetting factors are sequential within a text, so
    they run over Arrow batches of token arrays; no row leaves its partition.
    """

    @F.pandas_udf(RICHNESS)
    def measure(batch: pd.Series) -> pd.DataFrame:
        out = [_richness(list(w) if w is not None else [], window, threshold, sample) for w in batch]
        return pd.DataFrame(out, columns=[c.split()[0] for c in RICHNESS.split(", ")])

    return df.select(doc_id, measure(richness_words(F.col(text))).alias("_r")).select(doc_id, "_r.*")


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Gzip bytes over UTF-8 bytes, one Arrow batch at a time; Spark has no gzip function."""

    def ratio(t):
        raw = (t or "").encode("utf-8")
        return len(gzip.compress(raw)) / len(raw) if raw else 0.0

    return texts.map(ratio).astype("float64")


#: Letters of a text for one distinct word of it, roughly: sizes the tasks of `tfidf`.
LETTERS_PER_ROW = 16


def tfidf(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Long table of l2-normalised tf-idf weights with smoothed idf ln((1+n)/(1+df))+1."""
    toks = T.words(F.lower(F.col(text)))
    # The texts are dealt by document, so counting words and norms needs no further shuffle.
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    dealt = df.select(doc_id, text).repartition(partitions(df, (size or 0) // LETTERS_PER_ROW), doc_id)
    tf = dealt.select(doc_id, F.explode(toks).alias("token")).groupBy(doc_id, "token").agg(
        F.count(F.lit(1)).alias("tf")
    )
    # Document frequency is pre-aggregated, so a word present everywhere is one row.
    idf = tf.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).select(
        "token", (F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1).alias("idf")
    )
    idf = bounded_broadcast(pin(idf), rows=1_000_000)
    raw = tf.join(idf, "token").select(doc_id, F.struct("token", (F.col("tf") * F.col("idf")).alias("w")).alias("_e"))
    # The distinct words of one document are a bounded list that gives norm and rows.
    docs = raw.groupBy(doc_id).agg(F.collect_list("_e").alias("_l"))
    size = F.sqrt(F.aggregate("_l", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    # The norm is a column of its own step: next to explode it would be worked out per word.
    flat = docs.withColumn("_norm", size).select(doc_id, "_norm", F.explode("_l").alias("_e"))
    return flat.select(doc_id, "_e.token", (F.col("_e.w") / F.col("_norm")).alias("weight"))


# Rare words of more letters meet common ones by parts instead of deletion forms.
SHORT = 12


def hapax_near_common(
    df: DataFrame,
    doc_id: str,
    text: str,
    min_common: int = 5,
    max_distance: int = 2,
    stop: Sequence[str] = danish.GERMAN_FUNCTION_WORDS,
    letters: str = "a-zæøåäöü",
    context: int = 40,
    max_foreign: int = 1,
) -> DataFrame:
    """Words that occur once and lie within a small edit distance of a common word.

    Candidates come from equi-joins. Two words within distance d share a form reached by
    deleting at most d letters from each; that serves rare words of up to SHORT letters. A
    longer one is cut into d + 1 parts, of which one stands unchanged in the other word, at
    most d places off. So a word of any length has a bounded number of keys.
    """
    low = F.lower(F.col(text))
    # Words are whole runs of word characters made of the listed letters only.
    runs = df.select(doc_id, F.explode(T.words(low)).alias("w")).filter(
        F.col("w").rlike(f"^[{letters}]{{3,}}$")
    )
    # The vocabulary is used from both sides: pin it, so the texts are read once.
    freq = pin(runs.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(doc_id).alias("_at")))
    rare = freq.filter((F.col("n") == 1) & ~F.col("w").isin(*stop)).select("w", "_at")
    common = freq.filter(F.col("n") >= min_common).select(F.col("w").alias("c"), F.col("n").alias("c_n"))
    # A vocabulary is small in bytes but each word yields many forms: keep all cores busy.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deletions = lambda c: deletion_forms(F.col(c), max_distance)
    rare = rare.repartition(n, "w")
    left = rare.filter(F.length("w") <= SHORT).select("w", "_at", F.explode(deletions("w")).alias("_form"))
    right = common.filter(F.length("c") <= SHORT + max_distance).select("c", "c_n", F.explode(deletions("c")).alias("_form"))
    parts = rare.filter(F.length("w") > SHORT).select("w", "_at", F.explode(word_parts(F.col("w"), max_distance)).alias("_part"))
    places = common.filter(F.length("c") > SHORT - max_distance).select("c", "c_n", F.explode(part_places(F.col("c"), max_distance)).alias("_part"))
    met = left.join(right, "_form").drop("_form").unionByName(parts.join(places, "_part").drop("_part"))
    near = (
        met.select("w", "_at", "c", "c_n", F.levenshtein("w", "c", max_distance).alias("d"))
        .filter(F.col("d") >= 0)
        .groupBy("w", "_at")
        .agg(F.min(F.struct("d", "c", "c_n")).alias("_best"))
        .select(F.col("_at").alias("_doc"), "w", "_best.*")
    )
    # Findings are far fewer than documents: pin them, then bring them to the texts.
    near = bounded_broadcast(pin(near))
    docs = df.select(F.col(doc_id), F.col(text).alias("_t"), low.alias("_low"))
    # The word occurs once in all texts, so one search finds its place. The letters come
    # first in the pattern and the edges are looked at only where they match.
    edge = r"[\p{L}\p{N}_]"
    whole = F.concat(F.col("w"), F.lit(f"(?<!{edge}"), F.col("w"), F.lit(f")(?!{edge})"))
    placed = docs.join(near, docs[doc_id] == F.col("_doc")).withColumn(
        "position", F.regexp_instr(F.col("_low"), whole) - 1
    )
    start = F.greatest(F.lit(0), F.col("position") - context)
    ctx = F.substring(F.col("_t"), start + 1, F.col("position") + context - start)
    before = F.rtrim(F.substring(F.col("_t"), F.lit(1), F.col("position")), F.lit(T.BLANKS))
    sentence_start = (before == "") | F.substring(before, F.lit(-1), F.lit(1)).isin(".", "!", "?")
    first = F.substring(F.col("_t"), F.col("position") + 1, F.lit(1))
    proper = (first != F.lower(first)) & ~sentence_start
    foreign = F.size(F.array_intersect(F.array_distinct(T.words(F.lower(ctx))), F.array(*[F.lit(s) for s in stop])))
    return placed.filter(~proper & (foreign <= max_foreign)).select(
        doc_id, "position", F.col("w").alias("original"), F.col("c").alias("suggested"),
        F.col("d").alias("distance"), F.col("c_n").alias("suggested_count"),
    )


def _part(length: Column, i: int, depth: int) -> tuple[Column, Column]:
    """Start and size of part i of depth + 1 parts of a word of that length."""
    start = F.floor(length * i / (depth + 1)).cast("int")
    return start, F.floor(length * (i + 1) / (depth + 1)).cast("int") - start


def word_parts(word: Column, depth: int) -> Column:
    """(length, part number, part) of the depth + 1 parts of a word."""
    size = F.length(word)
    spans = [_part(size, i, depth) for i in range(depth + 1)]
    return F.array(*[F.struct(size.alias("n"), F.lit(i).alias("i"), F.substring(word, a + 1, k).alias("p")) for i, (a, k) in enumerate(spans)])


def part_places(word: Column, depth: int) -> Column:
    """Every (length, part number, part) by which a word within `depth` edits can meet this one."""
    shifts = F.array(*[F.lit(x) for x in range(-depth, depth + 1)])

    def at(other: Column, i: int) -> Column:
        size = F.length(word) + other
        a, k = _part(size, i, depth)
        inside = F.filter(shifts, lambda s: (a + s >= 0) & (a + s + k <= F.length(word)))
        return F.transform(inside, lambda s: F.struct(size.alias("n"), F.lit(i).alias("i"), F.substring(word, a + s + 1, k).alias("p")))

    return F.array_distinct(F.flatten(F.transform(shifts, lambda other: F.concat(*[at(other, i) for i in range(depth + 1)]))))


def deletion_forms(word: Column, depth: int) -> Column:
    """The word and every form reached by deleting up to `depth` letters."""
    forms = F.array(word)
    for _ in range(depth):
        shorter = F.flatten(
            F.transform(
                forms,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.length(w)),
                    lambda i: F.concat(
                        F.substring(w, F.lit(1), i - F.lit(1)), F.substring(w, i + F.lit(1), F.length(w))
                    ),
                ),
            )
        )
        forms = F.array_distinct(F.concat(forms, shorter))
    return forms
