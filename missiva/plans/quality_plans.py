"""Corrections, audits, epithets, profiles and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators import corrections as C
from missiva.operators import epithets as E
from missiva.operators import profile as P
from missiva.operators import quality as Q
from missiva.operators import series as S
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import LETTERS, SENTS, rounded, with_

RULES = (
    C.ScanRule("tion", "sion", "spelling", "high"),
    C.ScanRule("é", "e", "accent", "medium"),
    C.ScanRule("eaux", None, "plural", "review"),
    C.ScanRule(r"[a-z]\.[A-Z]", "$1. $2", "spacing", "medium", inner=r"^(.)\.(.)$"),
)

FIND = """
lit(seq, original, corrected, category, confidence) AS (VALUES (0, 'tion', 'sion', 'spelling', 'high'), (1, 'é', 'e', 'accent', 'medium'), (2, 'eaux', NULL, 'plural', 'review')),
parts AS (SELECT id, text, lit.*, string_split(text, original) AS p FROM letters JOIN lit ON contains(text, original)),
found AS (SELECT id, seq, original, corrected, category, confidence, length(array_to_string(p[1:k], '')) + (k - 1) * length(original) AS position, text
          FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM parts))"""


def corrected(spark, sf, rules=RULES[:3]):
    return C.apply_corrections(X.letters(spark, sf), "id", "text", rules)


@query(
    "scan_patterns",
    with_(
        LETTERS, FIND,
        body="""SELECT id, position::BIGINT AS position, original, corrected, category, confidence,
        replace(substring(text, greatest(0, position - 40) + 1, position + 40 - greatest(0, position - 40)), chr(10), ' ') AS context FROM found""",
    ),
)
def _(spark, sf):
    out = C.scan_patterns(X.letters(spark, sf), "id", "text", RULES[:3])
    return out.select("id", F.col("position").cast("long").alias("position"), "original", "corrected", "category", "confidence", "context")


@query(
    "apply_corrections",
    with_(
        LETTERS,
        body="""SELECT id, md5(replace(replace(text, 'tion', 'sion'), 'é', 'e')) AS corrected_md5,
        (len(string_split(text, 'tion')) + len(string_split(text, 'é')) + len(string_split(text, 'eaux')) - 3)::BIGINT AS findings FROM letters""",
    ),
)
def _(spark, sf):
    return corrected(spark, sf).select("id", F.md5("text_corrected").alias("corrected_md5"), F.size("corrections").cast("long").alias("findings"))


@query("correction_summary", with_(LETTERS, FIND, body="SELECT category, count(*) AS findings, count(corrected) AS applied FROM found GROUP BY 1"))
def _(spark, sf):
    return C.correction_summary(corrected(spark, sf))


@query(
    "validate_corrections",
    with_(
        LETTERS,
        "c AS (SELECT id, text AS s, replace(replace(text, 'tion', 'sion'), 'é', 'e') AS o FROM letters)",
        "ch AS (SELECT DISTINCT id, unnest(string_split(o, '')) AS x FROM c)",
        body="""SELECT id, 'alphabet' AS \"check\", x AS message FROM ch WHERE x <> '' AND NOT regexp_matches(x, '[\\x20-\\x7E\\n\\tæøåÆØÅüäöÜÄÖß]')
        UNION ALL SELECT id, 'known_error', 'sion the' FROM c WHERE contains(o, 'sion the')
        UNION ALL SELECT id, 'length_ratio', round(length(o) / length(s), 4)::VARCHAR FROM c WHERE NOT (length(o) / length(s) BETWEEN 0.95 AND 1.05)""",
    ),
)
def _(spark, sf):
    return C.validate_corrections(
        corrected(spark, sf), "id", allowed=r"[\x20-\x7E\n\tæøåÆØÅüäöÜÄÖß]", known_errors=("sion the",)
    )


@query(
    "context_sentence",
    with_(
        LETTERS, FIND,
        "c AS (SELECT id, position, text, substring(text, greatest(0, position - 150) + 1, position - greatest(0, position - 150)) AS b, substring(text, position + 5, 150) AS a FROM found WHERE seq = 0)",
        body=f"""SELECT id, position::BIGINT AS position, trim(regexp_replace(replace(regexp_replace(b, '(?s)^.*[.!?]{X.WS}+', '') || 'tion' || regexp_replace(a, '(?s)([.!?]){X.WS}.*$', '\\1'), '<PARA>', ' '), '{X.WS}+', ' ', 'g')) AS sentence FROM c""",
    ),
)
def _(spark, sf):
    f = X.letters(spark, sf).select("id", "text", F.explode(T.match_positions(F.col("text"), "tion")).alias("f"))
    return f.select("id", F.col("f.position").cast("long").alias("position"), C.context_sentence(F.col("text"), F.col("f.position"), F.col("f.original")).alias("sentence"))


PATTERNS = (("of the", "of the"), ("de la", "de la"), ("und der", "und der"))
USAGE = ((r"^ (the|le|la|der) ", "adjective"), (r"^[.,;:]", "substantive"), (r"^ (is|and|que|und)", "substantive"))
CTX = {"family": "(?i)the", "military": "(?i)and", "community": "(?i)de"}


def epithets(spark, sf):
    lt = X.letters(spark, sf).select("id", "date", "text")
    return E.scan_epithets(lt, "id", "text", PATTERNS, checked=("of the", "de la"), usage=USAGE)


EPI = """
pat(pattern, rx) AS (VALUES ('of the', 'of the'), ('de la', 'de la'), ('und der', 'und der')),
ep AS (SELECT id, date, text, pattern, string_split(text, rx) AS p FROM letters JOIN pat ON contains(text, rx)),
eo AS (SELECT *, length(array_to_string(p[1:k], '')) + (k - 1) * length(pattern) AS position FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM ep)),
eu AS (SELECT *, substring(text, position + length(pattern) + 1, 50) AS aft FROM eo),
em AS (SELECT id, date, text, pattern, position, CASE WHEN pattern = 'und der' THEN 'substantive' WHEN regexp_matches(aft, '^ (the|le|la|der) ') THEN 'adjective'
  WHEN regexp_matches(aft, '^[.,;:]') THEN 'substantive' WHEN regexp_matches(aft, '^ (is|and|que|und)') THEN 'substantive' ELSE 'ambiguous' END AS usage,
  substring(text, greatest(0, position - 100) + 1, position + length(pattern) + 100 - greatest(0, position - 100)) AS context,
  substring(text, greatest(0, position - 300) + 1, position + 300 - greatest(0, position - 300)) AS wide FROM eu)"""


@query("scan_epithets", with_(LETTERS, EPI, body="SELECT id, date, pattern, position::BIGINT AS position, usage, context FROM em"))
def _(spark, sf):
    return epithets(spark, sf).select("id", "date", "pattern", F.col("position").cast("long").alias("position"), "usage", "context")


@query(
    "epithet_inventory",
    with_(
        LETTERS, EPI,
        body="""SELECT pattern, count(*) AS total, count(DISTINCT id) AS documents, count(*) FILTER (usage = 'substantive') AS substantive,
        count(*) FILTER (usage = 'adjective') AS adjective, count(*) FILTER (usage = 'ambiguous') AS ambiguous FROM em GROUP BY 1""",
    ),
)
def _(spark, sf):
    return E.epithet_inventory(epithets(spark, sf), "id")


RES = """
er AS (SELECT *, len(regexp_extract_all(wide, '(?i)the')) AS f, len(regexp_extract_all(wide, '(?i)and')) AS m, len(regexp_extract_all(wide, '(?i)de')) AS c,
  len(regexp_extract_all(wide, ' (le|der) ')) AS ma, len(regexp_extract_all(wide, ' (la|die) ')) AS fe, contains(text, 'nicht') AS named FROM em WHERE usage = 'substantive'),
ek AS (SELECT *, CASE WHEN f > m AND f > c THEN 'family' WHEN m > f AND m > c THEN 'military' WHEN c > f AND c > m THEN 'community' ELSE 'ambiguous' END AS context_type,
  CASE WHEN ma > fe THEN 'male' WHEN fe > ma THEN 'female' ELSE 'unknown' END AS gender FROM er),
ev AS (SELECT *, CASE WHEN pattern = 'und der' THEN 'unresolved' ELSE 'review' END AS confidence, CASE WHEN pattern = 'und der' THEN NULL WHEN named THEN 'military_superior' WHEN gender = 'female' THEN 'other' WHEN context_type = 'military' THEN 'military_superior'
  WHEN context_type = 'family' THEN 'father' WHEN context_type = 'ambiguous' AND date >= DATE '2021-07-01' THEN 'military_superior' ELSE 'other' END AS referent FROM ek)"""


def resolved(spark, sf):
    lt = X.letters(spark, sf).select("id", "date", "text")
    return E.resolve_epithets(epithets(spark, sf), lt, "id", "date", "text", CTX, " (le|der) ", " (la|die) ", "nicht", X.ONSET, split_patterns=("of the", "de la"))


@query("resolve_epithets", with_(LETTERS, EPI, RES, body="SELECT id, pattern, position::BIGINT AS position, context_type, gender, named AS co_occurs, referent, confidence FROM ev"))
def _(spark, sf):
    return resolved(spark, sf).select("id", "pattern", F.col("position").cast("long").alias("position"), "context_type", "gender", "co_occurs", "referent", "confidence")


@query(
    "resolution_summary",
    with_(
        LETTERS, EPI, RES,
        body="""SELECT pattern, count(*) AS mentions, round(avg(named::INTEGER), 3) AS co_occurrence_rate, count(*) FILTER (referent = 'military_superior') AS military_superior,
        count(*) FILTER (referent = 'father') AS father, count(*) FILTER (referent = 'other') AS other FROM ev GROUP BY 1 HAVING count(*) >= 3""",
    ),
)
def _(spark, sf):
    return E.resolution_summary(resolved(spark, sf))


# A stand-in parse: every word hangs on the word at half its position, so tree depths are known.
def tokens(spark, sf):
    s = X.sents(spark, sf).select("id", "idx", F.posexplode(T.words(F.col("sentence"))).alias("i", "token"))
    i = F.col("i")
    dep = F.when(i == 0, "ROOT").when(i % 5 == 1, "advcl").when(i % 7 == 3, "conj").otherwise("dep")
    pos = F.when(i % 4 == 0, "NOUN").when(i % 4 == 1, "VERB").otherwise("DET")
    return s.select(
        F.col("id").alias("doc_id"), F.col("idx").alias("sent_id"), "i", F.floor((i - 1) / 2).cast("int").alias("_h"), "token", dep.alias("dep"), pos.alias("pos"),
        F.when(i % 8 == 1, "Past").when(i % 8 == 5, "Pres").alias("tense"),
    ).withColumn("head_i", F.when(F.col("i") == 0, 0).otherwise(F.col("_h"))).drop("_h")


TOKENS = """
tk AS (SELECT id, idx, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM (SELECT id, idx, regexp_extract_all(sentence, '[\\p{L}\\p{N}_]+') AS w FROM sents)),
tt AS (SELECT *, CASE WHEN i = 0 THEN 'ROOT' WHEN i % 5 = 1 THEN 'advcl' WHEN i % 7 = 3 THEN 'conj' ELSE 'dep' END AS dep, CASE i % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' ELSE 'DET' END AS pos,
  CASE i % 8 WHEN 1 THEN 'Past' WHEN 5 THEN 'Pres' END AS tense, CASE WHEN i > 0 THEN i - (i - 1) // 2 END AS d FROM tk)"""


@query(
    "syntax_metrics",
    with_(
        LETTERS, SENTS, TOKENS,
        body="""SELECT id AS doc_id, round(coalesce(avg(d), 0), 9) AS mean_dependency_distance, coalesce(max(d), 0)::BIGINT AS max_dependency_distance,
        round(count(*) / count(DISTINCT idx), 9) AS mean_sentence_length, round(count(*) FILTER (dep = 'advcl') / count(*) FILTER (dep IN ('advcl', 'ROOT', 'conj')), 9) AS subordinate_clause_ratio,
        floor(log2(max(i) + 1))::BIGINT AS max_tree_depth,
        round(coalesce(count(*) FILTER (tense = 'Past' AND pos = 'VERB') / nullif(count(*) FILTER (tense IS NOT NULL AND pos = 'VERB'), 0), 0), 9) AS past_tense_ratio,
        round(coalesce(count(*) FILTER (tense = 'Pres' AND pos = 'VERB') / nullif(count(*) FILTER (tense IS NOT NULL AND pos = 'VERB'), 0), 0), 9) AS present_tense_ratio,
        round(count(*) FILTER (pos IN ('NOUN', 'VERB')) / count(*), 9) AS lexical_density FROM tt GROUP BY 1""",
    ),
)
def _(spark, sf):
    m = P.syntax_metrics(tokens(spark, sf))
    m = m.withColumns({c: F.col(c).cast("long") for c in ("max_dependency_distance", "max_tree_depth")})
    return rounded(m, "mean_dependency_distance", "mean_sentence_length", "subordinate_clause_ratio", "past_tense_ratio", "present_tense_ratio", "lexical_density")


@query("assemble_profile")
def _(spark, sf):
    lt = X.letters(spark, sf).withColumnRenamed("id", "doc_id")
    vol = S.volatility_asymmetry(X.scored(spark, sf), "id").withColumnRenamed("id", "doc_id")
    return P.assemble_profile(lt, "doc_id", "text", tokens(spark, sf), vol)


@query(
    "triage_candidates",
    with_(
        LETTERS, SENTS, TOKENS,
        "f AS (SELECT id AS doc_id, idx AS position, regexp_extract(sentence, '^[\\p{L}\\p{N}_]+') AS tgt FROM sents)",
        "k AS (SELECT doc_id, position, lower(tgt) AS tgt, tgt AS raw FROM f WHERE length(tgt) >= 3)",
        """m AS (SELECT k.doc_id, k.position, min({'k': CASE WHEN lower(t.token) = tgt THEN 0 ELSE 1 END, 'i': i, 'pos': pos, 'lemma': regexp_replace(lower(token), '^(.{3,}?)(ung|ing|ion|es|ed|en|er|s|e)$', '\\1')}) AS t
             FROM k JOIN tt t ON t.id = k.doc_id AND t.idx = k.position
             WHERE lower(t.token) = tgt OR ((contains(lower(t.token), tgt) OR contains(tgt, lower(t.token))) AND length(t.token) >= length(tgt) - 2) GROUP BY 1, 2)""",
        """s AS (SELECT k.doc_id, k.position, raw AS original, m.t.pos AS pos,
             coalesce(CASE m.t.pos WHEN 'NOUN' THEN 2 WHEN 'VERB' THEN 2 WHEN 'DET' THEN 1 END, 0) + CASE WHEN m.t.lemma IS NOT NULL AND m.t.lemma <> tgt THEN 2 ELSE 0 END
             + CASE WHEN substring(raw, 1, 1) <> lower(substring(raw, 1, 1)) THEN 1 ELSE 0 END AS v,
             CASE WHEN m.t IS NULL THEN 3 ELSE 0 END + CASE WHEN m.t.i % 3 = 0 THEN 1 ELSE 0 END AS d FROM k LEFT JOIN m ON m.doc_id = k.doc_id AND m.position = k.position)""",
        body="""SELECT doc_id, position, original, pos, v::BIGINT AS valid_score, d::BIGINT AS suspicious_score,
        CASE WHEN v >= 3 OR v - d >= 1 THEN 'likely_valid' ELSE 'review_required' END AS classification FROM s""",
    ),
)
def _(spark, sf):
    raw = F.regexp_extract("sentence", T.WORD, 0)
    lead = F.substring("sentence", 1, 1).rlike(T.WORD)
    f = X.sents(spark, sf).filter(lead).select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("position"), raw.alias("original"))
    f = f.filter(F.length("original") >= 3).withColumn("capital", F.substring("original", 1, 1) != F.lower(F.substring("original", 1, 1)))
    # A word without its ending stands for the lemma.
    lemma = F.regexp_replace(F.lower("token"), "^(.{3,}?)(ung|ing|ion|es|ed|en|er|s|e)$", "$1")
    t = tokens(spark, sf).select(
        "doc_id", F.col("sent_id").cast("long").alias("position"), "i", "token", "pos", lemma.alias("lemma"),
        F.lit("").alias("ent"), (F.col("i") % 3 == 0).alias("is_oov"),
    )
    out = P.triage_candidates(f, t)
    return out.withColumns({c: F.col(c).cast("long") for c in ("valid_score", "suspicious_score")})


@query(
    "changed_rows",
    "SELECT doc_id, lang, md5(text) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    now = Q.fingerprint(d, "doc_id", ["lang", "text"], "v1")
    # The stored state: good documents as they are, all others with an older version.
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    old = now.join(good, "doc_id", "left_semi").unionByName(Q.fingerprint(d, "doc_id", ["lang", "text"], "v0").join(good, "doc_id", "left_anti"))
    return Q.changed_rows(now, old, "doc_id").select("doc_id", "lang", F.md5("text").alias("h"))


@query(
    "merge_results",
    """WITH old AS (SELECT o_orderkey AS k, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0), fresh AS (SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderstatus = 'F')
    SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM fresh) AND k IN (SELECT l_orderkey FROM lineitem)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    fresh = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return Q.merge_results(old, fresh, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query(
    "validate_schema",
    """WITH l AS (SELECT d.doc_id, q.quality::VARCHAR AS quality, d.source, d.lang FROM documents d LEFT JOIN labels q USING (doc_id))
    SELECT doc_id, 'quality' AS field, 'missing' AS problem FROM l WHERE quality IS NULL
    UNION ALL SELECT doc_id, 'source', 'type' FROM l WHERE TRY_CAST(source AS INTEGER) IS NULL
    UNION ALL SELECT doc_id, 'source', 'prefix' FROM l WHERE NOT starts_with(source, 'src1')
    UNION ALL SELECT doc_id, 'lang', 'enum' FROM l WHERE lang NOT IN ('en', 'de')""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    spec = [
        {"field": "quality", "required": True, "cast": "int"}, {"field": "source", "cast": "int", "prefix": "src1"},
        {"field": "lang", "enum": ["en", "de"]},
    ]
    return Q.validate_schema(d, "doc_id", spec)


@query("require", "SELECT count(*) AS n FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return Q.require(d, 100, ("doc_id", 100)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "error_scan",
    with_(
        LETTERS,
        "l AS (SELECT id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM letters)",
        body="SELECT id, line_no, bad, (strpos(line, bad) - 1)::BIGINT AS \"offset\" FROM l, (VALUES ('tion the'), ('éé')) b(bad) WHERE contains(line, bad)",
    ),
)
def _(spark, sf):
    out = Q.error_scan(X.letters(spark, sf), "id", "text", ("tion the", "éé"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("line_no", "offset")})
