"""Text cleaning, sentences, lexicon metrics and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.functions import geo as G
from missiva.functions import text as T
from missiva.operators import lexical, rewriting, scores, sentences
from missiva.operators.quality import scan_characters
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import LETTERS, SENTS, SCORED, WS, rounded, with_

def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


STRIP_HTML_SQL = (
    "replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),"
    "'&nbsp;',' '),'&amp;','&'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),"
    "chr(13)||chr(10),chr(10)),chr(13),chr(10))"
)


@query("strip_html", f"SELECT page_id, {STRIP_HTML_SQL} AS plain FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query(
    "strip_html_breaks",
    "SELECT page_id, "
    + STRIP_HTML_SQL.replace(
        "regexp_replace(html,",
        "regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), "
        "'(?i)</p>\\s*<p[^>]*>', chr(10)||chr(10), 'g'),",
    )
    + " AS plain FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html"), breaks=True).alias("plain"))


def clean_sql(x: str) -> str:
    c = f"replace({strip_sql(x)}, chr(13)||chr(10), chr(10))"
    c = f"regexp_replace({c}, '\\n *\\n', chr(10)||chr(10), 'g')"
    c = f"regexp_replace({c}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    for a, b in (
        ("chr(10)||chr(10)", "'<PARA>'"), ("'- - - -'", "'[ulæseligt]'"), ("'----'", "'[ulæseligt]'"),
        ("'- - -'", "'[ulæseligt]'"), ("'- -'", "'-'"), ("'--'", "'-'"), ("chr(10)", "' '"),
        ("chr(160)", "' '"), ("'&lt;'", "' '"), ("chr(173)", "''"), ("chr(149)", "''"),
    ):
        c = f"replace({c}, {a}, {b})"
    return collapse_sql(c)


CLEAN = f"cleaned AS (SELECT id, {clean_sql('text')} AS text FROM letters)"


def cleaned(spark, sf):
    return X.letters(spark, sf).select("id", T.clean_transcript(F.col("text")).alias("text"))


@query("clean_transcript", with_(LETTERS, CLEAN, body="SELECT id, text FROM cleaned"))
def _(spark, sf):
    return cleaned(spark, sf)


PARAS = f"list_filter(list_transform(string_split(text, '<PARA>'), lambda p: {strip_sql('p')}), lambda p: length(p) > 0)"


@query(
    "paragraph_forms",
    with_(
        LETTERS, CLEAN,
        body=f"""SELECT id, array_to_string(list_transform({PARAS}, lambda p: '<p>' || p || '</p>'), chr(10)) AS html,
        {collapse_sql("replace(text, '<PARA>', ' ')")} AS plain,
        array_to_string({PARAS}, chr(10)||chr(10)) AS lines FROM cleaned""",
    ),
)
def _(spark, sf):
    c = F.col("text")
    return cleaned(spark, sf).select(
        "id", T.para_to_html(c).alias("html"), T.para_to_plain(c).alias("plain"), T.para_to_newlines(c).alias("lines")
    )


@query(
    "cleanup_counts",
    with_(
        LETTERS,
        body="""SELECT id, regexp_replace(replace(text, chr(173), ''), ' {2,}', ' ', 'g') AS cleaned,
        (length(text) - length(replace(text, chr(173), ''))
         + len(regexp_extract_all(replace(text, chr(173), ''), ' {2,}')))::BIGINT AS hits FROM letters""",
    ),
)
def _(spark, sf):
    c = F.col("text")
    return X.letters(spark, sf).select("id", T.cleanup(c).alias("cleaned"), T.cleanup_hits(c).cast("long").alias("hits"))


RULES = (
    rewriting.Rule("function_words", "word", "the", "ye"),
    rewriting.Rule("function_words", "word", "and", "und"),
    rewriting.Rule("function_words", "word", "des", "de"),
    rewriting.Rule("endings", "regex", r"tion", "sion"),
    rewriting.Rule("endings", "regex", r"eaux", "eaus"),
    rewriting.Rule("second_pass", "word", "de", "den"),
)
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
WORD_PASS = "array_to_string(list_transform({toks}, lambda t: CASE t {cases} ELSE t END), '')"


def _word_pass(x, pairs):
    return WORD_PASS.format(toks=TOKENS.format(x), cases=" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs))


@query(
    "apply_rewrite_rules",
    with_(
        LETTERS,
        f"r1 AS (SELECT id, text AS t0, {_word_pass('text', [('the', 'ye'), ('and', 'und'), ('des', 'de')])} AS t1 FROM letters)",
        "r2 AS (SELECT *, replace(t1, 'tion', 'sion') AS t2 FROM r1)",
        "r3 AS (SELECT *, replace(t2, 'eaux', 'eaus') AS t3 FROM r2)",
        f"r4 AS (SELECT *, {_word_pass('t3', [('de', 'den')])} AS t4 FROM r3)",
        f"""counted AS (SELECT id, t4 AS rewritten,
          len(list_filter({TOKENS.format('t0')}, lambda t: t IN ('the', 'and', 'des')))::BIGINT AS function_words,
          (len(regexp_extract_all(t1, 'tion')) + len(regexp_extract_all(t2, 'eaux')))::BIGINT AS endings,
          len(list_filter({TOKENS.format('t3')}, lambda t: t = 'de'))::BIGINT AS second_pass FROM r4)""",
        body="SELECT *, function_words + endings + second_pass AS changes FROM counted",
    ),
)
def _(spark, sf):
    out = rewriting.apply_rewrite_rules(X.letters(spark, sf).select("id", "text"), "text", RULES)
    cats = ("function_words", "endings", "second_pass")
    return out.select(
        "id", F.col("text_normalized").alias("rewritten"), F.col("changes").cast("long").alias("changes"),
        *[F.col("rule_hits")[c].cast("long").alias(c) for c in cats],
    )


@query(
    "rule_hits",
    with_(
        LETTERS,
        f"t AS (SELECT unnest({TOKENS.format('text')}) AS w FROM letters)",
        body="""SELECT 'function_words' AS category, count(*) AS hits FROM t WHERE w IN ('the', 'and', 'des')
        UNION ALL SELECT 'dead_rule', 0""",
    ),
)
def _(spark, sf):
    rules = (*RULES[:3], rewriting.Rule("dead_rule", "word", "qqqq", "q"))
    out = rewriting.apply_rewrite_rules(X.letters(spark, sf).select("id", "text"), "text", rules)
    return rewriting.rule_hits(out).select("category", F.col("hits").cast("long").alias("hits"))


DIGRAPH_SQL = (
    "array_to_string(list_transform(regexp_extract_all(text, '&[a-zA-Z]+;|[a-zA-ZæøåÆØÅéÉ]+|[^a-zA-ZæøåÆØÅéÉ&]+|&'),"
    " lambda t: CASE WHEN t LIKE '&%' OR lower(t) IN ('een', 'thee') THEN t ELSE"
    " replace(replace(replace(replace(t, 'EE', 'ÊÊ'), 'Ee', 'Ê'), 'ee', 'ê'), 'eE', 'ê') END), '')"
)


@query("digraph_rewrite", with_(LETTERS, body=f"SELECT id, {DIGRAPH_SQL} AS rewritten FROM letters"))
def _(spark, sf):
    c = T.digraph_rewrite(F.col("text"), preserve=("een", "thee"), pair="ee", letter="ê")
    return X.letters(spark, sf).select("id", c.alias("rewritten"))


@query(
    "normalize_corpus",
    with_(
        LETTERS,
        "src AS (SELECT l.id, coalesce(nullif(p.html, ''), l.text) AS original FROM letters l LEFT JOIN pages p ON p.page_id = l.id)",
        f"n AS (SELECT id, original, {_word_pass('original', [('the', 'ye'), ('and', 'und'), ('des', 'de')])} AS normalized,"
        f" len(list_filter({TOKENS.format('original')}, lambda t: t IN ('the', 'and', 'des')))::BIGINT AS changes FROM src)",
        body="SELECT id, md5(original) AS original_md5, md5(normalized) AS normalized_md5, changes FROM n",
    ),
)
def _(spark, sf):
    corrected = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text_corrected"))
    out = rewriting.normalize_corpus(
        X.letters(spark, sf).select("id", "text"), corrected, RULES[:3], cleanup=False, digraph=False
    )
    return out.select(
        "id", F.md5("text_original").alias("original_md5"), F.md5("text_normalized").alias("normalized_md5"),
        F.col("changes").cast("long").alias("changes"),
    )


@query(
    "parse_location",
    with_(
        LETTERS,
        body="SELECT id, split_part(location, ',', 1)::DOUBLE AS lat, split_part(location, ',', 2)::DOUBLE AS lng FROM letters",
    ),
)
def _(spark, sf):
    p = G.parse_location(F.col("location"))
    return X.letters(spark, sf).select("id", p["lat"].alias("lat"), p["lng"].alias("lng"))


NATION_GEO = "SELECT n_nationkey AS id, ((n_nationkey * 37) % 120 - 60)::DOUBLE AS lat, ((n_nationkey * 53) % 300 - 150)::DOUBLE AS lng FROM nation"


def nation_points(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("id"), "n_name", ((k * 37) % 120 - 60).cast("double").alias("lat"),
        ((k * 53) % 300 - 150).cast("double").alias("lng"),
    )


@query(
    "wkt_point",
    f"""WITH p AS ({NATION_GEO}), w AS (SELECT id, 'POINT (' || lng || ' ' || lat || ')' AS wkt FROM p)
    SELECT id, wkt, regexp_extract(wkt, ' (-?[0-9.]+)\\)', 1)::DOUBLE AS lat,
           regexp_extract(wkt, '\\((-?[0-9.]+) ', 1)::DOUBLE AS lng FROM w""",
)
def _(spark, sf):
    p = nation_points(spark, sf).select("id", G.wkt_point(F.col("lat"), F.col("lng")).alias("wkt"))
    s = G.parse_wkt_point(F.col("wkt"))
    return p.select("id", "wkt", s["lat"].alias("lat"), s["lng"].alias("lng"))


@query(
    "map_links",
    f"""WITH p AS ({NATION_GEO}) SELECT id,
    'https://www.openstreetmap.org/?mlat=' || lat || '&mlon=' || lng || '&zoom=12' AS osm,
    'https://www.google.com/maps/?q=' || lat || ',' || lng AS google FROM p""",
)
def _(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    return nation_points(spark, sf).select(
        "id", G.map_link(lat, lng).alias("osm"), G.map_link(lat, lng, G.GOOGLE_LINK).alias("google")
    )


@query(
    "haversine_km",
    f"""WITH p AS ({NATION_GEO}), q AS (SELECT c_custkey AS cust, id, lat, lng, c_custkey % 90 AS clat, c_custkey % 180 AS clng
      FROM customer JOIN p ON id = c_nationkey),
    a AS (SELECT *, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clng - lng) / 2), 2) AS h FROM q)
    SELECT cust, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM a""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("id"),
        (F.col("c_custkey") % 90).alias("clat"), (F.col("c_custkey") % 180).alias("clng"),
    )
    km = G.haversine_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))
    return c.join(F.broadcast(nation_points(spark, sf)), "id").select("cust", F.round(km, 6).alias("km"))


def blank_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


@query(
    "length_stats",
    with_(LETTERS, body=f"SELECT id, length(text)::BIGINT AS chars, len({blank_sql('text')})::BIGINT AS words FROM letters"),
)
def _(spark, sf):
    c = F.col("text")
    return X.letters(spark, sf).select(
        "id", F.length(c).cast("long").alias("chars"), T.word_count(c).cast("long").alias("words")
    )


FIRST_LINE = (
    "coalesce(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda p: "
    + strip_sql("p") + "), lambda p: length(p) > 0)[1], '')"
)


@query(
    "snippet",
    with_(
        LETTERS, f"f AS (SELECT *, {FIRST_LINE} AS fl FROM letters)",
        body=f"""SELECT id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS cut,
        CASE WHEN length(fl) <= 200 THEN fl
             WHEN contains(substring(fl, 1, 200), ' ') THEN regexp_extract(substring(fl, 1, 200), '^(.*) ', 1) || '...'
             ELSE substring(fl, 1, 200) || '...' END AS excerpt,
        substring({strip_sql("regexp_replace(text, '<[^>]+>', '', 'g')")}, 1, 100) AS plain FROM f""",
    ),
)
def _(spark, sf):
    c = F.col("text")
    return X.letters(spark, sf).select(
        "id", T.snippet(c).alias("cut"), T.excerpt(c).alias("excerpt"), T.plain_cut(c).alias("plain")
    )


NAMES = "names AS (SELECT p_partkey AS id, 'Ä' || p_name || '  (' || p_type || ', ß' || p_brand || ')' AS name FROM part)"
FOLD = f"replace(translate({collapse_sql('lower(name)')}, 'àáâãäèéêëìíîïòóôõöùúûüýÿñżźśćłęń', 'aaaaaeeeeiiiiooooouuuuyynzzsclen'), 'ß', 'ss')"
SLUG = (
    "regexp_replace(regexp_replace(translate(replace(replace(replace(lower(trim(name)), 'æ', 'ae'), 'å', 'aa'), 'ß', 'ss'),"
    " 'øöäüàáâãèéêëìíîïòóôõùúûýÿñżźśćęńčšžğř', 'ooauaaaaeeeeiiiioooouuuyynzzscencszgr'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
)


BASE_RX = "regexp_replace(folded, '(?s)\\s*\\(.*', '')"


@query(
    "fold_names",
    with_(
        NAMES, f"f AS (SELECT id, name, {FOLD} AS folded FROM names)",
        f"b AS (SELECT *, {strip_sql(BASE_RX)} AS base FROM f)",
        body=f"""SELECT id, folded, base, {SLUG} AS slug,
        array_to_string(list_filter(list_prepend(base, list_transform(string_split(regexp_extract(folded, '\\(([^)]+)\\)', 1), ','), lambda p: {strip_sql('p')})), lambda p: length(p) > 2), '|') AS components FROM b""",
    ),
)
def _(spark, sf):
    p = table(spark, sf, "part")
    named = p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Ä"), "p_name", F.lit("  ("), "p_type", F.lit(", ß"), "p_brand", F.lit(")")).alias("name"),
    ).withColumn("folded", T.fold_name(F.col("name")))
    return named.select(
        "id", "folded", T.base_name(F.col("folded")).alias("base"), T.slugify(F.col("name")).alias("slug"),
        F.array_join(T.name_components(F.col("folded")), "|").alias("components"),
    )


@query(
    "period_keys",
    with_(
        LETTERS,
        body="""SELECT id, strftime(date, '%Y') AS year, strftime(date, '%Y-%m') AS month,
        strftime(date, '%Y') || '-Q' || quarter(date) AS quarter,
        CASE WHEN date >= DATE '2021-07-01' THEN 'post' ELSE 'pre' END AS side FROM letters""",
    ),
)
def _(spark, sf):
    d = F.col("date")
    return X.letters(spark, sf).select(
        "id", D.year_key(d).alias("year"), D.month_key(d).alias("month"), D.quarter_key(d).alias("quarter"),
        D.period_split(d, X.ONSET).alias("side"),
    )


@query(
    "classify_by_keywords",
    with_(
        LETTERS,
        body="""SELECT id, CASE WHEN contains(lower(recipient), 'en') THEN 'english'
        WHEN contains(lower(recipient), 'fr') OR contains(lower(recipient), 'es') THEN 'romance' ELSE 'other' END AS audience
        FROM letters""",
    ),
)
def _(spark, sf):
    return X.letters(spark, sf).select("id", T.classify_by_keywords(F.col("recipient"), X.AUDIENCES).alias("audience"))


@query(
    "score_category",
    """SELECT event_id, CASE WHEN (value - 10) / 10 > 0.1 THEN 'positive' WHEN (value - 10) / 10 < -0.05 THEN 'negative'
    ELSE 'neutral' END AS category FROM events""",
)
def _(spark, sf):
    s = (F.col("value") - 10) / 10
    return table(spark, sf, "events").select("event_id", D.score_category(s).alias("category"))


@query(
    "minmax_scale",
    """WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem),
    s AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - q0) / (q1 - q0) AS q, (l_discount - d0) / (d1 - d0) AS d FROM lineitem, b)
    SELECT l_orderkey, l_linenumber, l_partkey, round(q, 9) AS l_quantity_scaled, round(d, 9) AS l_discount_scaled,
           round((q + d) / 2, 9) AS scaled_mean FROM s""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    out = scores.minmax_scale(li, ["l_quantity", "l_discount"]).drop("l_quantity", "l_discount")
    return rounded(out, "l_quantity_scaled", "l_discount_scaled", "scaled_mean")


@query(
    "axis_normalize",
    f"""WITH p AS ({NATION_GEO}), b AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lng) AS g0, max(lng) AS g1 FROM p)
    SELECT id, round((lat - a0) / (a1 - a0), 4) AS lat, round((lng - g0) / (g1 - g0), 4) AS lng FROM p, b""",
)
def _(spark, sf):
    return scores.axis_normalize(nation_points(spark, sf).drop("n_name"), ["lat", "lng"])


@query(
    "compose_document",
    with_(
        LETTERS,
        body="""SELECT id, 'passage: ' || substring(concat_ws('. ', 'Fra: ' || nullif(sender, ''), 'Til: ' || nullif(recipient, ''),
        'Dato: ' || date, 'Sted: ' || place, nullif(text, '')), 1, 2000) AS document FROM letters""",
    ),
)
def _(spark, sf):
    # Field labels of the embedding input.
    fields = (("Fra", "sender"), ("Til", "recipient"), ("Dato", "date"), ("Sted", "place"))
    doc = T.compose_document([(n, F.col(c).cast("string")) for n, c in fields], F.col("text"))
    return X.letters(spark, sf).select("id", doc.alias("document"))


@query(
    "lexicon_variants",
    f"""WITH {LETTERS.strip()}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM letters)
    SELECT token FROM w UNION
    SELECT replace(replace(replace(replace(token, 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss') FROM w""",
)
def _(spark, sf):
    words = sentences.tokens(X.letters(spark, sf), ["id"], "text").select("token").distinct()
    return lexical.lexicon_variants(words)


@query(
    "close_intervals",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) END AS end_date,
    strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority AS label FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 3).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), start.alias("start_date"), D.close_interval(start, end).alias("end_date"),
        F.concat(start.cast("string"), F.lit(" "), "o_orderpriority").alias("label"),
    )


@query("split_sentences", with_(LETTERS, SENTS, body="SELECT id, idx, sentence FROM sents"))
def _(spark, sf):
    return sentences.split_sentences(X.letters(spark, sf), "id", "text").withColumn("idx", F.col("idx").cast("long"))


@query("is_formulaic", with_(LETTERS, SENTS, body="SELECT id, idx, is_formulaic FROM sents"))
def _(spark, sf):
    return X.sents(spark, sf).select("id", F.col("idx").cast("long").alias("idx"), "is_formulaic")


@query(
    "split_sentences_simple",
    with_(
        LETTERS,
        f"""l AS (SELECT id, list_filter(list_transform(string_split_regex(
          regexp_replace({collapse_sql('text')}, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: trim(x)),
          lambda x: length(x) BETWEEN 25 AND 220) AS l FROM letters)""",
        body="SELECT id, i - 1 AS idx, l[i] AS sentence FROM (SELECT id, l, unnest(generate_series(1, len(l))) AS i FROM l)",
    ),
)
def _(spark, sf):
    out = sentences.split_sentences_simple(X.letters(spark, sf), "id", "text")
    return out.withColumn("idx", F.col("idx").cast("long"))


@query(
    "prepare_for_sentences",
    with_(
        LETTERS, CLEAN,
        body="""SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '([\\p{L}\\p{N}_])<PARA>', '\\1. ', 'g'), '<PARA>(\\s*<PARA>)*', ' ', 'g'),
        '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '%s+', ' ', 'g')), '^[^\\p{L}\\p{N}_]+', ''), ' +', ' ', 'g')) AS prepared
        FROM cleaned""" % WS,
    ),
)
def _(spark, sf):
    return cleaned(spark, sf).select("id", T.prepare_for_sentences(F.col("text")).alias("prepared"))


@query(
    "scan_characters",
    with_(
        LETTERS,
        "chars AS (SELECT id, text, generate_subscripts(string_split(text, ''), 1) AS p, unnest(string_split(text, '')) AS c FROM letters)",
        body="""SELECT id, p - 1 AS position, c AS original, CASE c WHEN 'é' THEN 'review' WHEN 'ß' THEN 'remove' ELSE 'remove_eol' END AS action,
        replace(substring(text, greatest(0, p - 1 - 40) + 1, p - 1 + 40 - greatest(0, p - 1 - 40)), chr(10), ' ') AS context FROM chars
        WHERE c IN ('é', 'ß') OR (c = '.' AND substring(text, p + 1, 1) IN ('', chr(10)))""",
    ),
)
def _(spark, sf):
    chars = (("é", "review"), ("ß", "remove"), (".", "remove_eol"))
    out = scan_characters(X.letters(spark, sf), "id", "text", chars)
    return out.select("id", F.col("position").cast("long").alias("position"), "original", "action", "context")


@query(
    "lexicon_sentiment",
    with_(LETTERS, SENTS, SCORED, body="SELECT id, idx, round(score, 9) AS score FROM scored"),
)
def _(spark, sf):
    s = X.scored(spark, sf).select("id", F.col("idx").cast("long").alias("idx"), "score")
    return rounded(s, "score")


@query(
    "lexicon_sentiment_by_document",
    with_(
        LETTERS, SENTS, SCORED,
        body="SELECT id, round(avg(score), 9) AS mean_score, round(sum(score), 9) AS total_score FROM scored GROUP BY id",
    ),
)
def _(spark, sf):
    return rounded(lexical.document_mean_of_sentences(X.scored(spark, sf), "id"), "mean_score", "total_score")


MARKERS = {"plural": ("les", "des", "the"), "singular": ("le", "un", "of"), "hedge": ("and", "und", "que")}


@query(
    "marker_rates",
    with_(
        LETTERS,
        f"w AS (SELECT id, text, {blank_sql('lower(text)')} AS t FROM letters)",
        """c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x IN ('les', 'des', 'the'))) AS p, len(list_filter(t, lambda x: x IN ('le', 'un', 'of'))) AS s,
        len(list_filter(t, lambda x: x IN ('and', 'und', 'que'))) AS h, len(regexp_extract_all(text, '(?i)of the')) + len(regexp_extract_all(text, '(?i)de la')) AS ph FROM w)""",
        body="""SELECT id, n::BIGINT AS tokens, round(CASE WHEN n > 0 THEN p * 100.0 / n ELSE 0 END, 9) AS plural_rate,
        round(CASE WHEN n > 0 THEN s * 100.0 / n ELSE 0 END, 9) AS singular_rate, round(CASE WHEN n > 0 THEN h * 100.0 / n ELSE 0 END, 9) AS hedge_rate,
        round(CASE WHEN s + p > 0 THEN s::DOUBLE / (s + p) ELSE 0 END, 9) AS singular_share, ph::BIGINT AS phrase_count FROM c""",
    ),
)
def _(spark, sf):
    out = lexical.marker_rates(
        X.letters(spark, sf), "id", "text", MARKERS, ("(?iu)of the", "(?iu)de la"), ("singular", "plural")
    )
    out = rounded(out, "plural_rate", "singular_rate", "hedge_rate", "singular_share")
    return out.withColumns({c: F.col(c).cast("long") for c in ("tokens", "phrase_count")})


@query(
    "term_density",
    with_(
        LETTERS,
        f"w AS (SELECT id, {blank_sql('lower(text)')} AS t FROM letters)",
        "c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x IN ('der','die','und','nicht','sch','auch','für','fur','über','uber'))) AS k FROM w)",
        body="SELECT id, k::BIGINT AS term_count, round(CASE WHEN n > 0 THEN k * 100.0 / n ELSE 0 END, 9) AS density FROM c",
    ),
)
def _(spark, sf):
    lex = lexical.lexicon_table(spark, {w: 1.0 for w in X.GERMAN})
    return rounded(lexical.term_density(X.letters(spark, sf), "id", "text", lex), "density")


@query(
    "char_entropy",
    with_(
        LETTERS,
        "c AS (SELECT id, length(text) AS n, unnest(string_split(lower(text), '')) AS ch FROM letters)",
        "k AS (SELECT id, n, ch, count(*)::DOUBLE AS k FROM c WHERE ch <> '' GROUP BY ALL)",
        body="SELECT l.id, round(coalesce(sum(-(k / n) * log2(k / n)), 0), 9) AS entropy FROM letters l LEFT JOIN k ON k.id = l.id GROUP BY l.id",
    ),
)
def _(spark, sf):
    return rounded(X.letters(spark, sf).select("id", lexical.char_entropy("text").alias("entropy")), "entropy")


@query("compression_ratio")
def _(spark, sf):
    return rounded(
        X.letters(spark, sf).select("id", lexical.compression_ratio("text").alias("compression_ratio")), "compression_ratio"
    )


RICH_WORDS = "regexp_extract_all(lower(regexp_replace(regexp_replace(text, '\\p{Nd}', '', 'g'), '[\\p{P}\\p{S}]', ' ', 'g')), '[\\p{L}\\p{N}_]+')"


@query(
    "lexical_richness",
    with_(
        LETTERS,
        f"w AS (SELECT id, {RICH_WORDS} AS w FROM letters)",
        "f AS (SELECT id, tok, count(*) AS k FROM (SELECT id, unnest(w) AS tok FROM w) GROUP BY ALL)",
        "g AS (SELECT id, count(*) AS types, sum(k)::BIGINT AS n, count(*) FILTER (k = 1) AS hapax FROM f GROUP BY id)",
        """m AS (SELECT id, CASE WHEN len(w) >= 50 THEN list_avg(list_transform(generate_series(1, len(w) - 49),
            lambda i: len(list_distinct(w[i:i + 49])) / 50.0)) END AS mattr FROM w)""",
        body="""SELECT w.id, len(w.w)::BIGINT AS word_count, coalesce(types, 0)::BIGINT AS type_count, round(types / n, 9) AS ttr,
        round(coalesce(mattr, types / n), 7) AS mattr, round(coalesce(hapax / n, 0), 9) AS hapax_ratio
        FROM w LEFT JOIN g ON g.id = w.id LEFT JOIN m ON m.id = w.id""",
    ),
)
def _(spark, sf):
    r = lexical.lexical_richness(X.letters(spark, sf), "id", "text")
    r = r.select("id", F.col("word_count").cast("long"), F.col("type_count").cast("long"), "ttr", "mattr", "hapax_ratio")
    return rounded(rounded(r, "ttr", "hapax_ratio"), "mattr", dp=7)


@query("lexical_richness_folds")
def _(spark, sf):
    r = lexical.lexical_richness(X.letters(spark, sf), "id", "text").select("id", "mtld", "hdd")
    return rounded(r, "mtld", "hdd")


@query(
    "tfidf",
    with_(
        LETTERS,
        "tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM letters) GROUP BY ALL)",
        "idf AS (SELECT token, ln((1 + (SELECT count(*) FROM letters)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token)",
        "r AS (SELECT id, token, tf * idf AS w FROM tf JOIN idf USING (token))",
        body="SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS weight FROM r",
    ),
)
def _(spark, sf):
    return rounded(lexical.tfidf(X.letters(spark, sf), "id", "text"), "weight")


@query(
    "hapax_near_common",
    with_(
        LETTERS,
        "p AS (SELECT id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS p FROM letters)",
        "t AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM p)",
        "v AS (SELECT * FROM t WHERE regexp_full_match(w, '[a-zß-öø-ÿœ]{3,}'))",
        # The SQL engine measures edit distance in bytes: every letter becomes one ASCII sign.
        "f AS (SELECT w, translate(w, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345') AS x, count(*) AS n, min(id) AS id, min(i) AS i FROM v GROUP BY w)",
        """c AS (SELECT a.w, a.id, a.i, min({'d': levenshtein(a.x, b.x), 'c': b.w, 'n': b.n}) AS m
             FROM f a JOIN f b ON a.n = 1 AND b.n >= 5 AND abs(length(a.w) - length(b.w)) <= 2
             WHERE a.w NOT IN ('der', 'die', 'und', 'nicht') AND levenshtein(a.x, b.x) <= 2 GROUP BY ALL)""",
        """x AS (SELECT c.id, c.w, c.m, p.text, length(coalesce(array_to_string(p.p[1:c.i - 1], ''), '')) AS pos FROM c JOIN p ON p.id = c.id)""",
        f"""y AS (SELECT *, substring(text, greatest(0, pos - 40) + 1, pos + 40 - greatest(0, pos - 40)) AS ctx,
             regexp_replace(substring(text, 1, pos), '{WS}+$', '') AS before, substring(text, pos + 1, 1) AS ch FROM x)""",
        body="""SELECT id, pos::BIGINT AS position, w AS original, m.c AS suggested, m.d::BIGINT AS distance, m.n AS suggested_count FROM y
        WHERE NOT (ch <> lower(ch) AND NOT (before = '' OR regexp_matches(before, '[.!?]$')))
        AND len(list_filter(list_distinct(regexp_extract_all(lower(ctx), '[\\p{L}\\p{N}_]+')), lambda z: z IN ('der', 'die', 'und', 'nicht'))) <= 1""",
    ),
)
def _(spark, sf):
    out = lexical.hapax_near_common(
        X.letters(spark, sf), "id", "text", stop=("der", "die", "und", "nicht"), letters="a-zß-öø-ÿœ"
    )
    return out.withColumns({c: F.col(c).cast("long") for c in ("position", "distance")})
