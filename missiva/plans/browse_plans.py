"""Browse queries, facets and score summaries over the document collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.functions import text as T
from missiva.operators import browse as B
from missiva.operators import joins as J
from missiva.operators import reports as R
from missiva.operators import scores as S
from missiva.operators import sentences as SN
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import BASE, DATED, DOC_SCORES, LETTERS, SCORED, SENTS, rounded, with_

META = ("id", "date", "sender", "recipient", "place")


def meta(spark, sf):
    return X.letters(spark, sf).select(*META)


@query("summary_view", with_(LETTERS, body="SELECT id, date, sender, recipient, place, location FROM letters"))
def _(spark, sf):
    return B.summary_view(X.letters(spark, sf))


@query(
    "browse",
    with_(
        LETTERS,
        body="""SELECT id, date, sender, recipient, place, t.total, t.total > 40 AS has_more
        FROM letters, (SELECT count(*) AS total FROM letters WHERE date BETWEEN DATE '2020-06-01' AND DATE '2023-03-31'
          AND contains(lower(sender), 'src') AND contains(lower(place), 'place 1')) t
        WHERE date BETWEEN DATE '2020-06-01' AND DATE '2023-03-31' AND contains(lower(sender), 'src') AND contains(lower(place), 'place 1')
        ORDER BY id LIMIT 20 OFFSET 20""",
    ),
)
def _(spark, sf):
    return B.browse(meta(spark, sf), "2020-06-01", "2023-03-31", {"sender": "SRC", "place": "Place 1"}, offset=20, limit=20)


@query("facets", with_(LETTERS, body="SELECT coalesce(nullif(sender, ''), 'unknown') AS value, count(*) AS count FROM letters GROUP BY 1"))
def _(spark, sf):
    return B.facets(X.letters(spark, sf), "sender")


@query(
    "multi_field_search",
    with_(
        LETTERS,
        body="""SELECT id, date, sender, recipient, place FROM letters WHERE recipient = 'en'
        AND (contains(lower(sender), '3') OR contains(lower(place), '3') OR contains(date::VARCHAR, '3')) ORDER BY id LIMIT 25 OFFSET 25""",
    ),
)
def _(spark, sf):
    return B.multi_field_search(meta(spark, sf), "3", ("sender", "place", "date"), {"recipient": "en"}, offset=25)


@query(
    "score_list",
    with_(
        *BASE,
        body="""SELECT id, date, round(mean, 9) AS mean, 1 AS page FROM dated WHERE year(date) = 2021 AND mean < -0.05
        ORDER BY dated.mean, id LIMIT 25""",
    ),
)
def _(spark, sf):
    out = B.score_list(
        meta(spark, sf), X.doc_scores(spark, sf).select("id", "mean"), "mean", 2021, "negative", descending=False, page=1
    )
    return rounded(out.select("id", "date", "mean", "page"), "mean")


@query(
    "get_document",
    with_(
        *BASE,
        body="""SELECT l.id, l.date, l.sender, md5(l.text) AS text_md5, round(d.mean, 9) AS mean, len(regexp_extract_all(l.text, '[\\p{L}\\p{N}_]+'))::BIGINT AS words
        FROM letters l LEFT JOIN doc_scores d ON d.id = l.id WHERE l.id = 7""",
    ),
)
def _(spark, sf):
    lt = X.letters(spark, sf)
    words = lt.select("id", F.size(T.words(F.col("text"))).cast("long").alias("words"))
    out = B.get_document(lt, 7, [X.doc_scores(spark, sf).select("id", "mean"), words])
    out = out.select("id", "date", "sender", F.md5("text").alias("text_md5"), "analysis.mean", "analysis.words")
    return rounded(out, "mean")


@query(
    "get_place",
    with_(LETTERS, body="SELECT 'Place 7' AS place, 7 AS place_id, id AS doc_id, date FROM letters WHERE place = 'Place 7'"),
)
def _(spark, sf):
    lt = X.letters(spark, sf)
    places = lt.select("place").distinct().withColumn("place_id", F.regexp_extract("place", r"(\d+)", 1).cast("int"))
    return B.get_place(places, lt, "place 7")


@query(
    "restrict",
    with_(
        LETTERS, SENTS,
        body="SELECT s.id, count(*) AS n FROM sents s WHERE s.id IN (SELECT id FROM letters WHERE sender = 'src1' AND date > DATE '2021-01-01') GROUP BY s.id",
    ),
)
def _(spark, sf):
    keep = (F.col("sender") == "src1") & (F.col("date") > "2021-01-01")
    _, rows = B.restrict(X.letters(spark, sf), X.sents(spark, sf), keep, "id", "id")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "qualify",
    """WITH c AS (SELECT c.c_custkey, count(o.o_orderkey) AS n, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 'note' END) AS note
      FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1) SELECT * FROM c WHERE n >= 12 OR note IS NOT NULL""",
)
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "note").alias("note"))
    return B.qualify(c.join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "n", 12, "note")


@query("category_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def _(spark, sf):
    return B.category_filter(table(spark, sf, "events").select("event_id", "event_type"), "error", "event_type")


@query("sentences_of", with_(LETTERS, SENTS, body="SELECT idx, sentence FROM sents WHERE id = 11"))
def _(spark, sf):
    return B.sentences_of(X.sents(spark, sf), 11).select(F.col("idx").cast("long").alias("idx"), "sentence")


@query(
    "text_filter_total",
    """SELECT count(*) AS matches, coalesce(sum(n), 0)::BIGINT AS total FROM
    (SELECT p_name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) WHERE contains(lower(p_name), 'red')""",
)
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    named = table(spark, sf, "part").join(n, "p_partkey").groupBy("p_name").agg(F.sum("n").alias("n"))
    return B.text_filter_total(named, "red", "p_name", "n")


@query(
    "spotlight",
    with_(
        *BASE,
        "notes AS (SELECT doc_id AS id, 'quality ' || quality AS note FROM labels UNION ALL SELECT -1, 'gone')",
        body="SELECT n.id, note, round(mean, 9) AS mean, d.id IS NOT NULL AS found FROM notes n LEFT JOIN doc_scores d ON d.id = n.id",
    ),
)
def _(spark, sf):
    notes = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("note")
    ).union(spark.createDataFrame([(-1, "gone")], "id long, note string"))
    return rounded(B.spotlight(notes, X.doc_scores(spark, sf).select("id", "mean"), "id"), "mean")


SCORE_COLS = "round(mean, 9) AS mean, round(min, 9) AS min, round(p10, 9) AS p10, round(p90, 9) AS p90, round(range, 9) AS range, round(negative_ratio, 9) AS negative_ratio"


@query(
    "aggregate_scores",
    with_(LETTERS, SENTS, SCORED, DOC_SCORES, body=f"SELECT id, {SCORE_COLS}, sentence_count, sentence_count_substantive FROM doc_scores"),
)
def _(spark, sf):
    return rounded(X.doc_scores(spark, sf), "mean", "min", "p10", "p90", "range", "negative_ratio")


@query(
    "aggregate_multi",
    with_(
        LETTERS, SENTS, SCORED,
        "flagged AS (SELECT *, length(sentence)::DOUBLE AS chars, bool_or(NOT is_formulaic) OVER (PARTITION BY id) AS anyp FROM scored)",
        body="""SELECT id, round(avg(score), 9) AS score_mean, round(quantile_cont(score, 0.1), 9) AS score_p10, round(quantile_cont(score, 0.9), 9) AS score_p90,
        round(avg(chars), 9) AS chars_mean, round(quantile_cont(chars, 0.1), 9) AS chars_p10, round(quantile_cont(chars, 0.9), 9) AS chars_p90, count(*) AS sentence_count
        FROM flagged WHERE NOT anyp OR NOT is_formulaic GROUP BY id""",
    ),
)
def _(spark, sf):
    sent = X.sents(spark, sf).select("id", "idx", F.length("sentence").cast("double").alias("chars"))
    rows = X.scored(spark, sf).join(sent, ["id", "idx"])
    out = S.aggregate_multi(rows, "id", ["score", "chars"])
    return rounded(out, *[f"{m}_{x}" for m in ("score", "chars") for x in ("mean", "p10", "p90")])


@query(
    "aggregate_plain",
    with_(
        LETTERS, SENTS, SCORED,
        body="""SELECT id, round(avg(score), 9) AS score_mean, round(quantile_cont(score, 0.1), 9) AS score_p10,
        round(quantile_cont(score, 0.9), 9) AS score_p90, count(*) AS sentence_count FROM scored GROUP BY id""",
    ),
)
def _(spark, sf):
    out = S.aggregate_multi(X.scored(spark, sf), "id", ["score"], flag=None)
    return rounded(out, "score_mean", "score_p10", "score_p90")


@query(
    "monthly_band",
    with_(
        *BASE,
        body="""SELECT strftime(date, '%Y-%m') AS month, round(avg(mean), 9) AS mean, round(avg(p10), 9) AS p10, round(avg(p90), 9) AS p90, count(*) AS count
        FROM dated GROUP BY 1""",
    ),
)
def _(spark, sf):
    return rounded(S.monthly_band(X.dated_scores(spark, sf), "date"), "mean", "p10", "p90")


@query(
    "fixed_width_histogram",
    "SELECT floor(value / 2.5)::BIGINT AS bin, floor(value / 2.5) * 2.5 AS lo, (floor(value / 2.5) + 1) * 2.5 AS hi, count(*) AS count FROM events GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return S.fixed_width_histogram(table(spark, sf, "events"), "value", 2.5)


@query(
    "period_compare",
    with_(
        *BASE,
        "m AS (SELECT date >= DATE '2021-07-01' AS post, unnest(['mean', 'range']) AS metric, unnest([mean, range]) AS v FROM dated)",
        """a AS (SELECT metric, avg(v) FILTER (NOT post) AS b, avg(v) FILTER (post) AS e, count(v) FILTER (NOT post) AS bn, count(v) FILTER (post) AS en,
           sum(v) FILTER (NOT post) AS bt, sum(v) FILTER (post) AS et FROM m GROUP BY metric)""",
        body="""SELECT metric, round(b, 9) AS pre_mean, round(e, 9) AS post_mean, bn AS pre_n, en AS post_n, round(bt, 6) AS pre_total, round(et, 6) AS post_total,
        round(CASE WHEN b = 0 THEN 0 ELSE (e - b) / abs(b) * 100 END, 6) AS change_pct FROM a""",
    ),
)
def _(spark, sf):
    out = S.period_compare(X.dated_scores(spark, sf), "date", ["mean", "range"], X.ONSET)
    return rounded(rounded(out, "pre_mean", "post_mean"), "pre_total", "post_total", "change_pct", dp=6)


@query(
    "metric_by_period",
    with_(*BASE, body="SELECT strftime(date, '%Y') AS period, round(avg(mean), 9) AS mean_mean, count(mean) AS mean_n, round(avg(range), 9) AS range_mean, count(range) AS range_n FROM dated GROUP BY 1"),
)
def _(spark, sf):
    out = S.metric_by_period(X.dated_scores(spark, sf), D.year_key(F.col("date")), ["mean", "range"])
    return rounded(out, "mean_mean", "range_mean")


WORDS = "len(list_filter(string_split_regex(text, '" + X.WS + "+'), lambda t: t <> ''))"


@query(
    "corpus_statistics",
    with_(
        LETTERS,
        f"w AS (SELECT *, {WORDS} AS words FROM letters)",
        """top AS (SELECT 'sender' AS section, sender AS item, count(*)::DOUBLE AS value FROM w GROUP BY 2 ORDER BY value DESC, item LIMIT 5)""",
        """topr AS (SELECT 'recipient' AS section, recipient AS item, count(*)::DOUBLE AS value FROM w GROUP BY 2 ORDER BY value DESC, item LIMIT 5)""",
        """topp AS (SELECT 'place' AS section, place AS item, count(*)::DOUBLE AS value FROM w GROUP BY 2 ORDER BY value DESC, item LIMIT 10)""",
        body="""SELECT * FROM top UNION ALL SELECT * FROM topr UNION ALL SELECT * FROM topp
        UNION ALL SELECT 'year', strftime(date, '%Y'), count(*)::DOUBLE FROM w GROUP BY 2
        UNION ALL SELECT 'month', strftime(date, '%Y-%m'), count(*)::DOUBLE FROM w GROUP BY 2
        UNION ALL SELECT 'words_per_year', strftime(date, '%Y'), round(avg(words), 6) FROM w GROUP BY 2
        UNION ALL SELECT 'overall', 'first_date ' || min(date), NULL FROM w
        UNION ALL SELECT 'overall', 'last_date ' || max(date), NULL FROM w
        UNION ALL SELECT 'overall', 'mean_words', round(avg(words), 6) FROM w
        UNION ALL (SELECT 'longest', id::VARCHAR, words::DOUBLE FROM w ORDER BY words DESC, id LIMIT 1)
        UNION ALL (SELECT 'shortest', id::VARCHAR, words::DOUBLE FROM w ORDER BY words, id LIMIT 1)""",
    ),
)
def _(spark, sf):
    return R.corpus_statistics(X.letters(spark, sf)).withColumn("value", F.round("value", 6))


@query("monthly_density", with_(LETTERS, body="SELECT strftime(date, '%Y-%m') AS month, count(*) AS count FROM letters GROUP BY 1"))
def _(spark, sf):
    return R.monthly_density(X.letters(spark, sf), "date")


@query(
    "frequency_table",
    with_(LETTERS, body="SELECT recipient, token AS item, count(*) AS count FROM (SELECT recipient, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM letters) GROUP BY 1, 2"),
)
def _(spark, sf):
    toks = SN.tokens(X.letters(spark, sf), ["recipient"], "text", lower=False)
    return R.frequency_table(toks, "token", ["recipient"]).withColumnRenamed("token", "item")


@query(
    "rollup_by_lemma",
    """WITH f AS (SELECT p_name AS word, count(*) AS freq FROM part GROUP BY 1), l AS (SELECT DISTINCT p_name AS word, split_part(p_name, ' ', 2) AS lemma FROM part)
    SELECT lemma, sum(freq)::BIGINT AS freq FROM f JOIN l USING (word) GROUP BY 1""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    freq = p.groupBy(F.col("p_name").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    lemma = p.select(F.col("p_name").alias("word"), F.split("p_name", " ")[1].alias("lemma")).distinct()
    return R.rollup_by_lemma(freq, lemma)


@query(
    "group_means",
    with_(*BASE, body="SELECT recipient, count(*) AS documents, round(avg(mean), 9) AS mean_mean, round(avg(negative_ratio), 9) AS negative_ratio_mean FROM dated GROUP BY 1"),
)
def _(spark, sf):
    return rounded(S.group_means(X.dated_scores(spark, sf), "recipient", ["mean", "negative_ratio"]), "mean_mean", "negative_ratio_mean")


@query(
    "describe_methods",
    """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
    SELECT metric, count(v) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS min, max(v) AS max,
    round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3 FROM m GROUP BY 1""",
)
def _(spark, sf):
    out = S.describe_methods(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, "mean", "std", "q1", "median", "q3", dp=5)


@query(
    "place_counts",
    with_(LETTERS, body="SELECT place, count(*) AS count, arg_min(location, id) AS location FROM letters GROUP BY 1"),
)
def _(spark, sf):
    return R.place_counts(X.letters(spark, sf))


@query(
    "overview_cards",
    with_(LETTERS, SENTS, SCORED, DOC_SCORES, body="SELECT count(*) AS documents, round(avg(mean), 9) AS mean_score, sum(sentence_count_substantive)::BIGINT AS sentences, round(avg(negative_ratio), 9) AS negative_ratio FROM doc_scores"),
)
def _(spark, sf):
    return rounded(R.overview_cards(X.doc_scores(spark, sf)), "mean_score", "negative_ratio")


@query(
    "sentence_stats",
    with_(LETTERS, SENTS, body="SELECT count(*) AS sentences, count(*) FILTER (is_formulaic) AS formulaic, count(DISTINCT id) AS documents, round(count(*) / count(DISTINCT id), 9) AS per_document FROM sents"),
)
def _(spark, sf):
    return rounded(R.sentence_stats(X.sents(spark, sf), "id"), "per_document")


@query("corpus_end", with_(LETTERS, body="SELECT max(date) AS corpus_end FROM letters"))
def _(spark, sf):
    return R.corpus_end(X.letters(spark, sf).withColumn("date", F.col("date").cast("string")), "date")


@query(
    "summary_minmax",
    """WITH m AS (SELECT unnest(['l_tax', 'l_discount']) AS metric, unnest([l_tax, l_discount]) AS v FROM lineitem)
    SELECT metric, round(avg(v), 9) AS mean, min(v) AS min, max(v) AS max, round(sum(v), 4) AS total, count(*) FILTER (v > 0) AS above_zero FROM m GROUP BY 1""",
)
def _(spark, sf):
    out = S.summary_minmax(table(spark, sf, "lineitem"), ["l_tax", "l_discount"])
    return rounded(rounded(out, "mean"), "total", dp=4)


@query(
    "metric_ranking",
    with_(
        *BASE,
        """g AS (SELECT strftime(date, '%Y') || '-Q' || quarter(date) AS q, avg(mean) FILTER (recipient = 'en') - avg(mean) FILTER (recipient = 'fr') AS dm,
           avg(range) FILTER (recipient = 'en') - avg(range) FILTER (recipient = 'fr') AS dr FROM dated GROUP BY 1)""",
        body="SELECT 'mean' AS metric, round(avg(abs(dm)), 9) AS mean_abs FROM g UNION ALL SELECT 'range', round(avg(abs(dr)), 9) FROM g",
    ),
)
def _(spark, sf):
    side = lambda m, r: F.avg(F.when(F.col("recipient") == r, F.col(m)))
    g = X.dated_scores(spark, sf).groupBy(D.quarter_key(F.col("date")).alias("q")).agg(
        (side("mean", "en") - side("mean", "fr")).alias("dm"), (side("range", "en") - side("range", "fr")).alias("dr")
    )
    return rounded(S.metric_ranking(g, {"mean": F.col("dm"), "range": F.col("dr")}), "mean_abs")


@query(
    "correlate",
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
    k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r)
    SELECT count(*) AS n, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman, round(corr(x, y) * corr(x, y), 8) AS r2,
           corr(x, y) * corr(x, y) > 0.5 AS confounded FROM k""",
)
def _(spark, sf):
    out = S.correlate(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, "pearson", "spearman", "r2", dp=8)


@query(
    "top_divergence",
    """WITH b AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0, max(l_extendedprice) p1 FROM lineitem),
    s AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, (l_quantity - q0) / (q1 - q0) AS a, (l_extendedprice - p0) / (p1 - p0) AS b FROM lineitem, b)
    SELECT key, round(divergence, 9) AS divergence, row_number() OVER (ORDER BY divergence DESC, key) AS rank FROM (
      SELECT k * 100000000 + l_partkey AS key, abs(a - b) AS divergence FROM s ORDER BY divergence DESC, key LIMIT 20)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("key"),
        "l_quantity", "l_extendedprice",
    )
    sc = S.minmax_scale(li, ["l_quantity", "l_extendedprice"])
    out = S.top_divergence(sc, "l_quantity_scaled", "l_extendedprice_scaled", 20, "key")
    return rounded(out.select("key", "divergence", F.col("rank").cast("long").alias("rank")), "divergence")


@query(
    "union_of_extremes",
    """SELECT c_custkey, c_nationkey, round(c_acctbal, 9) AS c_acctbal FROM customer
    WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal, c_custkey LIMIT 10)
    OR c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IS NOT NULL ORDER BY c_nationkey, c_custkey LIMIT 10)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(S.union_of_extremes(c, ["c_acctbal", "c_nationkey"], 10, "c_custkey"), "c_acctbal")


@query(
    "extremes",
    with_(
        *BASE,
        body="""SELECT id, round(mean, 9) AS mean, rank, side FROM (
        SELECT id, mean, row_number() OVER (ORDER BY mean DESC, id) AS rank, 'high' AS side FROM dated
        UNION ALL SELECT id, mean, row_number() OVER (ORDER BY mean, id), 'low' FROM dated) WHERE rank <= 15""",
    ),
)
def _(spark, sf):
    out = S.extremes(X.doc_scores(spark, sf).select("id", "mean"), "mean", 15, "id")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "mean")


@query(
    "dominant_measure",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'l_discount'
    WHEN l_tax >= l_quantity / 500 THEN 'l_tax' ELSE 'share' END AS dominant FROM lineitem""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("share", F.col("l_quantity") / 500)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.dominant_measure(["l_discount", "l_tax", "share"]).alias("dominant"))


@query(
    "notable",
    with_(
        *BASE,
        """r AS (SELECT id, mean, row_number() OVER (ORDER BY mean, id) a, row_number() OVER (ORDER BY mean DESC, id) b,
           row_number() OVER (ORDER BY range DESC, id) c, row_number() OVER (ORDER BY negative_ratio DESC, id) d FROM doc_scores)""",
        """p AS (SELECT 'lowest_mean' AS list, a AS rank, id, mean, 'min' AS side FROM r WHERE a <= 10 UNION ALL SELECT 'highest_mean', b, id, mean, 'max' FROM r WHERE b <= 10
           UNION ALL SELECT 'widest_range', c, id, mean, 'min' FROM r WHERE c <= 10 UNION ALL SELECT 'most_negative', d, id, mean, 'min' FROM r WHERE d <= 10)""",
        """e AS (SELECT id, (list(sentence ORDER BY score, idx))[1] AS lo, (list(sentence ORDER BY score DESC, idx))[1] AS hi FROM scored WHERE NOT is_formulaic GROUP BY id)""",
        body="SELECT list, rank, p.id, round(mean, 9) AS mean, CASE side WHEN 'max' THEN hi ELSE lo END AS excerpt FROM p LEFT JOIN e ON e.id = p.id",
    ),
)
def _(spark, sf):
    sent = X.sents(spark, sf).select("id", "idx", "sentence")
    rows = X.scored(spark, sf).join(sent, ["id", "idx"])
    out = S.notable(X.doc_scores(spark, sf), rows, "id")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "mean")


@query(
    "merged_lookup",
    """SELECT c_name AS name, c_custkey AS id FROM customer UNION ALL
    SELECT DISTINCT 'Customer#' || lpad((s_suppkey * 29)::VARCHAR, 9, '0'), NULL FROM supplier
    WHERE 'Customer#' || lpad((s_suppkey * 29)::VARCHAR, 9, '0') NOT IN (SELECT c_name FROM customer)""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    b = table(spark, sf, "supplier").select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 29).cast("string"), 9, "0")).alias("name"))
    return J.merged_lookup(a, b, "name", "c_custkey")


@query(
    "usage_stats",
    """WITH u AS (SELECT l_partkey AS item, l_returnflag AS relevance, l_discount * 10 AS score FROM lineitem),
    top AS (SELECT item, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, item LIMIT 10)
    SELECT 'relevance' AS section, relevance AS item, count(*) AS n FROM u GROUP BY 2
    UNION ALL SELECT 'bracket', CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END, count(*) FROM u GROUP BY 2
    UNION ALL SELECT 'top', item::VARCHAR, n FROM top
    UNION ALL SELECT 'unused', p_partkey::VARCHAR, 0 FROM part WHERE p_partkey NOT IN (SELECT item FROM u)""",
)
def _(spark, sf):
    u = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("relevance"), (F.col("l_discount") * 10).alias("score")
    )
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    return R.usage_stats(u, items, "item")


@query(
    "findings_summary",
    """WITH f AS (SELECT event_type AS category, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'medium' ELSE 'review' END AS confidence, user_id AS doc FROM events)
    SELECT 'category' AS section, category AS item, count(*) AS findings, count(DISTINCT doc) AS documents FROM f GROUP BY 2
    UNION ALL SELECT 'confidence', confidence, count(*), count(DISTINCT doc) FROM f GROUP BY 2
    UNION ALL SELECT 'total', NULL, count(*), count(DISTINCT doc) FROM f""",
)
def _(spark, sf):
    v = F.col("value")
    f = table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.col("user_id").alias("doc"),
        F.when(v > 20, "high").when(v > 5, "medium").otherwise("review").alias("confidence"),
    )
    return R.findings_summary(f, "doc")


@query(
    "completeness_report",
    """WITH d AS (SELECT nullif(l.quality::VARCHAR, '0') AS quality, d.source, string_split(d.text, chr(10))[2:] AS tail FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'quality' AS field, count(*) FILTER (trim(quality) <> '') AS filled, count(*) - count(*) FILTER (trim(quality) <> '') AS missing FROM d
    UNION ALL SELECT 'source', count(*) FILTER (trim(source) <> ''), count(*) - count(*) FILTER (trim(source) <> '') FROM d
    UNION ALL SELECT 'tail', count(*) FILTER (len(tail) > 0), count(*) FILTER (len(tail) = 0) FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.nullif(F.col("quality").cast("string"), F.lit("0")).alias("quality"), "source",
        F.slice(F.split("text", "\n"), F.lit(2), F.length("text") + 1).alias("tail"),
    )
    return R.completeness_report(d, ["quality", "source"], ["tail"])


@query(
    "collect_entities",
    """WITH m AS (SELECT conv_id, CASE role WHEN 'user' THEN 'PER' WHEN 'assistant' THEN 'LOC' ELSE 'ORG' END AS type, split_part(text, ' ', 1) AS text FROM conversations)
    SELECT conv_id, coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (type = 'PER')), '|'), '') AS persons,
    coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (type = 'LOC')), '|'), '') AS locations,
    coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (type = 'ORG')), '|'), '') AS organizations,
    count(DISTINCT type || ':' || text) AS entities FROM m GROUP BY 1""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "PER").when(F.col("role") == "assistant", "LOC").otherwise("ORG")
    m = c.select(F.col("conv_id"), kind.alias("type"), F.split("text", " ")[0].alias("text"))
    out = R.collect_entities(m, "conv_id")
    return out.select("conv_id", *[F.array_join(k, "|").alias(k) for k in ("persons", "locations", "organizations")],
                      F.size("entities").cast("long").alias("entities"))


@query(
    "silence_analysis",
    """WITH m AS (SELECT l_suppkey AS id, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT max(d) AS e FROM m),
    n AS (SELECT id, count(DISTINCT doc) AS letters, min(d) AS first_mention, max(d) AS last_mention, count(DISTINCT year(d)) AS years FROM m GROUP BY 1)
    SELECT id, letters AS letter_count, first_mention, last_mention, date_diff('day', last_mention, e) AS silence_days,
    date_diff('day', last_mention, e) > 20 AND letters >= 5 AS disappeared,
    round(least(1.0, years / (year(last_mention) - year(first_mention) + 1)), 3) AS regularity FROM n, e""",
)
def _(spark, sf):
    m = X.mentions(spark, sf)
    nodes = R.mention_nodes(m, "id", "doc", "date")
    end = R.corpus_end(m.select("date"), "date")
    out = R.silence_analysis(nodes, end, threshold=20, min_count=5)
    return out.select("id", "letter_count", "first_mention", "last_mention", F.col("silence_days").cast("long").alias("silence_days"), "disappeared", "regularity")


@query(
    "silence_report",
    """WITH m AS (SELECT l_suppkey AS id, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT max(d) AS e FROM m),
    n AS (SELECT id, count(DISTINCT doc) AS c, max(d) AS l FROM m GROUP BY 1),
    s AS (SELECT n.id, c, l, date_diff('day', l, e) AS days, s_nationkey::VARCHAR AS category FROM n JOIN supplier ON s_suppkey = n.id, e WHERE date_diff('day', l, e) > 20 AND c >= 5)
    SELECT 'year' AS section, year(l)::VARCHAR AS item, count(*) AS n FROM s GROUP BY 2
    UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY 2
    UNION ALL SELECT 'cluster', year(l)::VARCHAR, count(*) FROM s GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'longest', id::VARCHAR, days FROM (SELECT id, days FROM s ORDER BY days DESC, id LIMIT 5)""",
)
def _(spark, sf):
    m = X.mentions(spark, sf)
    nodes = R.mention_nodes(m, "id", "doc", "date")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("category"))
    nodes = nodes.join(F.broadcast(sup), "id")
    marked = R.silence_analysis(nodes, R.corpus_end(m.select("date"), "date"), threshold=20, min_count=5)
    return R.silence_report(marked)
