"""Ordered series, divergence of audiences and word shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.operators import divergence as V
from missiva.operators import series as S
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import BASE, LETTERS, MENTIONS, SCORED, SENTS, rounded, with_
from missiva.plans.join_plans import LOCATED, _located

EVENTS = "ev AS (SELECT event_id, user_id, ts, event_type, value, (value - 10) / 10 AS score FROM events)"


def events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", ((F.col("value") - 10) / 10).alias("score")
    )


@query(
    "chronological_id",
    with_(
        LETTERS,
        body="""SELECT id, date, row_number() OVER w AS chrono_id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM letters WINDOW w AS (ORDER BY date, id)""",
    ),
)
def _(spark, sf):
    return S.chronological_id(X.letters(spark, sf).select("id", "date"), "date", "id")


@query(
    "centered_rolling_mean",
    with_(
        EVENTS,
        body="""SELECT event_id, round(avg(score) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS smoothed FROM ev""",
    ),
)
def _(spark, sf):
    out = S.centered_rolling_mean(events(spark, sf), ["user_id"], ["ts", "event_id"], "score")
    return rounded(out.select("event_id", "smoothed"), "smoothed")


@query(
    "centered_rolling_mean_blocked",
    with_(EVENTS, body="SELECT event_id, round(avg(score) OVER (ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS smoothed FROM ev"),
)
def _(spark, sf):
    # One series for the whole table, with a group bound that forces the block-wise route.
    out = S.centered_rolling_mean(events(spark, sf), [], ["ts", "event_id"], "score", limit=3000)
    return rounded(out.select("event_id", "smoothed"), "smoothed")


@query(
    "velocity",
    with_(
        EVENTS,
        "s AS (SELECT event_id, user_id, abs(lead(score) OVER (PARTITION BY user_id ORDER BY ts, event_id) - score) AS step FROM ev)",
        body="SELECT event_id, round(step, 9) AS step, row_number() OVER (ORDER BY step DESC, event_id) AS rank FROM s WHERE step IS NOT NULL ORDER BY rank LIMIT 10",
    ),
)
def _(spark, sf):
    steps = S.velocity(events(spark, sf), ["user_id"], ["ts", "event_id"], "score")
    out = S.top_transitions(steps.select("event_id", "step"), ["event_id"], 10)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "step")


@query(
    "volatility_asymmetry",
    with_(
        LETTERS, SENTS, SCORED,
        """p AS (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY idx) AS i, count(*) OVER (PARTITION BY id) AS n,
             lag(score) OVER (PARTITION BY id ORDER BY idx) AS prev FROM scored WHERE NOT is_formulaic)""",
        "g AS (SELECT id, avg(abs(score - prev)) AS v, avg(score) FILTER (i > n // 2) - avg(score) FILTER (i <= n // 2) AS a, max(n) AS n FROM p GROUP BY 1)",
        body="""SELECT s.id, round(CASE WHEN g.n >= 2 THEN v ELSE 0 END, 9) AS volatility, round(CASE WHEN g.n >= 2 THEN a ELSE 0 END, 9) AS asymmetry
        FROM (SELECT DISTINCT id FROM scored) s LEFT JOIN g ON g.id = s.id""",
    ),
)
def _(spark, sf):
    return rounded(S.volatility_asymmetry(X.scored(spark, sf), "id"), "volatility", "asymmetry")


ARCS = """
ap AS (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY idx) AS i, count(*) OVER (PARTITION BY id) AS n
       FROM (SELECT *, bool_or(NOT is_formulaic) OVER (PARTITION BY id) AS anyp FROM scored) WHERE NOT anyp OR NOT is_formulaic),
ag AS (SELECT id, avg(score) FILTER (i <= n // 3) AS f, avg(score) FILTER (i > n // 3 AND i <= 2 * (n // 3)) AS m, avg(score) FILTER (i > 2 * (n // 3)) AS l,
       coalesce(avg(score) FILTER (i > n // 2) - avg(score) FILTER (i <= n // 2), 0) AS a, max(score) - min(score) AS r, max(n) AS n FROM ap GROUP BY 1),
arcs AS (SELECT id, CASE WHEN n < 3 THEN 'flat' WHEN m < least(f, l) - 0.1 THEN 'valley' WHEN m > greatest(f, l) + 0.1 THEN 'peak'
         WHEN l > f + 0.1 THEN 'rising' WHEN f > l + 0.1 THEN 'falling' ELSE 'flat' END AS arc_type, a AS arc_asymmetry, r AS sentiment_range, n AS sentence_count_substantive FROM ag)"""


def arcs(spark, sf):
    return S.classify_arc(X.scored(spark, sf), "id")


@query(
    "classify_arc",
    with_(LETTERS, SENTS, SCORED, ARCS, body="SELECT id, arc_type, round(arc_asymmetry, 9) AS arc_asymmetry, round(sentiment_range, 9) AS sentiment_range, sentence_count_substantive FROM arcs"),
)
def _(spark, sf):
    return rounded(arcs(spark, sf).withColumn("sentence_count_substantive", F.col("sentence_count_substantive").cast("long")), "arc_asymmetry", "sentiment_range")


@query(
    "category_distribution",
    with_(LETTERS, SENTS, SCORED, ARCS, body="SELECT arc_type, count(*) AS total, count(*) FILTER (recipient = 'en') AS en, count(*) FILTER (recipient = 'fr') AS fr FROM arcs JOIN letters ON letters.id = arcs.id GROUP BY 1"),
)
def _(spark, sf):
    j = arcs(spark, sf).join(X.letters(spark, sf).select("id", "recipient"), "id")
    return j.groupBy("arc_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("recipient") == "en").alias("en"), F.count_if(F.col("recipient") == "fr").alias("fr")
    )


CUSUM_SQL = """
s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, score FROM ev),
st AS (SELECT user_id, avg(score) AS m, stddev_pop(score) AS sd FROM ev GROUP BY 1),
z AS (SELECT s.user_id, i, (score - m) / sd AS z FROM s JOIN st ON st.user_id = s.user_id WHERE sd > 0),
c AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, 'none' AS direction FROM st WHERE sd > 0
      UNION ALL
      SELECT user_id, i, CASE WHEN hit <> 'none' THEN 0.0 ELSE p END, CASE WHEN hit <> 'none' THEN 0.0 ELSE n END, hit FROM (
        SELECT z.user_id, z.i, greatest(0.0, c.p + z - 0.5) AS p, greatest(0.0, c.n - z - 0.5) AS n,
               CASE WHEN greatest(0.0, c.p + z - 0.5) > 1.5 THEN 'positive' WHEN greatest(0.0, c.n - z - 0.5) > 1.5 THEN 'negative' ELSE 'none' END AS hit
        FROM c JOIN z ON z.user_id = c.user_id AND z.i = c.i + 1))"""


@query(
    "cusum_change_points",
    with_(EVENTS, CUSUM_SQL, body="SELECT user_id, i AS index, direction FROM c WHERE direction <> 'none'").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf):
    return S.cusum_change_points(events(spark, sf), ["user_id"], ["ts", "event_id"], "score", block=50)


@query(
    "rolling_days",
    with_(
        EVENTS,
        "d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM ev GROUP BY 1, 2)",
        body="""SELECT event_type, day, round(sum(s) OVER w / sum(n) OVER w, 7) AS rolling_mean, (sum(n) OVER w)::BIGINT AS rows_in_window FROM d
        WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    ),
)
def _(spark, sf):
    return rounded(S.rolling_days(events(spark, sf), ["event_type"], "ts", "value", 6), "rolling_mean", dp=7)


@query(
    "yearly_drift",
    """WITH y AS (SELECT o_orderpriority AS word, year(o_orderdate) AS year, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)
    SELECT word, year, round(mean, 4) AS mean, round(mean - lag(mean) OVER (PARTITION BY word ORDER BY year), 4) AS drift FROM y""",
)
def _(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("word"), F.year("o_orderdate").cast("long").alias("year")).agg(F.avg("o_totalprice").alias("mean"))
    return rounded(S.yearly_drift(y, "word", "year", "mean"), "mean", "drift", dp=4)


@query(
    "travel_log",
    with_(
        LETTERS, LOCATED,
        "l AS (SELECT a.id, s.sender, a.date, a.lat, a.lng FROM located a JOIN letters s ON s.id = a.id)",
        "p AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(date) OVER w AS pdate FROM l WINDOW w AS (PARTITION BY sender ORDER BY date, id))",
        """k AS (SELECT *, coalesce(date - pdate, 0) AS days, coalesce(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 0) AS km FROM (SELECT *,
           pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS h FROM p))""",
        body="""SELECT id, days::BIGINT AS days, round(km, 5) AS km, round(sum(km) OVER (PARTITION BY sender ORDER BY date, id), 3) AS total_km, round(km / greatest(days, 1), 5) AS km_per_day FROM k""",
    ),
)
def _(spark, sf):
    who = X.letters(spark, sf).select("id", "sender")
    out = S.travel_log(_located(spark, sf).drop("place").join(who, "id"), ["sender"], "date", "id")
    out = out.select("id", F.col("days").cast("long").alias("days"), "km", "total_km", "km_per_day")
    return rounded(rounded(out, "km", "km_per_day", dp=5), "total_km", dp=3)


@query(
    "path_segments",
    with_(
        LETTERS, LOCATED,
        "l AS (SELECT a.id, s.sender, a.lat, a.lng FROM located a JOIN letters s ON s.id = a.id)",
        body="""SELECT * FROM (SELECT sender, id AS from_id, lead(id) OVER w AS to_id, lat AS from_lat, lng AS from_lng, lead(lat) OVER w AS to_lat, lead(lng) OVER w AS to_lng
        FROM l WINDOW w AS (PARTITION BY sender ORDER BY id)) WHERE to_id IS NOT NULL""",
    ),
)
def _(spark, sf):
    who = X.letters(spark, sf).select("id", "sender")
    return S.path_segments(_located(spark, sf).drop("date", "place").join(who, "id"), ["sender"], "id")


@query(
    "capped_selection",
    """WITH c AS (SELECT l_orderkey % 500 AS doc, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS item, l_extendedprice AS score,
      CASE l_returnflag WHEN 'A' THEN 'recipient' WHEN 'R' THEN 'map' ELSE CASE WHEN l_linestatus = 'O' THEN 'historical' ELSE 'free' END END AS class FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc, class ORDER BY score DESC, item) AS r FROM c),
    k AS (SELECT * FROM r WHERE class = 'free' OR r <= CASE class WHEN 'historical' THEN 1 ELSE 2 END)
    SELECT doc, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, item) AS rank FROM k) WHERE rank <= 8""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    cls = F.when(flag == "A", "recipient").when(flag == "R", "map").when(F.col("l_linestatus") == "O", "historical").otherwise("free")
    rows = li.select(
        (F.col("l_orderkey") % 500).alias("doc"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey") % 10000).alias("item"),
        F.col("l_extendedprice").alias("score"), cls.alias("class"),
    )
    # Quotas per class and in total.
    caps = (("recipient", 2), ("map", 2), ("historical", 1))
    out = S.capped_selection(rows, "doc", "item", "score", F.col("class"), caps, 8)
    return out.select("doc", "item", "score", F.col("rank").cast("long").alias("rank"))


@query("first_seen", with_(MENTIONS, body="SELECT id, min(year(date)) AS first_period FROM mentions GROUP BY 1"))
def _(spark, sf):
    m = X.mentions(spark, sf).withColumn("year", F.year("date").cast("long"))
    return S.first_seen(m, "id", "year")


@query(
    "new_per_period",
    "SELECT period, count(*) AS new_entities FROM (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS period FROM orders GROUP BY 1) GROUP BY 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return S.new_per_period(o, "o_custkey", "month")


@query(
    "even_sample",
    with_(
        EVENTS,
        "r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m FROM ev)",
        body="SELECT event_id, event_type FROM r WHERE k % greatest(1, m // 20) = 0 AND k // greatest(1, m // 20) < 20",
    ),
)
def _(spark, sf):
    return S.even_sample(events(spark, sf), ["event_type"], ["ts", "event_id"], 20).select("event_id", "event_type")


@query(
    "pick_example",
    with_(
        LETTERS, SENTS,
        "c AS (SELECT l.recipient, s.id * 100000 + s.idx AS k, s.sentence, abs(length(s.sentence) - 90) + CASE WHEN length(s.sentence) > 200 THEN 1000 ELSE 0 END AS cost FROM sents s JOIN letters l ON l.id = s.id)",
        body="SELECT recipient, m.c::BIGINT AS cost, m.k AS k, m.s AS sentence FROM (SELECT recipient, min({'c': cost, 'k': k, 's': sentence}) AS m FROM c GROUP BY 1)",
    ),
)
def _(spark, sf):
    s = X.sents(spark, sf).join(X.letters(spark, sf).select("id", "recipient"), "id")
    s = s.select("recipient", (F.col("id") * 100000 + F.col("idx")).alias("k"), "sentence")
    return S.pick_example(s, ["recipient"], "sentence", "k").withColumn("cost", F.col("cost").cast("long"))


@query(
    "activity_profile",
    with_(MENTIONS, body="SELECT id, string_agg(DISTINCT year(date)::VARCHAR, '|' ORDER BY year(date)::VARCHAR) AS years, count(DISTINCT year(date)) AS persistence FROM mentions GROUP BY 1"),
)
def _(spark, sf):
    return S.activity_profile(X.mentions(spark, sf), "id", "date").withColumn("persistence", F.col("persistence").cast("long"))


@query(
    "word_divergence",
    with_(
        LETTERS,
        "t AS (SELECT strftime(date, '%Y') || '-Q' || quarter(date) AS period, recipient, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM letters WHERE recipient IN ('en', 'fr'))",
        "c AS (SELECT period, token, count(*) FILTER (recipient = 'en') AS na, count(*) FILTER (recipient = 'fr') AS nb FROM t GROUP BY 1, 2)",
        "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY na + nb DESC, token) AS r FROM c) WHERE r <= 200)",
        "s AS (SELECT *, sum(na) OVER (PARTITION BY period) AS ta, sum(nb) OVER (PARTITION BY period) AS tb, count(*) OVER (PARTITION BY period) AS n FROM b)",
        "d AS (SELECT period, (na + 1e-10) / (ta + n * 1e-10) AS p, (nb + 1e-10) / (tb + n * 1e-10) AS q FROM s WHERE ta > 0 AND tb > 0)",
        body="SELECT period, round(sqrt(greatest(0.0, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2))), 7) AS jsd, count(*) AS words FROM d GROUP BY 1",
    ),
)
def _(spark, sf):
    lt = X.letters(spark, sf).withColumn("period", D.quarter_key(F.col("date")))
    return rounded(V.word_divergence(lt, "recipient", "en", "fr", "period", "text"), "jsd", dp=7)


@query(
    "wasserstein_1d",
    with_(
        EVENTS,
        "pts AS (SELECT strftime(ts, '%Y-%m-%d') AS period, score AS x, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2)",
        """c AS (SELECT period, x, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, lead(x) OVER (PARTITION BY period ORDER BY x) AS nx,
             sum(na) OVER (PARTITION BY period) AS ta, sum(nb) OVER (PARTITION BY period) AS tb FROM pts WINDOW w AS (PARTITION BY period ORDER BY x))""",
        body="SELECT period, round(coalesce(sum(CASE WHEN ta > 0 AND tb > 0 THEN abs(ca / ta - cb / tb) * (nx - x) END), 0), 9) AS wasserstein FROM c GROUP BY 1",
    ),
)
def _(spark, sf):
    e = events(spark, sf).withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(V.wasserstein_1d(e, "event_type", "click", "view", "period", "score"), "wasserstein")


@query(
    "effect_size",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, value, get_bit(event_id::BIT, 63)::DOUBLE AS parity FROM events WHERE event_type IN ('click', 'view')),
    l AS (SELECT period, event_type, unnest(['value', 'parity']) AS metric, unnest([value, parity]) AS v FROM e),
    g AS (SELECT period, metric, avg(v) FILTER (event_type = 'click') AS ma, avg(v) FILTER (event_type = 'view') AS mb, coalesce(var_samp(v) FILTER (event_type = 'click'), 0) AS sa,
      coalesce(var_samp(v) FILTER (event_type = 'view'), 0) AS sb, count(v) FILTER (event_type = 'click') AS na, count(v) FILTER (event_type = 'view') AS nb FROM l GROUP BY 1, 2),
    p AS (SELECT *, sqrt(((na - 1) * sa + (nb - 1) * sb) / nullif(na + nb - 2, 0)) AS sd FROM g)
    SELECT period, metric, round(CASE WHEN na > 0 AND nb > 0 AND sd > 0 THEN abs(ma - mb) / sd ELSE 0 END, 9) AS effect FROM p""",
)
def _(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    e = e.withColumn("period", F.date_format("ts", "yyyy-MM-dd")).withColumn("parity", (F.col("event_id") % 2).cast("double"))
    return rounded(V.effect_size(e, "event_type", "click", "view", "period", ["value", "parity"]), "effect")


SHIFT = (
    *BASE,
    "tg(word) AS (VALUES ('the'), ('de'), ('und'), ('la'), ('and'))",
    "sw AS (SELECT l.date, s.id, s.idx, s.score, list_distinct(regexp_extract_all(lower(s.sentence), '[\\p{L}\\p{N}_]+')) AS w FROM scored s JOIN letters l ON l.id = s.id)",
    "h AS (SELECT year(date) AS year, score, word FROM (SELECT date, score, unnest(w) AS word FROM sw) JOIN tg USING (word))",
    "py AS (SELECT word, year, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM h GROUP BY 1, 2)",
    "pd AS (SELECT *, mean - lag(mean) OVER (PARTITION BY word ORDER BY year) AS drift, row_number() OVER (PARTITION BY word ORDER BY year) - 1 AS i FROM py)",
)


def _shift(spark, sf):
    s = X.scored(spark, sf).join(X.sents(spark, sf).select("id", "idx", "sentence"), ["id", "idx"])
    s = s.join(X.letters(spark, sf).select("id", F.year("date").cast("long").alias("year")), "id")
    t = spark.createDataFrame([(w,) for w in ("the", "de", "und", "la", "and")], "word string")
    return V.word_context_shift(s, t, "year")


@query("word_context_shift", with_(*SHIFT, body="SELECT word, year, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(drift, 9) AS drift FROM pd"))
def _(spark, sf):
    return rounded(_shift(spark, sf), "mean", "sd", "drift")


@query(
    "shift_ranking",
    with_(
        *SHIFT,
        "g AS (SELECT word, coalesce(sum(abs(drift)), 0) AS td, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(sd, i), 0) ELSE 0 END AS f FROM pd GROUP BY 1)",
        body="""SELECT * FROM (SELECT 'fossilising' AS list, row_number() OVER (ORDER BY f, word) AS rank, word FROM g UNION ALL
        SELECT 'drifting', row_number() OVER (ORDER BY td DESC, word), word FROM g) WHERE rank <= 3""",
    ),
)
def _(spark, sf):
    out = V.shift_ranking(V.shift_summary(_shift(spark, sf), "year"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "arc_range_summary",
    with_(
        *BASE, ARCS,
        "o AS (SELECT a.*, l.date, row_number() OVER (ORDER BY l.date, a.id) AS rn, count(*) OVER () AS n FROM arcs a JOIN letters l ON l.id = a.id WHERE l.date BETWEEN DATE '2020-06-01' AND DATE '2023-01-31')",
        "h1 AS (SELECT arc_type FROM o WHERE rn <= n // 2 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        "h2 AS (SELECT arc_type FROM o WHERE rn > n // 2 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        body="""SELECT 'share' AS section, arc_type AS item, round(count(*) * 100.0 / max(n), 6) AS value FROM o GROUP BY 2
        UNION ALL SELECT 'mean', 'sentiment_range', round(avg(sentiment_range), 9) FROM o
        UNION ALL SELECT 'mean', 'arc_asymmetry', round(avg(arc_asymmetry), 9) FROM o
        UNION ALL SELECT 'first_half', arc_type, NULL FROM h1 UNION ALL SELECT 'second_half', arc_type, NULL FROM h2""",
    ),
)
def _(spark, sf):
    from missiva.operators.reports import arc_range_summary

    a = arcs(spark, sf).join(X.letters(spark, sf).select("id", "date"), "id")
    out = arc_range_summary(a, "2020-06-01", "2023-01-31")
    return out.withColumn("value", F.when(F.col("section") == "share", F.round("value", 6)).otherwise(F.round("value", 9)))


@query(
    "range_summary",
    with_(
        *BASE,
        "o AS (SELECT * FROM dated WHERE date BETWEEN DATE '2020-06-01' AND DATE '2023-01-31')",
        "lo AS (SELECT id FROM o ORDER BY mean, id LIMIT 1)", "hi AS (SELECT id FROM o ORDER BY mean DESC, id LIMIT 1)",
        "dm AS (SELECT CASE WHEN avg(range) >= avg(negative_ratio) AND avg(range) >= avg(mean) THEN 'range' WHEN avg(negative_ratio) >= avg(mean) THEN 'negative_ratio' ELSE 'mean' END AS d FROM o)",
        body="""SELECT 'trend' AS section, strftime(date, '%Y-%m') AS item, round(avg(mean), 9) AS value FROM o GROUP BY 2
        UNION ALL SELECT 'average', 'mean', round(avg(mean), 9) FROM o UNION ALL SELECT 'lowest', id::VARCHAR, NULL FROM lo
        UNION ALL SELECT 'highest', id::VARCHAR, NULL FROM hi UNION ALL SELECT 'dominant', d, NULL FROM dm""",
    ),
)
def _(spark, sf):
    from missiva.operators.reports import range_summary

    out = range_summary(X.dated_scores(spark, sf), "2020-06-01", "2023-01-31", ["range", "negative_ratio", "mean"])
    return rounded(out, "value")
