"""Vector, cluster and retrieval queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from missiva.operators import retrieval as R
from missiva.operators import vectors as V
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import LETTERS, rounded, with_


def emb(spark, sf):
    return table(spark, sf, "embeddings")


DIMS = "dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
CENTROIDS = """
cent AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1)"""
DV = "dv AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "concept_vector",
    with_(
        DIMS,
        "d AS (SELECT i, avg(x) FILTER (label IN (0, 1, 2)) - avg(x) FILTER (label IN (7, 8, 9)) AS d FROM dims GROUP BY 1)",
        body="SELECT i - 1 AS dim, round(d / sqrt((SELECT sum(d * d) FROM d)), 9) AS value FROM d",
    ),
)
def _(spark, sf):
    e = emb(spark, sf).withColumn("labels", F.array("label"))
    c = V.concept_vector(e, "embedding", "labels", [0, 1, 2], [7, 8, 9], 25, 25)
    return rounded(c.select(F.posexplode("vector").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")), "value")


def centroids(spark, sf):
    return V.vector_means(emb(spark, sf), ["label"], "embedding")


@query("project", with_(DIMS, CENTROIDS, DV, body="SELECT vec_id, cent.label AS label, round(list_dot_product(dv.v, cent.v), 9) AS score FROM dv, cent"))
def _(spark, sf):
    out = V.project(emb(spark, sf), "vec_id", "embedding", centroids(spark, sf), "label", "embedding")
    return rounded(out, "score")


@query(
    "cosine_matrix",
    with_(
        DIMS, CENTROIDS,
        "c AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM cent a JOIN cent b ON a.label < b.label)",
        body="SELECT a, b, round(cosine, 9) AS cosine, CASE WHEN abs(cosine) < 0.15 THEN 'independent' WHEN abs(cosine) < 0.3 THEN 'weak' ELSE 'dependent' END AS relation FROM c",
    ),
)
def _(spark, sf):
    return rounded(V.cosine_matrix(centroids(spark, sf), "label", "embedding"), "cosine")


@query(
    "related",
    with_(
        DV,
        "s AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS c FROM dv a JOIN dv b ON a.vec_id <> b.vec_id)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM s)",
        body="SELECT vec_id, rank, other, round(c, 4) AS score FROM r WHERE rank <= 5",
    ),
)
def _(spark, sf):
    out = V.related(emb(spark, sf), "vec_id", "embedding", 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("related_approximate")
def _(spark, sf):
    return V.related_approximate(emb(spark, sf), "vec_id", "embedding", 5)


@query(
    "search",
    with_(
        DIMS, CENTROIDS, DV,
        "s AS (SELECT cent.label AS query_id, dv.vec_id AS doc_id, list_cosine_similarity(cent.v, dv.v) AS c FROM cent, dv)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM s)",
        body="SELECT r.query_id, r.doc_id, rank, round(c, 9) AS score, substring(d.text, 1, 200) AS snippet FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 10",
    ),
)
def _(spark, sf):
    q = centroids(spark, sf).withColumnRenamed("label", "query_id")
    d = emb(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = V.search(q, d, "query_id", "doc_id", "embedding", 10)
    text = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("snippet"))
    out = hits.join(text, "doc_id", "left").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score", "snippet")
    return rounded(out, "score")


RUN = (
    DIMS, CENTROIDS, DV,
    "run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM (SELECT cent.label AS query_id, dv.vec_id AS doc_id, list_cosine_similarity(cent.v, dv.v) AS c FROM cent, dv))",
    "qrels AS (SELECT cent.label AS query_id, vec_id AS doc_id, CASE WHEN dv.label = cent.label THEN 2 WHEN abs(dv.label - cent.label) = 1 THEN 1 ELSE 0 END AS grade FROM cent, dv WHERE abs(dv.label - cent.label) <= 2)",
    "j AS (SELECT q.query_id, q.grade, run.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY q.grade DESC, q.doc_id) AS ideal FROM qrels q JOIN run USING (query_id, doc_id))",
    """m AS (SELECT query_id, count(*) FILTER (grade > 0 AND rank <= 5) / 5.0 AS p5, count(*) FILTER (grade > 0 AND rank <= 10) / 10.0 AS pk,
        count(*) FILTER (grade > 0 AND rank <= 10) / count(*) FILTER (grade > 0) AS rk, 1.0 / min(rank) FILTER (grade > 0) AS mrr,
        coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) / sum((pow(2, grade) - 1) / log2(ideal + 1)) FILTER (ideal <= 10) AS ndcg FROM j GROUP BY 1)""",
)


def run_and_qrels(spark, sf, flip=False):
    c = centroids(spark, sf).withColumnRenamed("label", "query_id")
    e = emb(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    gap = F.abs(F.col("label") - F.col("query_id"))
    # One row of labels for each of the few queries of a label: an equi-join over neighbouring labels.
    near = c.select("query_id", F.explode(F.sequence(F.col("query_id") - 2, F.col("query_id") + 2)).alias("label"))
    q = e.select("doc_id", "label").join(near, "label")
    q = q.select("query_id", "doc_id", F.when(gap == 0, 2).when(gap == 1, 1).otherwise(0).alias("grade"))
    return R.judged_ranks(c, e, q, vector="embedding", sign=-1.0 if flip else 1.0), q


COLS = ", ".join(f"round({m}, 9) AS {m}" for m in R.METRICS)


@query("ir_metrics", with_(*RUN, body=f"SELECT query_id, {COLS} FROM m"))
def _(spark, sf):
    return rounded(R.ir_metrics(*run_and_qrels(spark, sf)), *R.METRICS)


def topics(q):
    return q.select("query_id").distinct().select(
        "query_id", F.when(F.col("query_id") % 3 == 0, "factual").when(F.col("query_id") % 3 == 1, "topical").otherwise("semantic").alias("tier"),
        F.when(F.col("query_id") % 2 == 0, "people").otherwise("places").alias("dimension"),
    )


TIERS = "t AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'topical' ELSE 'semantic' END AS tier, CASE query_id % 2 WHEN 0 THEN 'people' ELSE 'places' END AS dimension FROM m)"
AVGS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in R.METRICS)


@query(
    "mean_metrics",
    with_(*RUN, TIERS, body=f"SELECT 'tier' AS level, tier AS name, count(*) AS queries, {AVGS} FROM t GROUP BY 2 UNION ALL SELECT 'dimension', dimension, count(*), {AVGS} FROM t GROUP BY 2 UNION ALL SELECT 'overall', 'all', count(*), {AVGS} FROM t"),
)
def _(spark, sf):
    run, q = run_and_qrels(spark, sf)
    return rounded(R.mean_metrics(R.ir_metrics(run, q), topics(q)), *R.METRICS)


def _metrics_sql(order: str, tag: str) -> str:
    return f"""
run{tag} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id) AS rank FROM sims),
j{tag} AS (SELECT q.query_id, q.grade, r.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY q.grade DESC, q.doc_id) AS ideal FROM qrels q JOIN run{tag} r USING (query_id, doc_id)),
m{tag} AS (SELECT query_id, count(*) FILTER (grade > 0 AND rank <= 5) / 5.0 AS p5, count(*) FILTER (grade > 0 AND rank <= 10) / 10.0 AS pk,
 count(*) FILTER (grade > 0 AND rank <= 10) / count(*) FILTER (grade > 0) AS rk, 1.0 / min(rank) FILTER (grade > 0) AS mrr,
 coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) / sum((pow(2, grade) - 1) / log2(ideal + 1)) FILTER (ideal <= 10) AS ndcg FROM j{tag} GROUP BY 1),
t{tag} AS (SELECT unnest([['tier', CASE query_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'topical' ELSE 'semantic' END], ['dimension', CASE query_id % 2 WHEN 0 THEN 'people' ELSE 'places' END], ['overall', 'all']]) AS g, m{tag}.* FROM m{tag}),
u{tag} AS (SELECT g[1] AS level, g[2] AS name, unnest(['p5', 'pk', 'rk', 'mrr', 'ndcg']) AS metric, unnest([avg(p5), avg(pk), avg(rk), avg(mrr), avg(ndcg)]) AS v FROM t{tag} GROUP BY g)"""


@query(
    "compare_runs",
    with_(
        DIMS, CENTROIDS, DV,
        "sims AS (SELECT cent.label AS query_id, dv.vec_id AS doc_id, list_cosine_similarity(cent.v, dv.v) AS c FROM cent, dv)",
        "qrels AS (SELECT cent.label AS query_id, vec_id AS doc_id, CASE WHEN dv.label = cent.label THEN 2 WHEN abs(dv.label - cent.label) = 1 THEN 1 ELSE 0 END AS grade FROM cent, dv WHERE abs(dv.label - cent.label) <= 2)",
        _metrics_sql("c DESC", "a"), _metrics_sql("c", "b"),
        body="""SELECT a.level, a.name, a.metric, round(b.v - a.v, 9) AS delta, CASE WHEN b.v - a.v > 0.001 THEN 'better' WHEN b.v - a.v < -0.001 THEN 'worse' ELSE 'same' END AS verdict
        FROM ua a JOIN ub b USING (level, name, metric)""",
    ),
)
def _(spark, sf):
    run, q = run_and_qrels(spark, sf)
    worse, _ = run_and_qrels(spark, sf, flip=True)
    t = topics(q)
    out = R.compare_runs(R.mean_metrics(R.ir_metrics(run, q), t), R.mean_metrics(R.ir_metrics(worse, q), t))
    return rounded(out, "delta")


@query("kmeans")
def _(spark, sf):
    out, _ = V.kmeans(emb(spark, sf), "vec_id", "embedding", 8, restarts=5)
    return rounded(out.select("vec_id", "cluster", "distance2"), "distance2", dp=6)


@query("elbow")
def _(spark, sf):
    return rounded(V.elbow(emb(spark, sf), "embedding", range(1, 10)), "inertia", dp=4)


@query("pca_dimensions")
def _(spark, sf):
    scores, _ = V.pca_dimensions(emb(spark, sf), "vec_id", "embedding", 10)
    return rounded(scores, "score", dp=6)


# Components have no SQL of their own; these statements about the report hold for any table.
@query(
    "component_report",
    with_(
        DIMS,
        "t AS (SELECT count(DISTINCT label) AS concepts, least(20, count(*)) AS ends FROM embeddings)",
        body="""SELECT c.component, 1.0 AS length, 0.0 AS slant, true AS falling, true AS adds_up, ends AS n_top, ends AS n_bottom, concepts AS n_concepts,
        true AS cosines_fit, true AS ends_fit, true AS share_fits FROM t, generate_series(0, 9) AS c(component)""",
    ),
)
def _(spark, sf):
    e = emb(spark, sf)
    scores, comps = V.pca_dimensions(e, "vec_id", "embedding", 10)
    cents = centroids(spark, sf)
    report = V.component_report(scores, comps, cents.select(F.col("label").alias("name"), F.col("embedding").alias("vector")), "vec_id")
    load = comps.select("component", "explained", "cumulative", "loadings")
    other = load.select(F.col("component").alias("o"), F.col("loadings").alias("lo"))
    # Ten rows on both sides.
    slant = load.join(other, F.col("component") <= F.col("o")).select("component", "o", V.dot(F.col("loadings"), F.col("lo")).alias("d"))
    slant = slant.groupBy("component").agg(
        F.round(F.sqrt(F.max(F.when(F.col("component") == F.col("o"), F.col("d")))), 6).alias("length"),
        F.round(F.coalesce(F.max(F.when(F.col("component") != F.col("o"), F.abs("d"))), F.lit(0.0)), 6).alias("slant"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("component")
    order = load.select(
        "component", F.coalesce(F.col("explained") <= F.lag("explained").over(w), F.lit(True)).alias("falling"),
        (F.abs(F.col("cumulative") - F.sum("explained").over(w)) < 1e-9).alias("adds_up"), "explained",
    )
    total = e.select(F.posexplode("embedding")).groupBy("pos").agg(F.var_samp(F.col("col").cast("double")).alias("v")).agg(F.sum("v").alias("total"))
    spread_ = scores.groupBy("component").agg(F.var_samp("score").alias("var"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    at = lambda section, rank: F.max(F.when((F.col("section") == section) & (F.col("rank") == rank), F.col("value")))
    said = report.groupBy("component").agg(
        *[F.count_if(F.col("section") == x).alias(f"n_{y}") for x, y in (("top", "top"), ("bottom", "bottom"), ("concept", "concepts"))],
        (F.coalesce(F.max(F.when(F.col("section") == "concept", F.abs("value"))), F.lit(0.0)) <= 1 + 1e-9).alias("cosines_fit"), at("top", 1).alias("_t"), at("bottom", 1).alias("_b"),
    )
    out = slant.join(order, "component").join(said, "component").join(spread_, "component").crossJoin(F.broadcast(total))
    return out.select(
        F.col("component").cast("long").alias("component"), "length", "slant", "falling", "adds_up", "n_top", "n_bottom", "n_concepts", "cosines_fit",
        ((F.col("_t") == F.col("hi")) & (F.col("_b") == F.col("lo"))).alias("ends_fit"), (F.abs(F.col("var") / F.col("total") - F.col("explained")) < 1e-6).alias("share_fits"),
    )


@query("pca_2d")
def _(spark, sf):
    from missiva.operators.lexical import tfidf
    from missiva.operators.scores import axis_normalize

    w = tfidf(X.letters(spark, sf), "id", "text")
    return axis_normalize(V.pca_long(w, "id", "token", "weight", 2), ["pc1", "pc2"])


@query(
    "seed_pole_check",
    with_(
        DIMS,
        "d AS (SELECT i, avg(x) FILTER (label IN (0, 1, 2)) - avg(x) FILTER (label IN (7, 8, 9)) AS d FROM dims GROUP BY 1)",
        "s AS (SELECT vec_id, any_value(label) AS label, sum(x * d / (SELECT sqrt(sum(d * d)) FROM d)) AS score FROM dims JOIN d USING (i) GROUP BY 1)",
        body="""SELECT CASE WHEN label <= 2 THEN 'pos' WHEN label >= 7 THEN 'neg' ELSE 'none' END AS pole, count(*) AS n, round(avg(score), 9) AS mean,
        round(stddev_pop(score), 9) AS sd, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 9) AS positive_share FROM s GROUP BY 1""",
    ),
)
def _(spark, sf):
    e = emb(spark, sf)
    c = V.concept_vector(e.withColumn("labels", F.array("label")), "embedding", "labels", [0, 1, 2], [7, 8, 9])
    s = V.project(e, "vec_id", "embedding", c.withColumn("name", F.lit("identity"))).join(e.select("vec_id", "label"), "vec_id")
    pole = F.when(F.col("label") <= 2, "pos").when(F.col("label") >= 7, "neg").otherwise("none")
    return rounded(V.seed_pole_check(s.withColumn("pole", pole), "pole", "score"), "mean", "sd", "positive_share")


PROFILE = """
a AS (SELECT e.label AS cluster, d.id, d.date, d.sender, d.recipient, length(d.text) / 1000.0 AS mean, (e.embedding[1]::DOUBLE + 1) AS distance2 FROM embeddings e JOIN letters d ON d.id = e.vec_id),
s AS (SELECT cluster, count(*) AS size, round(avg(mean), 1) AS mean_score, min(year(date)) AS year_min, max(year(date)) AS year_max,
      list_sort(list(year(date)))[count(*) // 2 + 1] AS median_year FROM a GROUP BY 1),
ts AS (SELECT cluster, arg_min(sender, (-k, sender)) AS top_sender FROM (SELECT cluster, sender, count(*) AS k FROM a GROUP BY 1, 2) GROUP BY 1),
tr AS (SELECT cluster, arg_min(recipient, (-k, recipient)) AS top_recipient FROM (SELECT cluster, recipient, count(*) AS k FROM a GROUP BY 1, 2) GROUP BY 1),
nn AS (SELECT cluster, string_agg(id::VARCHAR, '|' ORDER BY distance2, id) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance2, id) AS r FROM a) WHERE r <= 3 GROUP BY 1)"""


@query(
    "cluster_profile",
    with_(
        LETTERS, PROFILE,
        body="""SELECT s.cluster, size, mean_score, year_min, year_max, median_year, top_sender, top_recipient, nearest,
        CASE WHEN median_year < 2021 THEN 'early' WHEN mean_score < 5 THEN 'late, short' ELSE 'late' END || ' (' || year_min || '-' || year_max || ')' AS label
        FROM s JOIN ts USING (cluster) JOIN tr USING (cluster) JOIN nn USING (cluster)""",
    ),
)
def _(spark, sf):
    e = emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), (F.element_at("embedding", 1).cast("double") + 1).alias("distance2"))
    m = X.letters(spark, sf).select("id", "date", "sender", "recipient", (F.length("text") / 1000.0).alias("mean"))
    rules = ((None, 2021, None, None, "early"), (2021, None, None, 5, "late, short"), (2021, None, None, None, "late"))
    out = V.cluster_label(V.cluster_profile(e, m, "id"), rules)
    return out.withColumns({c: F.col(c).cast("long") for c in ("year_min", "year_max", "median_year")})


@query("concept_contexts")
def _(spark, sf):
    terms = spark.createDataFrame([(t,) for t in ("the", "tion", "le", "und", "par")], "term string")
    s = X.sents(spark, sf).select((F.col("id") * 100000 + F.col("idx")).alias("sid"), "id", "sentence")
    e = emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    vec = s.join(e, "id").select("sid", "vector")
    have = s.join(e.select("id"), "id", "left_semi").select("sid", "sentence")
    centre, near = V.concept_contexts(terms, have, vec, "sid")
    return near.join(centre.select("term", "sentence"), "term").select("term", "rank", "other", "score", "sentence")
