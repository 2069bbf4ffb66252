"""Co-mention network queries: suppliers named together in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.operators import graph as G
from missiva.operators import series as S
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import MENTIONS, rounded, with_
from missiva.session import pin

PAIRS = """
one AS (SELECT doc, id, min(year(date)) AS year FROM mentions GROUP BY 1, 2),
py AS (SELECT a.id AS a, b.id AS b, a.year, count(*) AS weight FROM one a JOIN one b ON a.doc = b.doc AND a.id < b.id GROUP BY 1, 2, 3),
edges AS (SELECT a, b, sum(weight)::BIGINT AS weight FROM py GROUP BY 1, 2 HAVING sum(weight) >= 2)"""


def pairs(spark, sf, **kw):
    return G.pair_years(X.mentions(spark, sf), **kw)


def nodes(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))


@query(
    "comention_edges",
    with_(
        MENTIONS, PAIRS,
        "yl AS (SELECT a, b, string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR) AS years FROM py GROUP BY 1, 2)",
        body="SELECT e.a, e.b, weight, years FROM edges e JOIN yl ON yl.a = e.a AND yl.b = e.b",
    ),
)
def _(spark, sf):
    e = G.comention_edges(pairs(spark, sf))
    return e.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), "|"))


@query("comention_edges_heavy_documents", with_(MENTIONS, PAIRS, body="SELECT a, b, weight FROM edges"))
def _(spark, sf):
    # Orders of more than three suppliers take the large-document route.
    return G.comention_edges(pairs(spark, sf, heavy=3)).select("a", "b", "weight")


@query("excluded_weight", with_(MENTIONS, PAIRS, body="SELECT count(*) AS raw_weight FROM one a JOIN one b ON a.doc = b.doc WHERE a.id = 1 AND b.id = 2"))
def _(spark, sf):
    return G.excluded_weight(X.mentions(spark, sf), 1, 2)


@query(
    "degree_centrality",
    with_(
        MENTIONS, PAIRS,
        "d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1)",
        body="SELECT s_suppkey AS id, coalesce(k, 0) AS degree, round(coalesce(k, 0) / ((SELECT count(*) FROM supplier) - 1), 9) AS centrality FROM supplier LEFT JOIN d ON d.id = s_suppkey",
    ),
)
def _(spark, sf):
    return rounded(G.degree_centrality(nodes(spark, sf), G.comention_edges(pairs(spark, sf))), "centrality")


@query(
    "graph_summary",
    with_(
        MENTIONS, PAIRS,
        "n AS (SELECT count(*) AS n FROM supplier)", "m AS (SELECT count(*) AS m FROM edges)",
        body="SELECT n AS nodes, m AS edges, round(2 * m / n, 9) AS average_degree, round(2 * m / (n * (n - 1)), 9) AS density FROM n, m",
    ),
)
def _(spark, sf):
    out = G.graph_summary(nodes(spark, sf), G.comention_edges(pairs(spark, sf)), with_components=False)
    return rounded(out, "average_degree", "density")




@query(
    "components",
    """WITH RECURSIVE e AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 + x.c_nationkey AND y.c_mktsegment = x.c_mktsegment),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT c_custkey AS id, c_custkey AS r FROM customer UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
    SELECT id, min(r) AS component FROM reach GROUP BY 1""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    own = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("b"), "c_mktsegment")
    e = own.join(c.select(F.col("c_custkey").alias("b"), "c_mktsegment"), ["b", "c_mktsegment"]).select("a", "b")
    n = c.select(F.col("c_custkey").alias("id"))
    return G.components(n, e)


ARCS = """
arcs AS (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
steps AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM arcs),
nn AS (SELECT s_suppkey AS id, count(*) OVER () AS n, s_suppkey NOT IN (SELECT src FROM arcs) AS dangling FROM supplier),
pr AS (
  SELECT id, n, dangling, CAST(1.0 AS DOUBLE) / n AS r, CAST(NULL AS DOUBLE) AS old, 0 AS k FROM nn
  UNION ALL
  SELECT a.id, a.n, a.dangling, 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(r) FILTER (dangling), 0) FROM pr) / a.n) + 0.15 / a.n, a.r, a.k + 1
  FROM pr a LEFT JOIN (SELECT dst, sum(p * r) AS x FROM steps JOIN pr ON id = src GROUP BY 1) g ON g.dst = a.id
  WHERE a.k < 100 AND coalesce((SELECT sum(abs(r - old)) FROM pr), 1e9) >= a.n * 1e-6),
ranks AS (SELECT id, r FROM pr WHERE k = (SELECT max(k) FROM pr))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("pagerank", recursive(with_(MENTIONS, PAIRS, ARCS, body="SELECT id, round(r, 9) AS pagerank FROM ranks")))
def _(spark, sf):
    return rounded(G.pagerank(nodes(spark, sf), G.comention_edges(pairs(spark, sf))), "pagerank")


@query("betweenness")
def _(spark, sf):
    return rounded(G.betweenness(nodes(spark, sf), G.comention_edges(pairs(spark, sf))), "betweenness")


@query("betweenness_sampled")
def _(spark, sf):
    return rounded(G.betweenness_sampled(nodes(spark, sf), G.comention_edges(pairs(spark, sf)), 0.2), "betweenness")


@query(
    "temporal_slices",
    with_(
        MENTIONS, PAIRS,
        "a AS (SELECT year(date) AS year, count(DISTINCT id) AS num_nodes FROM mentions GROUP BY 1)",
        "f AS (SELECT y AS year, count(*) AS new_nodes FROM (SELECT id, min(year(date)) AS y FROM mentions GROUP BY 1) GROUP BY 1)",
        "g AS (SELECT year, count(*) AS num_edges FROM py JOIN edges USING (a, b) GROUP BY 1)",
        body="""SELECT a.year, num_nodes, coalesce(new_nodes, 0) AS new_nodes, coalesce(num_edges, 0) AS num_edges,
        round(CASE WHEN num_nodes > 1 THEN 2 * coalesce(num_edges, 0) / (num_nodes * (num_nodes - 1)) ELSE 0 END, 9) AS density FROM a LEFT JOIN f USING (year) LEFT JOIN g USING (year)""",
    ),
)
def _(spark, sf):
    out = G.temporal_slices(X.mentions(spark, sf), pairs(spark, sf))
    return rounded(out.withColumn("year", F.col("year").cast("long")), "density")


@query(
    "ego_network",
    with_(
        MENTIONS, PAIRS,
        "y AS (SELECT DISTINCT a, b FROM py WHERE year = 1997)", "e AS (SELECT edges.* FROM edges JOIN y USING (a, b))",
        "n AS (SELECT 5 AS id UNION SELECT b FROM e WHERE a = 5 UNION SELECT a FROM e WHERE b = 5)",
        body="SELECT a, b, weight FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)",
    ),
)
def _(spark, sf):
    return G.ego_network(G.comention_edges(pairs(spark, sf)), 5, 1997).select("a", "b", "weight")


@query(
    "top_subgraph",
    recursive(with_(
        MENTIONS, PAIRS, ARCS,
        "t AS (SELECT id FROM ranks ORDER BY r DESC, id LIMIT 20)",
        body="SELECT a, b, weight FROM edges WHERE a IN (SELECT id FROM t) AND b IN (SELECT id FROM t)",
    )),
)
def _(spark, sf):
    # Ranked and cut out of the same edges.
    e = pin(G.comention_edges(pairs(spark, sf)))
    return G.top_subgraph(G.pagerank(nodes(spark, sf), e), e).select("a", "b", "weight")


TOP = """
sym AS (SELECT a AS id, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
top AS (SELECT id, other, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS rank FROM sym)"""


@query("connections", with_(MENTIONS, PAIRS, TOP, body="SELECT id, other, weight, rank FROM top WHERE rank <= 10"))
def _(spark, sf):
    out = S.top_connections(G.comention_edges(pairs(spark, sf)))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "entity_pages",
    with_(
        MENTIONS, PAIRS, TOP,
        "docs AS (SELECT id, doc, min(date) AS date FROM mentions GROUP BY 1, 2)",
        body="""SELECT s_suppkey AS id, 'attributes' AS section, s_name AS item, NULL::DATE AS date, count(doc)::DOUBLE AS value FROM supplier LEFT JOIN docs ON docs.id = s_suppkey GROUP BY 1, 3
        UNION ALL SELECT id, 'document', doc::VARCHAR, date, NULL FROM docs
        UNION ALL SELECT id, 'connection', other::VARCHAR, NULL, weight FROM top WHERE rank <= 10""",
    ),
)
def _(spark, sf):
    m = X.mentions(spark, sf)
    docs = m.select("id", F.col("doc").alias("doc_id"), "date")
    n = docs.groupBy("id").agg(F.countDistinct("doc_id").alias("letter_count"))
    ent = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical")).join(n, "id", "left").na.fill(0, ["letter_count"])
    return G.entity_pages(ent, docs, G.comention_edges(pairs(spark, sf)))
