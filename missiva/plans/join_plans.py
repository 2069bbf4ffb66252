"""Merges, cascades, range, spatial and reference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.operators import joins as J
from missiva.operators import spatial as G
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import BASE, LETTERS, SENTS, rounded, with_

FOLD_PLACE = (
    "replace(translate(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), 'àáâãäèéêëìíîïòóôõöùúûüýÿñżźśćłęń', 'aaaaaeeeeiiiiooooouuuuyynzzsclen'), 'ß', 'ss')"
)


@query(
    "attach_scores",
    with_(*BASE, body="SELECT l.id, l.sender, round(d.mean, 9) AS mean, q.quality FROM letters l JOIN doc_scores d ON d.id = l.id LEFT JOIN labels q ON q.doc_id = l.id"),
)
def _(spark, sf):
    lt = X.letters(spark, sf).select("id", "sender")
    inner = J.attach_scores(lt, X.doc_scores(spark, sf).select("id", "mean"), how="inner")
    q = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return rounded(J.attach_scores(inner, q), "mean")


@query(
    "map_children_to_parent",
    """SELECT 'mapped' AS kind, q.quality AS quality, count(*) AS n FROM documents d JOIN labels q USING (doc_id) GROUP BY 2
    UNION ALL SELECT 'unmapped', NULL, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    good, lost = J.map_children_to_parent(docs, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    a = good.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).select(F.lit("mapped").alias("kind"), "quality", "n")
    return a.unionByName(lost.select(F.lit("unmapped").alias("kind"), F.lit(None).cast("int").alias("quality"), F.col("unmapped").alias("n")))


@query(
    "outer_merge",
    """WITH c AS (SELECT user_id AS id, avg(value) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
    e AS (SELECT user_id AS id, avg(value) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT id, round(clicks, 9) AS clicks, round(errors, 9) AS errors FROM c FULL JOIN e USING (id)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    side = lambda t, n: e.filter(F.col("event_type") == t).groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias(n))
    return rounded(J.outer_merge(side("click", "clicks"), side("error", "errors"), "id"), "clicks", "errors")


@query(
    "priority_merge",
    """SELECT d.doc_id, coalesce(nullif(CASE WHEN q.quality = 1 THEN 'curated' ELSE '' END, ''), nullif(p.url, ''), nullif(b.text, '')) AS best
    FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def _(spark, sf):
    base = table(spark, sf, "documents").select("doc_id")
    q = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "curated").otherwise("").alias("v"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return J.priority_merge(base, [(q, "v"), (p, "url"), (b, "text")], "doc_id", "best")


def _registry(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("letter_count"), F.min("o_orderdate").cast("date").alias("first_mention")
    )
    return c.join(n, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical"), F.array("c_name", F.upper("c_name")).alias("aliases"),
        F.lit("unknown").alias("role"), "letter_count", "first_mention",
    )


REGISTRY = """
counts AS (SELECT o_custkey AS id, count(*) AS letter_count, CAST(min(o_orderdate) AS DATE) AS first_mention FROM orders GROUP BY 1),
registry AS (SELECT c_custkey AS id, c_name AS canonical, [c_name, upper(c_name)] AS aliases, 'unknown' AS role, letter_count, first_mention
             FROM customer LEFT JOIN counts ON counts.id = c_custkey)"""


@query(
    "overlay_merge",
    with_(
        REGISTRY,
        "curated AS (SELECT s_suppkey * 3 AS id, s_name AS canonical, [s_name, 'x'] AS aliases, NULL::VARCHAR AS role FROM supplier)",
        "manual AS (SELECT n_nationkey * 100 AS id, n_name AS canonical, [n_name] AS aliases, 'manual' AS role FROM nation)",
        body="""SELECT r.id, coalesce(c.canonical, r.canonical) AS canonical, coalesce(c.role, r.role) AS role, letter_count,
        array_to_string(list_concat(r.aliases, coalesce(c.aliases, [])), '|') AS aliases FROM registry r LEFT JOIN curated c ON c.id = r.id
        UNION ALL SELECT id, canonical, role, NULL, array_to_string(aliases, '|') FROM manual WHERE id NOT IN (SELECT id FROM registry)""",
    ),
)
def _(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    curated = s.select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("canonical"),
                       F.array(F.col("s_name"), F.lit("x")).alias("aliases"), F.lit(None).cast("string").alias("role"))
    manual = n.select((F.col("n_nationkey") * 100).cast("long").alias("id"), F.col("n_name").alias("canonical"),
                      F.array("n_name").alias("aliases"), F.lit("manual").alias("role"))
    out = J.overlay_merge(_registry(spark, sf), curated, manual, ["canonical", "role"])
    return out.select("id", "canonical", "role", "letter_count", F.array_join("aliases", "|").alias("aliases"))


@query(
    "split_curated",
    with_(
        REGISTRY,
        "r AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'curated' END AS note FROM registry)",
        body="""SELECT 'human' AS part, id, note FROM r WHERE NOT (coalesce(letter_count, 0) = 0 AND first_mention IS NULL) AND note IS NOT NULL
        UNION ALL SELECT 'manual', id, note FROM r WHERE coalesce(letter_count, 0) = 0 AND first_mention IS NULL""",
    ),
)
def _(spark, sf):
    r = _registry(spark, sf).withColumn("note", F.when(F.col("id") % 7 == 0, "curated"))
    human, manual = J.split_curated(r, ["note"])
    return human.select(F.lit("human").alias("part"), "id", "note").unionByName(manual.select(F.lit("manual").alias("part"), "id", "note"))


@query(
    "resolve_aliases",
    """WITH m AS (SELECT o_orderkey % 997 AS doc, 'CUSTOMER#' || lpad((o_custkey * 2)::VARCHAR, 9, '0') AS name FROM orders)
    SELECT DISTINCT doc, c_custkey AS id FROM m JOIN customer ON lower(c_name) = lower(name)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 997).alias("doc"),
        F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("name"),
    )
    reg = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical"), F.array(F.lower("c_name")).alias("aliases"))
    return J.resolve_aliases(o, reg, "doc", "name", "ord")


LP = """
lp AS (SELECT p_partkey AS ord, p_name || ' ' || p_size || ' (' || p_brand || ', ' || lower(p_type) || ')' AS name FROM part),
gp AS (SELECT row_number() OVER (ORDER BY p_name, p_size) AS gid, * FROM (SELECT DISTINCT p_name, p_size FROM part)),
gn AS (SELECT gid, CASE gid % 5 WHEN 0 THEN upper(p_name) || ' ' || p_size WHEN 1 THEN 'Ny ' || p_name || ' (' || p_name || ' ' || p_size || ')'
   WHEN 2 THEN p_name || ' ' || p_size || ' øst' WHEN 3 THEN 'zz' || gid ELSE substring(p_name, 1, 5) END AS gname, p_name || ' ' || p_size || ' (Brand#2, economy)' AS al FROM gp)"""


def _cascade_inputs(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    right = p.select(
        F.col("p_partkey").alias("ord"),
        F.concat("p_name", F.lit(" "), size, F.lit(" ("), "p_brand", F.lit(", "), F.lower("p_type"), F.lit(")")).alias("name"),
    )
    from missiva.operators.scale import number_rows

    g = number_rows(p.select("p_name", "p_size").distinct(), [], ["p_name", "p_size"], "gid")
    k = F.col("gid") % 5
    gname = (
        F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" "), size))
        .when(k == 1, F.concat(F.lit("Ny "), "p_name", F.lit(" ("), "p_name", F.lit(" "), size, F.lit(")")))
        .when(k == 2, F.concat("p_name", F.lit(" "), size, F.lit(" øst")))
        .when(k == 3, F.concat(F.lit("zz"), F.col("gid").cast("string")))
        .otherwise(F.substring("p_name", 1, 5))
    )
    left = g.select("gid", gname.alias("gname"), F.array(F.concat("p_name", F.lit(" "), size, F.lit(" (Brand#2, economy)"))).alias("aliases"))
    return left, right


@query(
    "cascade_match",
    with_(
        LP.strip(),
        f"r AS (SELECT ord, name, {FOLD_PLACE.format('name')} AS f FROM lp)",
        "rb AS (SELECT *, trim(regexp_replace(f, '\\s*\\(.*', '')) AS b, regexp_extract(f, '\\(([^)]+)\\)', 1) AS paren FROM r)",
        f"l AS (SELECT gid, {FOLD_PLACE.format('gname')} AS f, {FOLD_PLACE.format('al')} AS al FROM gn)",
        "lb AS (SELECT *, trim(regexp_replace(f, '\\s*\\(.*', '')) AS b, regexp_extract(f, '\\(([^)]+)\\)', 1) AS paren FROM l)",
        "rc AS (SELECT DISTINCT ord, name, c FROM (SELECT ord, name, unnest(list_prepend(b, list_transform(string_split(paren, ','), lambda x: trim(x)))) AS c FROM rb) WHERE length(c) > 2)",
        "lc AS (SELECT DISTINCT gid, c FROM (SELECT gid, unnest(list_prepend(b, list_transform(string_split(paren, ','), lambda x: trim(x)))) AS c FROM lb) WHERE length(c) > 2)",
        """hits AS (SELECT gid, 1 AS p, ord, name FROM lb JOIN rb ON lb.f = rb.f
           UNION ALL SELECT gid, 2, ord, name FROM lb JOIN rb ON lb.b = rb.b WHERE length(lb.b) > 2
           UNION ALL SELECT gid, 3, ord, name FROM lc JOIN rc ON lc.c = rc.c
           UNION ALL SELECT gid, 4, ord, name FROM lb JOIN rb ON length(lb.b) > 3 AND length(rb.b) > 3 AND (starts_with(lb.b, rb.b) OR starts_with(rb.b, lb.b))
           UNION ALL SELECT gid, 5, ord, name FROM lb JOIN rb ON lb.al = rb.f)""",
        body="""SELECT gid, m.p AS pass_no, m.n AS matched FROM (SELECT gid, min({'p': p, 'o': ord, 'n': name}) AS m FROM hits GROUP BY 1)""",
    ),
)
def _(spark, sf):
    left, right = _cascade_inputs(spark, sf)
    return J.cascade_match(left, right, "gid", "gname", "name", "ord", "aliases")


@query(
    "match_by_slug_or_alias",
    with_(
        LETTERS,
        "pl AS (SELECT i AS place_id, CASE WHEN i % 3 = 0 THEN 'Place ' || i WHEN i % 3 = 1 THEN 'PLACE-' || i ELSE 'Sted ' || i END AS place, ['Place ' || i] AS aliases FROM (SELECT n_nationkey AS i FROM nation))",
        "slug AS (SELECT place_id, regexp_replace(lower(place), '[^a-z0-9]+', '_', 'g') AS s, place, aliases[1] AS al FROM pl)",
        body="SELECT DISTINCT place_id, id AS doc_id, date FROM letters l JOIN slug s ON l.place = s.place OR l.place = s.al OR regexp_replace(lower(l.place), '[^a-z0-9]+', '_', 'g') = s.s",
    ),
)
def _(spark, sf):
    i = F.col("n_nationkey")
    txt = i.cast("string")
    name = F.when(i % 3 == 0, F.concat(F.lit("Place "), txt)).when(i % 3 == 1, F.concat(F.lit("PLACE-"), txt)).otherwise(F.concat(F.lit("Sted "), txt))
    pl = table(spark, sf, "nation").select(i.alias("place_id"), name.alias("place"), F.array(F.concat(F.lit("Place "), txt)).alias("aliases"))
    return J.match_by_slug_or_alias(pl, X.letters(spark, sf))


def _battles(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    start = F.date_add(F.lit("2020-01-01").cast("date"), ((k * 31) % 1460).cast("int"))
    return o.select(k.alias("event_id"), start.alias("start"), F.date_add(start, (k % 5).cast("int")).alias("end"))


BATTLES = """
battles AS (SELECT o_orderkey AS event_id, DATE '2020-01-01' + CAST((o_orderkey * 31) % 1460 AS INTEGER) AS s,
  DATE '2020-01-01' + CAST((o_orderkey * 31) % 1460 AS INTEGER) + CAST(o_orderkey % 5 AS INTEGER) AS e FROM orders)"""


@query(
    "event_window_stats",
    with_(
        *BASE, BATTLES,
        "daily AS (SELECT date AS d, sum(mean) AS sm, count(mean) AS c FROM dated GROUP BY 1)",
        """w AS (SELECT event_id, sum(CASE WHEN s - d BETWEEN 1 AND 14 THEN sm END) AS sb, coalesce(sum(CASE WHEN s - d BETWEEN 1 AND 14 THEN c END), 0) AS cb,
             sum(CASE WHEN d - e BETWEEN 0 AND 30 THEN sm END) AS sa, coalesce(sum(CASE WHEN d - e BETWEEN 0 AND 30 THEN c END), 0) AS ca
           FROM battles LEFT JOIN daily ON d BETWEEN s - 14 AND e + 30 GROUP BY 1)""",
        body="""SELECT event_id, round(sb / nullif(cb, 0), 9) AS before_mean, round(sa / nullif(ca, 0), 9) AS after_mean, cb::BIGINT AS before_count, ca::BIGINT AS after_count,
        round(sa / nullif(ca, 0) - sb / nullif(cb, 0), 9) AS delta FROM w""",
    ),
)
def _(spark, sf):
    out = J.event_window_stats(_battles(spark, sf), X.dated_scores(spark, sf), "mean")
    return rounded(out, "before_mean", "after_mean", "delta")


def _located(spark, sf):
    from missiva.functions.geo import parse_location

    p = parse_location(F.col("location"))
    return X.letters(spark, sf).select("id", "date", "place", p["lat"].alias("lat"), p["lng"].alias("lng"))


LOCATED = "located AS (SELECT id, date, place, split_part(location, ',', 1)::DOUBLE AS lat, split_part(location, ',', 2)::DOUBLE AS lng FROM letters)"
GEO_EVENTS = """
geo_events AS (SELECT s_suppkey AS event_id, DATE '2020-01-01' + CAST((s_suppkey * 37) % 1460 AS INTEGER) AS s,
  DATE '2020-01-01' + CAST((s_suppkey * 37) % 1460 AS INTEGER) + CAST(s_suppkey % 4 AS INTEGER) AS e,
  ((s_nationkey * 37) % 120 - 60) + (s_suppkey % 9) / 10.0::DOUBLE AS lat, ((s_nationkey * 53) % 300 - 150) - (s_suppkey % 7) / 10.0::DOUBLE AS lng FROM supplier)"""
KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


def _geo_events(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    start = F.date_add(F.lit("2020-01-01").cast("date"), ((k * 37) % 1460).cast("int"))
    return table(spark, sf, "supplier").select(
        k.alias("event_id"), start.alias("start"), F.date_add(start, (k % 4).cast("int")).alias("end"),
        ((n * 37) % 120 - 60 + (k % 9) / 10.0).alias("lat"), ((n * 53) % 300 - 150 - (k % 7) / 10.0).alias("lng"),
    )


@query(
    "spacetime_join",
    with_(
        LETTERS, LOCATED, GEO_EVENTS,
        f"""p AS (SELECT a.id, b.event_id, {KM} AS km, CASE WHEN a.date BETWEEN b.s AND b.e THEN 0 ELSE least(abs(a.date - b.s), abs(a.date - b.e)) END AS gap
            FROM located a, geo_events b)""",
        body="SELECT id, event_id, round(km, 5) AS km, gap::BIGINT AS day_gap FROM p WHERE km <= 100 AND gap <= 60",
    ),
)
def _(spark, sf):
    out = G.spacetime_join(_located(spark, sf), _geo_events(spark, sf), "id", "event_id", 100.0, 60)
    return rounded(out.withColumn("day_gap", F.col("day_gap").cast("long")), "km", dp=5)


@query(
    "proximity_join",
    with_(
        GEO_EVENTS,
        "pts AS (SELECT c_custkey AS cust, ((c_nationkey * 37) % 120 - 60)::DOUBLE AS lat, ((c_nationkey * 53) % 300 - 150)::DOUBLE AS lng FROM customer)",
        f"p AS (SELECT a.cust, b.event_id, {KM} AS km FROM pts a, geo_events b)",
        body="SELECT cust, event_id, round(km, 5) AS km FROM p WHERE km <= 70",
    ),
)
def _(spark, sf):
    n = F.col("c_nationkey")
    pts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"), ((n * 37) % 120 - 60).cast("double").alias("lat"), ((n * 53) % 300 - 150).cast("double").alias("lng")
    )
    return G.proximity_pairs(pts, _geo_events(spark, sf), "cust", "event_id", 70.0, dp=5)


@query(
    "point_in_polygon",
    with_(
        GEO_EVENTS,
        "boxes AS (SELECT r_regionkey AS rk, r_name, -150 + r_regionkey * 60 AS x0, -150 + r_regionkey * 60 + 50 AS x1, -40 AS y0, 45 AS y1 FROM region)",
        body="SELECT event_id, coalesce(r_name, 'Unknown') AS r_name FROM geo_events g LEFT JOIN boxes b ON g.lng >= x0 AND g.lng < x1 AND g.lat >= y0 AND g.lat < y1",
    ),
)
def _(spark, sf):
    k = F.col("r_regionkey")
    x0, x1 = -150.0 + k * 60, -100.0 + k * 60
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("lng") if not hasattr(x, "alias") else x.cast("double").alias("lng"), F.lit(float(y)).alias("lat"))
    ring = F.array(pt(x0, -40), pt(x1, -40), pt(x1, 45), pt(x0, 45), pt(x0, -40))
    polys = table(spark, sf, "region").select("r_name", F.array(ring).alias("rings"))
    return G.point_in_polygon(_geo_events(spark, sf), polys, "event_id", "r_name", cell=5.0)


@query(
    "gazetteer_match",
    with_(
        "pl AS (SELECT c_custkey AS place_id, 'Town ' || c_nationkey AS place, ((c_nationkey * 37) % 120 - 60)::DOUBLE + (c_custkey % 11) / 60.0 AS lat, ((c_nationkey * 53) % 300 - 150)::DOUBLE AS lng FROM customer)",
        "gz AS (SELECT s_suppkey AS gaz_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Town ' || s_nationkey ELSE s_name END AS label, ((s_nationkey * 37) % 120 - 60)::DOUBLE + (s_suppkey % 13) / 70.0 AS lat, ((s_nationkey * 53) % 300 - 150)::DOUBLE AS lng FROM supplier)",
        f"p AS (SELECT a.place_id, a.place, b.gaz_id, b.label, {KM} AS km FROM pl a, gz b)",
        "t AS (SELECT *, CASE WHEN km <= 5 THEN 1 ELSE 2 END AS tier FROM p WHERE km <= 15)",
        "s AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.place_id = t.place_id))",
        "b AS (SELECT place_id, min({'h': CASE WHEN contains(lower(place), lower(label)) OR contains(lower(label), lower(place)) THEN 0 ELSE 1 END, 'km': round(km, 6), 'g': gaz_id, 't': tier}) AS m FROM s GROUP BY 1)",
        body="""SELECT pl.place_id, coalesce(o.gaz, b.m.g) AS gaz_id, CASE WHEN o.gaz IS NOT NULL THEN 'manual_override' WHEN b.m.t = 1 THEN 'coordinate_5km' WHEN b.m.t = 2 THEN 'coordinate_15km' ELSE 'unmatched' END AS match_method,
        CASE WHEN o.gaz IS NULL THEN round(b.m.km, 1) END AS distance_km FROM pl LEFT JOIN b ON b.place_id = pl.place_id
        LEFT JOIN (SELECT n_nationkey * 7 AS pid, n_nationkey AS gaz FROM nation) o ON o.pid = pl.place_id""",
    ),
)
def _(spark, sf):
    n, c, k, m = F.col("c_nationkey"), F.col("c_custkey"), F.col("s_suppkey"), F.col("s_nationkey")
    pl = table(spark, sf, "customer").select(
        c.alias("place_id"), F.concat(F.lit("Town "), n.cast("string")).alias("place"),
        (((n * 37) % 120 - 60).cast("double") + (c % 11) / 60.0).alias("lat"), ((n * 53) % 300 - 150).cast("double").alias("lng"),
    )
    gz = table(spark, sf, "supplier").select(
        k.alias("gaz_id"), F.when(k % 3 == 0, F.concat(F.lit("Town "), m.cast("string"))).otherwise(F.col("s_name")).alias("label"),
        (((m * 37) % 120 - 60).cast("double") + (k % 13) / 70.0).alias("lat"), ((m * 53) % 300 - 150).cast("double").alias("lng"),
    )
    over = table(spark, sf, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("place_id"), F.col("n_nationkey").cast("long").alias("gaz_id"))
    return G.gazetteer_match(pl, gz, over)


@query(
    "same_day_pairs",
    with_(
        *BASE,
        "m AS (SELECT id, strftime(date, '%Y-%m') AS date, recipient, mean, range FROM dated)",
        body="""SELECT a.date, a.id AS id_a, b.id AS id_b, round(abs(a.mean - b.mean), 9) AS mean_diff, round(abs(a.range - b.range), 9) AS range_diff
        FROM m a JOIN m b ON a.date = b.date WHERE a.recipient = 'fr' AND b.recipient = 'de'""",
    ),
)
def _(spark, sf):
    d = X.dated_scores(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM"))
    return rounded(J.same_day_pairs(d, "recipient", "fr", "de", ["mean", "range"]), "mean_diff", "range_diff")


@query(
    "attribute_bare_names",
    with_(
        """v AS (SELECT 'V' || i AS variant, CASE i WHEN 0 THEN '#000000001' WHEN 1 THEN '#000000002' ELSE '#000000003' END AS alias, i AS ord FROM (VALUES (0), (1), (2)) t(i))""",
        """mm AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date, '#' || lpad((o_custkey % 97)::VARCHAR, 9, '0') AS name FROM orders)""",
        """named AS (SELECT DISTINCT doc_id, date, variant, ord FROM mm JOIN v ON name = alias)""",
        """bare AS (SELECT doc_id, max(date) AS date, 'Customer' || max(c.c_name)[9:] AS sender FROM (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) + 1 AS date, o_custkey FROM orders) o JOIN customer c ON c_custkey = o_custkey GROUP BY 1)""",
        "sv AS (SELECT sender, arg_min(variant, ord) AS sv FROM (SELECT DISTINCT sender FROM bare) JOIN v ON contains(sender, alias) GROUP BY 1)",
        "dv AS (SELECT doc_id, count(DISTINCT variant) AS n, min(variant) AS dv FROM named GROUP BY 1)",
        "tv AS (SELECT date, count(DISTINCT variant) AS n, min(variant) AS tv, min(ord) AS o, arg_min(variant, ord) AS fv FROM named GROUP BY 1)",
        """nn AS (SELECT x.date, min({'d': abs(x.date - t.date), 'o': t.o, 'v': t.fv}) AS m FROM (SELECT DISTINCT date FROM bare) x, tv t WHERE abs(x.date - t.date) <= 400 GROUP BY 1)""",
        body="""SELECT b.doc_id, b.date, b.sender,
        CASE WHEN sv IS NOT NULL THEN sv WHEN dv.n = 1 THEN dv WHEN tv.n = 1 THEN tv WHEN nn.m.d <= 30 THEN nn.m.v END AS assigned_to,
        CASE WHEN sv IS NOT NULL THEN 0.95 WHEN dv.n = 1 THEN 0.7 WHEN tv.n = 1 THEN 0.5 WHEN nn.m.d <= 30 THEN round(greatest(0.3, 0.5 - nn.m.d * 0.01), 2) ELSE 0 END::DOUBLE AS confidence,
        CASE WHEN sv IS NOT NULL THEN 'sender_identity' WHEN dv.n = 1 THEN 'same_letter_co_occurrence' WHEN tv.n = 1 THEN 'temporal_same_date' WHEN nn.m.d <= 30 THEN 'temporal_nearest_' || nn.m.d || 'd' ELSE 'unresolvable' END AS method,
        NOT (sv IS NOT NULL OR coalesce(dv.n = 1, false) OR coalesce(tv.n = 1, false) OR coalesce(nn.m.d <= 30, false)) AS is_ambiguous
        FROM bare b LEFT JOIN sv ON sv.sender = b.sender LEFT JOIN dv ON dv.doc_id = b.doc_id LEFT JOIN tv ON tv.date = b.date LEFT JOIN nn ON nn.date = b.date""",
    ),
)
def _(spark, sf):
    v = spark.createDataFrame([("V0", "#000000001", 0), ("V1", "#000000002", 1), ("V2", "#000000003", 2)], "variant string, alias string, ord int")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date"), "o_custkey")
    m = o.select("doc_id", "date", F.concat(F.lit("#"), F.lpad((F.col("o_custkey") % 97).cast("string"), 9, "0")).alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sender"))
    bare = o.join(c, "o_custkey").select("doc_id", F.date_add("date", 1).alias("date"), "sender")
    return J.attribute_bare_names(bare, v, m)


@query(
    "match_seeds",
    with_(
        LETTERS, SENTS,
        "seeds AS (SELECT id, sentence, min(CASE WHEN is_formulaic THEN 'a' ELSE 'b' END) AS pole FROM sents GROUP BY 1, 2 UNION ALL SELECT -5, 'absent', 'a')",
        body="""SELECT 'matched' AS kind, s.id, md5(s.sentence) AS h, max(t.idx) AS idx FROM seeds s JOIN sents t ON t.id = s.id AND t.sentence = s.sentence GROUP BY 2, 3
        UNION ALL SELECT 'unmatched', NULL, NULL, 1""",
    ),
)
def _(spark, sf):
    s = X.sents(spark, sf)
    seeds = s.groupBy("id", "sentence").agg(F.min(F.when(F.col("is_formulaic"), "a").otherwise("b")).alias("pole"))
    seeds = seeds.union(spark.createDataFrame([(-5, "absent", "a")], "id long, sentence string, pole string"))
    found, missing = J.match_seeds(seeds, s)
    a = found.select(F.lit("matched").alias("kind"), "id", F.md5("sentence").alias("h"), F.col("idx").cast("long").alias("idx"))
    return a.unionByName(missing.select(F.lit("unmatched").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("h"), F.col("unmatched").alias("idx")))


@query(
    "referential_check",
    """WITH u AS (SELECT d.doc_id AS entry, d.doc_id + 3 AS ref FROM documents d UNION ALL SELECT doc_id, doc_id * 2 FROM documents)
    SELECT 'unknown' AS kind, entry::VARCHAR AS entry, ref::VARCHAR AS ref FROM u WHERE ref NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'orphan', NULL, doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT ref FROM u)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array(F.col("doc_id") + 3, F.col("doc_id") * 2).alias("refs"))
    return J.referential_check(d, table(spark, sf, "labels"), "doc_id", "refs", "doc_id")


@query(
    "assign_place_id",
    with_(
        LETTERS,
        "f AS (SELECT location, min(id) AS o FROM letters GROUP BY 1)",
        "n AS (SELECT location, row_number() OVER (ORDER BY o, location) AS place_id FROM f)",
        body="SELECT id, l.location, coalesce(place_id, 0) AS place_id FROM letters l LEFT JOIN n ON n.location = l.location",
    ),
)
def _(spark, sf):
    return J.assign_place_id(X.letters(spark, sf)).select("id", "location", "place_id")


@query(
    "translate_values",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'es' THEN NULL ELSE lang END AS lang FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return J.translate_values(d, "lang", {"en": "English", "de": "Deutsch"}, skip=("es",))


@query(
    "enrich_lookup",
    """WITH e AS (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey END AS qid, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey END AS url FROM customer),
    g AS (SELECT * FROM e WHERE coalesce(qid, url) IS NOT NULL),
    p AS (SELECT s_suppkey, s_name, 'Customer#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') AS display, 'Customer#' || lpad((s_suppkey * 5)::VARCHAR, 9, '0') AS source FROM supplier)
    SELECT p.s_suppkey, CASE WHEN a.name IS NOT NULL THEN a.qid ELSE b.qid END AS qid, CASE WHEN a.name IS NOT NULL THEN a.url ELSE b.url END AS url
    FROM p LEFT JOIN g a ON a.name = p.display LEFT JOIN g b ON b.name = p.source""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    e = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata_id"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("wikipedia_url"),
    )
    s = F.col("s_suppkey")
    name = lambda f: F.concat(F.lit("Customer#"), F.lpad((s * f).cast("string"), 9, "0"))
    p = table(spark, sf, "supplier").select(s, name(3).alias("display"), name(5).alias("source"))
    out = J.enrich_lookup(p, e, "display", "source")
    return out.select("s_suppkey", F.col("enrichment.wikidata_id").alias("qid"), F.col("enrichment.wikipedia_url").alias("url"))


@query(
    "lexicon_annotate",
    with_(
        LETTERS,
        "lex(token, expansion) AS (VALUES ('tion', 'noun'), ('eaux', 'plural'), ('The ', 'article'))",
        "parts AS (SELECT id, token, expansion, string_split(text, token) AS p FROM letters JOIN lex ON contains(text, token))",
        "occ AS (SELECT id, token, expansion, i, length(array_to_string(p[1:i], '')) + (i - 1) * length(token) AS pos FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM parts))",
        body="SELECT id, token, expansion, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM occ GROUP BY 1, 2, 3",
    ),
)
def _(spark, sf):
    lex = spark.createDataFrame([("tion", "noun"), ("eaux", "plural"), ("The ", "article")], "token string, expansion string")
    out = J.lexicon_annotate(X.letters(spark, sf), "id", "text", lex)
    joined = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return out.select("id", "token", "expansion", joined.alias("positions"))
