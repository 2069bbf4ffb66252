"""Entity audit, registry, roles, research queue, duplicates, image matching and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.operators import browse as B
from missiva.operators import entities as N
from missiva.operators import reports as R
from missiva.operators import spatial as G
from missiva.plans import fixtures as X
from missiva.plans.catalog import query, table
from missiva.plans.fixtures import LETTERS, MENTIONS, with_
from missiva.plans.graph_plans import PAIRS, pairs
from missiva.sources import readers

WORDS = """
em AS (SELECT conv_id AS doc, CASE role WHEN 'user' THEN 'PER' WHEN 'assistant' THEN 'LOC' ELSE 'ORG' END AS type, split_part(text, ' ', 1) AS text,
       DATE '2020-01-01' + CAST(conv_id % 900 AS INTEGER) AS date FROM conversations),
ec AS (SELECT text, type, count(*) AS count FROM em GROUP BY 1, 2)"""
# Audit rules for the words that conversations begin with.
RULES = (
    ("La", "remove", None, "article"), ("Le", "reclassify", None, "place"), ("The", "merge", "The", "group"),
    ("Et", "merge", "The", "group"), ("De", "ambiguous", None, "unclear"),
)
RULES_SQL = "rules(text, action, target, reason) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in RULES
) + ")"


def ent(spark, sf):
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "PER").when(F.col("role") == "assistant", "LOC").otherwise("ORG")
    date = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 900).cast("int"))
    return c.select(F.col("conv_id").alias("doc"), kind.alias("type"), F.split("text", " ")[0].alias("text"), date.alias("date"))


def audit(spark, sf):
    counts = ent(spark, sf).groupBy("text", "type").agg(F.count(F.lit(1)).alias("count"))
    rules = spark.createDataFrame(list(RULES), "text string, action string, target string, reason string")
    return N.entity_audit(counts, rules)


AUDIT = """
pt AS (SELECT text, sum(count) AS total, sum(count) FILTER (type = 'PER') AS per, bool_or(type = 'PER') AS is_per, bool_or(type = 'LOC') AS is_loc FROM ec GROUP BY 1),
jr AS (SELECT pt.*, action AS act, target, reason AS why FROM pt LEFT JOIN rules USING (text)),
audit AS (SELECT 'removed' AS action, text AS canonical, text, total AS count, why AS reason FROM jr WHERE act = 'remove'
 UNION SELECT 'reclassified', text, text, per, why FROM jr WHERE act = 'reclassify' AND per > 0
 UNION SELECT 'confirmed', target, target, sum(total), 'merge' FROM jr WHERE act = 'merge' GROUP BY target
 UNION SELECT 'confirmed', text, text, per, 'keep' FROM jr WHERE act IS NULL AND is_per
 UNION SELECT 'ambiguous', text, text, total, why FROM jr WHERE act = 'ambiguous'
 UNION SELECT 'ambiguous', text, text, total, 'single_character_entity' FROM jr WHERE length(text) = 1
 UNION SELECT 'ambiguous', text, text, total, 'appears_as_both_PER_and_LOC' FROM jr WHERE act IS NULL AND is_per AND is_loc
 UNION SELECT 'ambiguous', text, text, per, 'PER_entity_count_below_2' FROM jr WHERE act IS NULL AND per < 2)"""


@query("entity_audit", with_(WORDS, RULES_SQL, AUDIT, body="SELECT action, canonical, text, count::BIGINT AS count, reason FROM audit"))
def _(spark, sf):
    return audit(spark, sf)


@query("audit_summary", with_(WORDS, RULES_SQL, AUDIT, body="SELECT action, count(*) AS entries FROM audit GROUP BY 1"))
def _(spark, sf):
    return N.audit_summary(audit(spark, sf))


@query(
    "build_registry",
    with_(
        WORDS, RULES_SQL, AUDIT,
        "known(canonical, role, category, ord, a1) AS (VALUES ('Elle', 'cook', 'community', 1, 'Elle'), ('Maren Fog', 'aunt', 'family', 2, 'Les'))",
        """people AS (SELECT canonical, role, category, list_distinct([canonical, a1]) AS aliases FROM known
          UNION ALL SELECT canonical, 'unknown', 'unknown', [canonical] FROM audit WHERE action = 'confirmed' AND count >= 3 AND canonical NOT IN (SELECT canonical FROM known UNION SELECT a1 FROM known) AND canonical <> 'El')""",
        "al AS (SELECT canonical, unnest(aliases) AS alias FROM people)",
        "st AS (SELECT canonical, count(DISTINCT doc) AS n, min(date) AS f, max(date) AS l FROM al JOIN em ON em.text = alias GROUP BY 1)",
        body="""SELECT replace(replace(lower(p.canonical), ' ', '_'), '.', '') AS id, p.canonical, p.role, p.category, coalesce(n, 0) AS letter_count, f AS first_mention, l AS last_mention
        FROM people p LEFT JOIN st ON st.canonical = p.canonical""",
    ),
)
def _(spark, sf):
    known = spark.createDataFrame(
        [("Elle", ["Elle"], "cook", "community", 1), ("Maren Fog", ["Les"], "aunt", "family", 2)],
        "canonical string, aliases array<string>, role string, category string, ord int",
    )
    skip = spark.createDataFrame([("El",)], "text string")
    return N.build_registry(audit(spark, sf), known, skip, ent(spark, sf)).drop("aliases")


@query(
    "mention_stats",
    with_(MENTIONS, body="SELECT id, count(DISTINCT doc) AS letter_count, min(date) AS first_mention, max(date) AS last_mention, count(DISTINCT year(date)) AS active_years FROM mentions GROUP BY 1"),
)
def _(spark, sf):
    return R.mention_nodes(X.mentions(spark, sf), "id", "doc", "date")


@query(
    "widen_stats",
    with_(
        MENTIONS,
        "s AS (SELECT id, count(DISTINCT doc) AS n, min(date) AS f, max(date) AS l FROM mentions GROUP BY 1)",
        "x AS (SELECT s_suppkey * 2 AS id, s_nationkey * 30 AS c, DATE '1994-06-01' + s_nationkey AS f, DATE '2001-01-01' + s_nationkey * 20 AS l FROM supplier)",
        body="""SELECT coalesce(s.id, x.id) AS id, (CASE WHEN coalesce(s.id, x.id) IN (4, 6) THEN coalesce(n, 0) + coalesce(c, 0) ELSE greatest(coalesce(n, 0), coalesce(c, 0)) END)::BIGINT AS letter_count,
        least(s.f, x.f) AS first_mention, greatest(s.l, x.l) AS last_mention FROM s FULL JOIN x ON x.id = s.id""",
    ),
)
def _(spark, sf):
    n = F.col("s_nationkey")
    extra = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2).alias("id"), (n * 30).cast("long").alias("count"),
        F.date_add(F.lit("1994-06-01").cast("date"), n).alias("first_date"), F.date_add(F.lit("2001-01-01").cast("date"), n * 20).alias("last_date"),
    )
    return R.widen_stats(R.mention_nodes(X.mentions(spark, sf), "id", "doc", "date"), extra, "id", add=[4, 6])


VAR = "v(grp, variant, alias) AS (VALUES ('L', 'La one', 'La'), ('L', 'Le two', 'Le'), ('L', 'Les three', 'Les'), ('T', 'The one', 'The'), ('T', 'Than two', 'Than'))"


def variants(spark):
    rows = [("L", "La one", "La"), ("L", "Le two", "Le"), ("L", "Les three", "Les"), ("T", "The one", "The"), ("T", "Than two", "Than")]
    return spark.createDataFrame(rows, "grp string, variant string, alias string")


DOC_WORDS = """
dw AS (SELECT id AS doc_id, date, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS name FROM letters)"""


def doc_words(spark, sf):
    from missiva.functions import text as T

    return X.letters(spark, sf).select(F.col("id").alias("doc_id"), "date", F.explode(F.array_distinct(T.words(F.col("text")))).alias("name"))


@query(
    "cooccurrence_evidence",
    with_(
        LETTERS, DOC_WORDS, VAR,
        body="SELECT doc_id, grp, count(DISTINCT variant) AS variants, string_agg(DISTINCT variant, '|' ORDER BY variant) AS names FROM dw JOIN v ON name = alias GROUP BY 1, 2 HAVING count(DISTINCT variant) >= 2",
    ),
)
def _(spark, sf):
    return N.cooccurrence_evidence(doc_words(spark, sf), variants(spark))


@query(
    "temporal_profiles",
    with_(LETTERS, DOC_WORDS, VAR, body="SELECT grp, variant, count(DISTINCT doc_id) AS mention_count, min(date) AS first_mention, max(date) AS last_mention FROM dw JOIN v ON name = alias GROUP BY 1, 2"),
)
def _(spark, sf):
    return N.temporal_profiles(doc_words(spark, sf), variants(spark))


@query(
    "person_roles",
    with_(
        LETTERS, DOC_WORDS,
        "s(sender, id) AS (VALUES ('src0', 'peter'), ('src1', 'maren'))", "r(recipient, id) AS (VALUES ('en', 'trine'), ('fr', 'peter'), ('fr', 'far'))",
        "a(alias, id) AS (VALUES ('the', 'peter'), ('and', 'trine'), ('les', 'far'))",
        """u AS (SELECT letters.id AS doc_id, s.id, 1 AS p FROM letters JOIN s USING (sender) UNION ALL SELECT letters.id, r.id, 2 FROM letters JOIN r USING (recipient)
             UNION ALL SELECT doc_id, a.id, 3 FROM dw JOIN a ON lower(name) = alias)""",
        body="SELECT doc_id, id, CASE min(p) WHEN 1 THEN 'sender' WHEN 2 THEN 'recipient' ELSE 'mentioned' END AS role FROM u GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    lt = X.letters(spark, sf).select(F.col("id").alias("doc_id"), "sender", "recipient")
    s = spark.createDataFrame([("src0", "peter"), ("src1", "maren")], "sender string, id string")
    r = spark.createDataFrame([("en", "trine"), ("fr", "peter"), ("fr", "far")], "recipient string, id string")
    a = spark.createDataFrame([("the", "peter"), ("and", "trine"), ("les", "far")], "alias string, id string")
    return N.person_roles(lt, doc_words(spark, sf), s, r, a)


QUEUE = """
reg AS (SELECT c_custkey AS id, c_name AS canonical, CASE c_nationkey % 4 WHEN 0 THEN 'military' WHEN 1 THEN 'community' WHEN 2 THEN 'family' ELSE 'unknown' END AS category,
  coalesce(n, 0) AS letter_count, l AS last_mention FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS l FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
sil AS (SELECT id, year(last_mention) AS y, DATE '2001-12-31' - last_mention AS days FROM reg WHERE letter_count >= 5 AND last_mention < DATE '2001-02-01'),
q AS (SELECT reg.*, y, days, sil.id IS NOT NULL AS lost FROM reg LEFT JOIN sil ON sil.id = reg.id),
t AS (SELECT *, unnest(list_filter([CASE WHEN category = 'military' AND lost THEN 1 END, CASE WHEN id IN (1, 2, 3) THEN 2 END,
  CASE WHEN NOT (category = 'military' AND lost) AND id NOT IN (1, 2, 3) THEN CASE WHEN category <> 'unknown' THEN 3 WHEN letter_count >= 5 THEN 4 END END], lambda x: x IS NOT NULL)) AS tier FROM q)"""


@query(
    "priority_queue",
    with_(
        QUEUE,
        body="""SELECT t.id, tier, canonical, letter_count, category, y AS disappearance_year,
        CASE WHEN tier = 1 THEN 'verlustlisten|historisk_sonderjylland|bundesarchiv' WHEN tier = 2 AND t.id = 2 THEN 'bundesarchiv|ao_dk' WHEN tier = 2 OR category = 'family' THEN 'ao_dk|familysearch|rigsarkivet' WHEN category = 'military' THEN 'verlustlisten|historisk_sonderjylland'
          WHEN lost THEN 'ao_dk|familysearch|verlustlisten' ELSE 'ao_dk|familysearch' END AS sources,
        CASE WHEN tier = 1 THEN 'Search Verlustlisten for ' || canonical || ' in lists from the period around ' || last_mention || '. Cross-ref with regiment if identified.'
          WHEN tier = 2 OR category = 'family' THEN 'Search parish register and census for ' || canonical || '. Determine the relationship to the family.'
          WHEN category = 'military' THEN 'Search Verlustlisten and Historisk Sønderjylland for ' || canonical || '.'
          WHEN category = 'community' THEN 'Search census for ' || canonical || '. Common name — additional context from letters needed.' || CASE WHEN lost THEN ' Disappeared ' || y || ' — check Verlustlisten if military age.' ELSE '' END
          ELSE 'Search census for ' || canonical || '. May need letter context for identification.' || CASE WHEN lost THEN ' Disappeared ' || y || ' — check Verlustlisten.' ELSE '' END END AS strategy,
        CASE WHEN tier = 1 THEN 'Disappeared ' || y || '. Silence duration: ' || days || ' days.' WHEN tier = 3 AND lost THEN 'Disappeared ' || y || '.' END AS notes,
        CASE WHEN s_suppkey IS NOT NULL AND s_nationkey > 10 THEN 'in_progress' ELSE 'not_started' END AS status FROM t LEFT JOIN supplier ON s_suppkey = t.id""",
    ),
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last_mention")
    )
    k = F.col("c_nationkey") % 4
    cat = F.when(k == 0, "military").when(k == 1, "community").when(k == 2, "family").otherwise("unknown")
    reg = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical"), F.array("c_name").alias("aliases"), cat.alias("category"))
    reg = reg.join(o, "id", "left").withColumn("letter_count", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    lost = (F.col("letter_count") >= 5) & (F.col("last_mention") < F.lit("2001-02-01").cast("date"))
    sil = reg.select("id", lost.alias("disappeared"), F.year("last_mention").alias("disappearance_year"), F.datediff(F.lit("2001-12-31").cast("date"), "last_mention").alias("silence_duration_days"))
    prior = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 10, "in_progress").otherwise("not_started").alias("status"))
    out = N.priority_queue(reg, sil, prior, core=(1, 2, 3), own_sources={2: ("bundesarchiv", "ao_dk")})
    return out.withColumn("sources", F.array_join("sources", "|")).withColumns({c: F.col(c).cast("long") for c in ("tier", "disappearance_year")})


@query(
    "duplicate_documents",
    """WITH g AS (SELECT md5(text) AS h, min(doc_id) AS f, count(*) AS n, arg_min(lang, doc_id) = 'de' AS bg FROM documents GROUP BY 1),
    j AS (SELECT d.doc_id, g.* FROM documents d JOIN g ON md5(d.text) = h)
    SELECT doc_id, CASE WHEN n > 1 AND bg THEN 'removed_background' WHEN n > 1 AND doc_id <> f THEN 'removed_duplicate' ELSE 'kept' END AS category,
    CASE WHEN n > 1 AND NOT bg AND doc_id <> f THEN f END AS duplicate_of FROM j""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    kept, removed = N.duplicate_documents(d, "doc_id", "text", F.col("lang") == "de")
    return removed.unionByName(kept.select("doc_id", F.lit("kept").alias("category"), F.lit(None).cast("long").alias("duplicate_of")))


@query(
    "rule_classify",
    """WITH d AS (SELECT doc_id, text, n_chars, CASE WHEN lang = 'es' THEN 'manual' ELSE 'uncategorized' END AS category FROM documents),
    i AS (SELECT *, list_filter([CASE WHEN contains(text, 'The') OR contains(text, 'And') THEN 'english' END, CASE WHEN contains(text, 'Les') THEN 'french' END], lambda x: x IS NOT NULL) AS ids FROM d)
    SELECT doc_id, array_to_string(ids, '|') AS ids, CASE WHEN category <> 'uncategorized' THEN category WHEN (contains(lower(text), 'nicht') OR contains(lower(text), 'auch')) AND n_chars > 500 THEN 'map'
    WHEN len(ids) > 0 AND n_chars < 400 THEN 'portrait' WHEN contains(lower(text), 'tion') THEN 'document' ELSE 'uncategorized' END AS category FROM i""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("category", F.when(F.col("lang") == "es", "manual").otherwise("uncategorized"))
    d = d.withColumn("ids", N.detect_ids(F.col("text"), {"english": ("The", "And"), "french": ("Les",)}))
    rules = [
        ("map", ("nicht", "auch"), F.col("n_chars") > 500), ("portrait", (), (F.size("ids") > 0) & (F.col("n_chars") < 400)),
        ("document", ("tion",), None),
    ]
    return N.rule_classify(d, F.col("text"), rules).select("doc_id", F.array_join("ids", "|").alias("ids"), "category")


IMAGES = """
img AS (SELECT s_suppkey AS image_id, DATE '2020-01-01' + CAST((s_suppkey * 13) % 1460 AS INTEGER) AS idt, 'Place ' || s_suppkey % 40 AS ip,
  CASE s_suppkey % 4 WHEN 0 THEN 'src' || s_suppkey % 5 WHEN 1 THEN 'fr' WHEN 2 THEN 'nobody' ELSE 'src1' END AS inn,
  CASE s_suppkey % 6 WHEN 0 THEN 'portrait' WHEN 1 THEN 'map' WHEN 2 THEN 'historical' WHEN 3 THEN 'document' WHEN 4 THEN 'place' ELSE 'group' END AS category FROM supplier),
ix AS (SELECT l.id AS doc_id, image_id, category, l.place = ip AS pl, l.sender = inn AS pe, l.recipient = inn AS re, inn, abs(l.date - idt) AS gap FROM letters l, img),
ib AS (SELECT *, CASE WHEN gap <= 31 THEN 0.3 WHEN gap <= 92 THEN 0.2 WHEN gap <= 365 THEN 0.1 ELSE 0.0 END AS b FROM ix),
ik AS (SELECT *, CASE WHEN pl AND (pe OR re) THEN 'place+person' WHEN pl THEN 'place' WHEN re THEN 'recipient' WHEN pe THEN 'person' WHEN b >= 0.2 THEN 'date' ELSE 'context' END AS relevance FROM ib),
isc AS (SELECT *, CASE relevance WHEN 'place+person' THEN 0.8 + b WHEN 'place' THEN 0.7 + b + CASE WHEN category = 'place' THEN 0.1 ELSE 0 END WHEN 'recipient' THEN 0.5 + b WHEN 'person' THEN 0.4 + b WHEN 'date' THEN 0.1 + b ELSE 0 END::DOUBLE AS s0 FROM ik),
ifin AS (SELECT *, CASE WHEN category = 'portrait' AND NOT pe AND NOT re THEN 0 WHEN category = 'map' AND NOT pl THEN 0 WHEN category = 'map' THEN least(s0, 0.5) WHEN category = 'historical' THEN least(s0, 0.3)
  WHEN category = 'document' AND NOT pl AND NOT pe THEN 0 ELSE s0 END AS s1 FROM isc),
scored_img AS (SELECT doc_id, image_id, category, relevance, round(CASE WHEN pe AND NOT pl AND NOT re AND inn = 'src1' THEN s1 * 0.1 ELSE s1 END, 3) AS score FROM ifin)"""


def images(spark, sf):
    k = F.col("s_suppkey")
    r6, r4 = k % 6, k % 4
    cat = F.when(r6 == 0, "portrait").when(r6 == 1, "map").when(r6 == 2, "historical").when(r6 == 3, "document").when(r6 == 4, "place").otherwise("group")
    who = F.when(r4 == 0, F.concat(F.lit("src"), (k % 5).cast("string"))).when(r4 == 1, "fr").when(r4 == 2, "nobody").otherwise("src1")
    return table(spark, sf, "supplier").select(
        k.alias("image_id"), F.date_add(F.lit("2020-01-01").cast("date"), ((k * 13) % 1460).cast("int")).alias("date"),
        F.array(F.concat(F.lit("Place "), (k % 40).cast("string"))).alias("places"), F.array(who).alias("persons"), cat.alias("category"),
    )


def image_pairs(spark, sf):
    d = X.letters(spark, sf).select(F.col("id").alias("doc_id"), "date", F.array("place").alias("places"), F.array("sender").alias("persons"), F.array("recipient").alias("recipients"))
    return N.score_pairs(d, images(spark, sf), frequent=("src1",))


@query("score_pairs", with_(LETTERS, IMAGES, body="SELECT * FROM scored_img WHERE score >= 0.2"))
def _(spark, sf):
    return image_pairs(spark, sf)


@query(
    "image_overrides",
    with_(
        LETTERS, IMAGES,
        "ov AS (SELECT l.id AS doc_id, s_suppkey AS image_id, (l.id % 13) / 10.0::DOUBLE AS score FROM letters l JOIN supplier ON s_suppkey IN (l.id % 100 + 1, l.id % 10 + 1) WHERE l.id % 3 = 0)",
        "own AS (SELECT doc_id, image_id, max(score) AS score FROM ov GROUP BY ALL)",
        """p AS (SELECT * FROM scored_img WHERE score >= 0.2 AND (doc_id, image_id) NOT IN (SELECT (doc_id, image_id) FROM own)
          UNION ALL SELECT own.doc_id, own.image_id, img.category, 'manual', own.score FROM own JOIN img USING (image_id))""",
        body="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, image_id) AS rank FROM p) WHERE rank <= 8",
    ),
)
def _(spark, sf):
    ids = X.letters(spark, sf).select(F.col("id").alias("doc_id")).filter(F.col("doc_id") % 3 == 0)
    both = ids.withColumn("image_id", F.explode(F.array(F.col("doc_id") % 100 + 1, F.col("doc_id") % 10 + 1)))
    own = both.join(images(spark, sf).select("image_id"), "image_id", "left_semi").withColumn("score", (F.col("doc_id") % 13) / 10.0)
    pairs = N.with_overrides(image_pairs(spark, sf), own, images(spark, sf))
    return N.shortlist(pairs).withColumn("rank", F.col("rank").cast("long"))


@query(
    "get_person",
    with_(
        MENTIONS, PAIRS,
        body="""SELECT 7 AS id, 'person' AS section, 'Supplier#000000007' AS item, count(DISTINCT doc)::DOUBLE AS value FROM mentions WHERE id = 7
        UNION ALL SELECT DISTINCT 7, 'document', doc::VARCHAR, NULL::DOUBLE FROM mentions WHERE id = 7
        UNION ALL SELECT 7, 'connection', CASE WHEN a = 7 THEN b ELSE a END::VARCHAR, weight FROM edges WHERE a = 7 OR b = 7""",
    ),
)
def _(spark, sf):
    m = X.mentions(spark, sf)
    n = m.groupBy("id").agg(F.countDistinct("doc").alias("letter_count"))
    reg = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical")).join(n, "id")
    from missiva.operators.graph import comention_edges

    e = comention_edges(pairs(spark, sf))
    out = B.get_person(reg, "supplier#000000007", m.select("id", F.col("doc").alias("doc_id")), e)
    return out.withColumn("item", F.col("item").cast("string"))


@query(
    "read_keyed_json",
    "SELECT event_id, 'k' AS key, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::BIGINT AS value FROM events WHERE props LIKE '%\"k\"%'",
)
def _(spark, sf):
    return readers.explode_keyed_json(table(spark, sf, "events").select("event_id", "props"), "props", "bigint")


@query(
    "bbox_filter",
    "SELECT s_suppkey FROM supplier WHERE ((s_nationkey * 53) % 300 - 150 BETWEEN -60 AND 40 OR (s_nationkey * 53) % 300 - 148 BETWEEN -60 AND 40) AND (s_nationkey * 37) % 120 - 60 BETWEEN -30 AND 50",
)
def _(spark, sf):
    n = F.col("s_nationkey")
    lng, lat = ((n * 53) % 300 - 150).cast("double"), ((n * 37) % 120 - 60).cast("double")
    pt = lambda x: F.struct(x.alias("lng"), lat.alias("lat"))
    f = table(spark, sf, "supplier").select("s_suppkey", F.array(F.array(pt(lng), pt(lng + 2), pt(lng))).alias("rings"))
    return G.bbox_filter(f, -60, -30, 40, 50).select("s_suppkey")


@query("simplify_rings")
def _(spark, sf):
    # One ring per user: its events as points of a wavy line, closed at the start.
    e = table(spark, sf, "events").select(
        "user_id", F.struct(F.dayofmonth("ts").alias("d"), F.col("event_id"), F.col("value")).alias("s")
    )
    day = e.groupBy("user_id", "s.d").agg(F.avg("s.value").alias("v")).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("d").cast("double").alias("lng"), (F.col("v") / 10).alias("lat")))).alias("r")
    )
    f = day.select("user_id", F.array(F.concat("r", F.slice("r", 1, 1))).alias("rings"))
    out = G.simplify_rings(f, "user_id", tol=0.5)
    return out.select("user_id", "points_before", "points_after")
