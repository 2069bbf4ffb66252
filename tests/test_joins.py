from datetime import date

import pytest
from pyspark.sql import functions as F

from missiva.operators import browse as B
from missiva.operators import entities as N
from missiva.operators import joins as J
from missiva.operators import spatial as G

D = date


def test_event_windows(rows):
    ev = rows([(1, D(2020, 1, 20), D(2020, 1, 22)), (2, D(2021, 1, 1), D(2021, 1, 1))], "event_id int, start date, end date")
    docs = rows([(D(2020, 1, 19), 1.0), (D(2020, 1, 6), 3.0), (D(2020, 1, 5), 9.0), (D(2020, 1, 20), 9.0), (D(2020, 1, 22), 4.0), (D(2020, 2, 21), 6.0)], "date date, s double")
    got = {r["event_id"]: r for r in J.event_window_stats(ev, docs, "s").collect()}
    assert (got[1]["before_mean"], got[1]["after_mean"], got[1]["delta"]) == (2.0, 5.0, 3.0)
    assert (got[1]["before_count"], got[1]["after_count"]) == (2, 2)
    assert got[2]["delta"] is None and got[2]["before_count"] == 0


def test_proximity_across_the_date_line_and_pole(rows):
    a = rows([(1, 0.0, 179.99), (2, 89.99, 10.0), (3, 10.0, 10.0)], "a int, lat double, lng double")
    b = rows([(7, 0.0, -179.99), (8, 89.99, -170.0), (9, 11.0, 10.0)], "b int, lat double, lng double")
    got = {(r["a"], r["b"]) for r in G.proximity_pairs(a, b, "a", "b", 5.0).collect()}
    assert got == {(1, 7), (2, 8)}
    assert {(r["a"], r["b"]) for r in G.proximity_pairs(a, b, "a", "b", 112.0).collect()} == {(1, 7), (2, 8), (3, 9)}


def test_polygon_with_hole(rows):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    polys = rows([("land", [sq(0.0, 10.0), sq(4.0, 6.0)])], "name string, rings array<array<struct<lng:double,lat:double>>>")
    pts = rows([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 11.0, 1.0), (4, None, None)], "id int, lat double, lng double")
    got = {r["id"]: r["name"] for r in G.point_in_polygon(pts, polys, "id", "name").collect()}
    assert got == {1: "land", 2: "Unknown", 3: "Unknown", 4: "Unknown"}


def test_rings_are_simplified_closed_and_counted(rows):
    line = [(float(x), 0.001 * (x % 2)) for x in range(11)] + [(10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    f = rows([("a", [line])], "name string, rings array<array<struct<lng:double,lat:double>>>")
    r = G.simplify_rings(f, "name", tol=0.01).first()
    assert (r["points_before"], r["points_after"]) == (14, 5)
    ring = [(p["lng"], p["lat"]) for p in r["rings"][0]]
    assert ring[0] == ring[-1] == (0.0, 0.0) and (10.0, 10.0) in ring
    assert G.bbox_filter(f, 9, 9, 11, 11).count() == 1 and G.bbox_filter(f, 20, 20, 30, 30).count() == 0


def test_cascade_order_and_prefix(rows):
    left = rows([(1, "Feldburg (Feldbach)", []), (2, "Lodzer", []), (3, "Nowhere", ["Løtzen"]), (4, "Aar", [])], "k int, name string, aliases array<string>")
    right = rows([(1, "Feldbach (Feldburg)"), (2, "Lodz"), (3, "Løtzen"), (4, "Aarhus")], "o int, place string")
    got = {r["k"]: (r["pass_no"], r["matched"]) for r in J.cascade_match(left, right, "k", "name", "place", "o", "aliases").collect()}
    assert got == {1: (3, "Feldbach (Feldburg)"), 2: (4, "Lodz"), 3: (5, "Løtzen")}


def test_bare_names_cascade(rows):
    v = rows([("Fog", "Maren Fog", 0), ("Hansen", "Maren Hansen", 1)], "variant string, alias string, ord int")
    m = rows([(1, D(2020, 1, 1), "Maren Fog"), (2, D(2020, 3, 1), "Maren Fog"), (2, D(2020, 3, 1), "Maren Hansen"), (9, D(2020, 5, 1), "Maren Hansen")], "doc_id int, date date, name string")
    b = rows(
        [(1, D(2020, 1, 1), "x"), (2, D(2020, 3, 1), "fra Maren Hansen"), (3, D(2020, 1, 1), "x"), (4, D(2020, 1, 11), "x"),
         (5, D(2020, 3, 3), "x"), (6, D(2020, 8, 1), "x"), (7, None, "x")],
        "doc_id int, date date, sender string",
    )
    got = {r["doc_id"]: r for r in J.attribute_bare_names(b, v, m).collect()}
    assert (got[1]["assigned_to"], got[1]["confidence"]) == ("Fog", 0.7)
    assert (got[2]["assigned_to"], got[2]["confidence"]) == ("Hansen", 0.95)
    assert (got[3]["assigned_to"], got[3]["method"]) == ("Fog", "temporal_same_date")
    assert (got[4]["method"], got[4]["confidence"]) == ("temporal_nearest_10d", 0.4)
    assert (got[5]["assigned_to"], got[5]["confidence"]) == ("Fog", 0.48)
    assert got[6]["is_ambiguous"] and got[7]["method"] == "unresolvable"


def plain_positions(text, token):
    out, at = [], text.find(token)
    while at >= 0:
        out.append(at)
        at = text.find(token, at + len(token))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_lexicon_positions(rows, monkeypatch, large):
    if large:
        monkeypatch.setattr(J, "bounded_broadcast", lambda df: df)
    texts = ["Kl. 3 kl. Kl. x", "", None, "aaaaa Kl.", "s\U0001f600\U0001f600ø 漢字 a.*b \\E\\Q q", "Kl. 3 kl. Kl. x", "ab"]
    tokens = ["Kl.", "x", "aa", "aaa", "\U0001f600", "字", "a.*b", "\\E\\Q", "", None, "x", "nowhere", "ø 漢字"]
    docs = rows([(i, t) for i, t in enumerate(texts)], "id int, t string")
    lex = rows([(t, i) for i, t in enumerate(tokens)], "token string, no int")
    got = sorted((r["id"], r["no"], list(r["positions"])) for r in J.lexicon_annotate(docs, "id", "t", lex).collect())
    assert got == sorted((i, n, plain_positions(t, w)) for i, t in enumerate(texts) for n, w in enumerate(tokens) if t and w and w in t)
    assert J.lexicon_annotate(docs, "id", "t", lex.limit(0)).collect() == []


def test_a_large_lexicon_is_joined_on_substrings(spark):
    words = spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).select(F.concat(F.lit("n"), F.substring("h", 1, 9)).alias("token"))
    some = [r[0] for r in words.orderBy("token").limit(3000).collect()]
    docs = spark.createDataFrame([(i, " and ".join(some[i::300])) for i in range(300)], "id int, t string")
    out = J.lexicon_annotate(docs, "id", "t", words)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = out.collect()
    assert len(found) >= 3000 and {r["token"] for r in found} >= set(some)
    texts = {r["id"]: r["t"] for r in docs.collect()}
    assert all(list(r["positions"]) == plain_positions(texts[r["id"]], r["token"]) for r in found)


def test_overlay_and_split_round(rows):
    sch = "id string, canonical string, aliases array<string>, role string, letter_count int, first_mention date"
    comp = rows([("a", "A", ["A", "a1"], "unknown", 3, D(2020, 1, 1))], sch)
    cur = rows([("a", None, ["x"], "aunt")], "id string, canonical string, aliases array<string>, role string")
    man = rows([("a", "no", ["n"], "r", 0, None), ("m", "M", ["M"], "r", 0, None)], sch)
    got = {r["id"]: r for r in J.overlay_merge(comp, cur, man, ["canonical", "role"]).collect()}
    assert got["a"]["role"] == "aunt" and got["a"]["canonical"] == "A" and got["a"]["aliases"] == ["A", "a1", "x"]
    assert got["a"]["letter_count"] == 3 and got["m"]["canonical"] == "M"


def test_get_document_needs_every_analysis(rows):
    lt = rows([(1, "a"), (2, "b")], "id int, t string")
    s1, s2 = rows([(1, 0.5), (2, 0.1)], "id int, mean double"), rows([(1, "rising")], "id int, arc string")
    assert B.get_document(lt, 1, [s1, s2]).first()["analysis"]["arc"] == "rising"
    assert B.get_document(lt, 2, [s1, s2]).first()["analysis"] is None


def test_only_the_browse_tool_clamps_the_page(rows):
    df = rows([(i, D(2020, 1, 1)) for i in range(150)], "id int, date date")
    assert B.browse_tool(df, limit=1000).count() == 100 and B.browse_tool(df, limit=0, offset=-5).count() == 1
    assert B.browse(df, limit=1000).count() == 150
    assert not B.browse(df, offset=140).first()["has_more"]
    for wrong in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            B.browse(df, **wrong)


def test_images_set_by_hand(rows):
    pairs = rows([(1, 1, "place", "place", 0.8), (1, 2, "map", "place", 0.5)], "doc_id int, image_id int, category string, relevance string, score double")
    own = rows([(1, 2, 0.9), (1, 2, 0.7), (1, 9, 0.6), (3, 1, 0.1)], "doc_id int, image_id int, score double")
    img = rows([(1, "place"), (2, "map"), (9, "group")], "image_id int, category string")
    both = N.with_overrides(pairs, own, img)
    assert sorted(map(tuple, both.collect())) == [
        (1, 1, "place", "place", 0.8), (1, 2, "map", "manual", 0.9), (1, 9, "group", "manual", 0.6), (3, 1, "place", "manual", 0.1),
    ]
    assert [(r["doc_id"], r["image_id"], r["rank"]) for r in N.shortlist(both, 2).orderBy("doc_id", "rank").collect()] == [(1, 2, 1), (1, 1, 2), (3, 1, 1)]
    assert N.with_overrides(pairs, own.limit(0), img).count() == 2


def test_image_scores(rows):
    d = rows([(1, D(1915, 1, 1), ["p1"], ["peter", "trine"], ["trine"]), (2, None, ["p2"], ["peter"], ["mor"])], "doc_id int, date date, places array<string>, persons array<string>, recipients array<string>")
    i = rows(
        [(1, D(1915, 1, 20), ["p1"], ["trine"], "portrait"), (2, D(1916, 1, 1), ["p1"], [], "place"), (3, None, [], ["peter"], "group"),
         (4, D(1915, 2, 1), ["p9"], [], "map"), (5, D(1915, 2, 25), [], [], "group"), (6, D(1915, 1, 1), ["p1"], [], "map")],
        "image_id int, date date, places array<string>, persons array<string>, category string",
    )
    got = {(r["doc_id"], r["image_id"]): (r["score"], r["relevance"]) for r in N.score_pairs(d, i, frequent=("peter",)).collect()}
    assert got == {(1, 1): (1.1, "place+person"), (1, 2): (0.9, "place"), (1, 5): (0.3, "date"), (1, 6): (0.5, "place")}


def test_duplicates_with_a_background(rows):
    df = rows([(1, "a"), (2, "b"), (3, "a"), (4, "bg"), (5, "bg")], "k int, c string")
    from pyspark.sql import functions as F

    kept, gone = N.duplicate_documents(df, "k", "c", F.col("c") == "bg")
    assert sorted(r["k"] for r in kept.collect()) == [1, 2]
    assert sorted((r["k"], r["category"], r["duplicate_of"]) for r in gone.collect()) == [
        (3, "removed_duplicate", 1), (4, "removed_background", None), (5, "removed_background", None),
    ]


def test_queue_tiers_and_texts(rows):
    reg = rows(
        [("konow", "Konow", ["Konow", "Hans Konow"], "military", 9, D(1916, 9, 1)), ("peter", "Peter", ["Peter"], "family", 99, None),
         ("x", "Ukendt", ["Ukendt"], "unknown", 4, None), ("y", "Niels Skau", [], "community", 6, None)],
        "id string, canonical string, aliases array<string>, category string, letter_count int, last_mention date",
    )
    sil = rows([("konow", True, 1916), ("y", True, 1917), ("peter", False, None)], "id string, disappeared boolean, disappearance_year int")
    prior = rows([("y", "done"), ("peter", "not_started")], "id string, status string")
    assert "peter" not in {r["id"] for r in N.priority_queue(reg, sil, prior).filter("tier = 2").collect()}
    sil = sil.withColumn("silence_duration_days", F.lit(700))
    got = {r["id"]: r for r in N.priority_queue(reg, sil, prior, core=("peter",), own_sources={"peter": ["bundesarchiv"], "konow": ["no"]}).collect()}
    assert set(got) == {"konow", "peter", "y"} and got["peter"]["tier"] == 2
    assert got["peter"]["sources"] == ["bundesarchiv"] and "no" not in got["konow"]["sources"]
    assert got["konow"]["notes"] == "Disappeared 1916. Silence duration: 700 days."
    assert got["y"]["notes"] == "Disappeared 1917." and got["peter"]["notes"] is None
    assert got["konow"]["strategy"] == (
        "Search Verlustlisten for Konow in lists from the period around 1916-09-01. Date aligns with Battle of the Somme "
        "(July–Nov 1916), Verdun (Feb–Dec 1916). Also search as Hans Konow. Cross-ref with regiment if identified."
    )
    assert got["y"]["tier"] == 3 and got["y"]["status"] == "done"
    assert got["y"]["strategy"].endswith("Disappeared 1917 — check Verlustlisten if military age.")
