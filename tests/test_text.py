import math

from pyspark.sql import functions as F

from missiva.functions import dates as D
from missiva.functions import geo as G
from missiva.functions import text as T
from missiva.operators import lexical as L
from missiva.operators import rewriting as W
from missiva.operators import sentences as S
from missiva.operators.quality import error_scan, scan_characters, validate_schema


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


def test_strip_html_decodes_in_order(rows):
    df = rows([("<p>a&amp;lt;b</p>&nbsp;&#39;c&#39;<br>",)], "t string")
    assert one(df, T.strip_html(F.col("t"))) == "a<b 'c'"
    df = rows([("x<br/>y</p><p>z",)], "t string")
    assert one(df, T.strip_html(F.col("t"), breaks=True)) == "x\ny\n\nz"


def test_clean_transcript(rows):
    df = rows([("  Kære\r\n  \nMor - - - - sagde--nu\n\n\n\nslut­ ",)], "t string")
    assert one(df, T.clean_transcript(F.col("t"))) == "Kære<PARA>Mor [ulæseligt] sagde-nu<PARA>slut"
    c = rows([("a<PARA> <PARA> b ",)], "t string")
    assert one(c, T.para_to_html(F.col("t"))) == "<p>a</p>\n<p>b</p>"
    assert one(c, T.para_to_plain(F.col("t"))) == "a b"


def test_digraphs_keep_case_names_and_entities(rows):
    df = rows([("Aar gaa AARHUS Aarhus &aacute; maaske",)], "t string")
    assert one(df, T.digraph_rewrite(F.col("t"))) == "År gå AARHUS Aarhus &aacute; måske"


def test_rewrite_rules_follow_their_order(rows):
    rules = [W.Rule("a", "word", "skulde", "skulle"), W.Rule("a", "word", "skulle", "SKAL"), W.Rule("b", "regex", "e(?= )", "E")]
    assert [len(s) for s in W.stages(rules)] == [1, 1, 1]
    out = W.apply_rewrite_rules(rows([(1, "jeg skulde ikke gaa, skulder")], "id int, t string"), "t", rules).first()
    assert out["text_normalized"] == "jeg SKAL ikkE gaa, skulder"
    assert out["rule_hits"] == {"a": 2, "b": 1} and out["changes"] == 3


def test_normalize_prefers_corrected_text(rows):
    raw = rows([(1, "Jeg  gaar"), (2, "to")], "id int, text string")
    fixed = rows([(1, ""), (2, "gaa nu")], "id int, text_corrected string")
    got = {r["id"]: r for r in W.normalize_corpus(raw, fixed, [W.Rule("v", "word", "nu", "NU")]).collect()}
    assert got[1]["text_normalized"] == "Jeg går" and got[1]["changes"] == 2
    assert got[2]["text_normalized"] == "gå NU" and got[2]["changes"] == 2


def test_names(rows):
    df = rows([("  Łódź (Lodz, Großstadt, ab)",)], "t string")
    f = T.fold_name(F.col("t"))
    assert one(df, T.name_components(f)) == ["lodz", "lodz", "grossstadt"]
    assert one(df, T.base_name(f)) == "lodz"
    assert one(rows([(" Øster Aabølling (By)/2 ",)], "t string"), T.slugify(F.col("t"))) == "oster_aabolling_by_2"


def test_excerpt_and_snippet(rows):
    df = rows([("\n  " + "ord " * 80,)], "t string")
    e = one(df, T.excerpt(F.col("t"), 20))
    assert e == "ord ord ord ord ord..."
    assert len(one(df, T.snippet(F.col("t")))) == 203
    assert one(rows([("",)], "t string"), T.excerpt(F.col("t"))) == ""


def test_dates_and_places(rows):
    df = rows([("1914-08-30", "54.9,9.4,7"), ("1914-13-01", "54.9"), (None, "x,y")], "d string, l string")
    got = df.select(D.parse_date(F.col("d")).alias("d"), G.parse_location(F.col("l")).alias("p")).collect()
    assert str(got[0]["d"]) == "1914-08-30" and got[1]["d"] is None and got[2]["d"] is None
    assert (got[0]["p"]["lat"], got[0]["p"]["lng"]) == (54.9, 9.4) and got[1]["p"] is None and got[2]["p"] is None
    q = df.select(D.quarter_key(D.parse_date(F.col("d"))).alias("q")).collect()
    assert [r["q"] for r in q] == ["1914-Q3", "unknown", "unknown"]
    km = one(df.limit(1), G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert abs(km - math.pi * 6371) < 1e-6


def test_sentences_guard_abbreviations_and_numbers(rows):
    t = "Kl. Ti kom han. Den 3. August! J. Hansen sagde\nja? Ja.\n\nny Del. æ. Øl"
    got = S.split_sentences(rows([(1, t)], "id int, t string"), "id", "t").orderBy("idx").collect()
    assert [r["sentence"] for r in got] == [
        "Kl. Ti kom han.", "Den 3. August!", "J. Hansen sagde ja?", "Ja.", "ny Del. æ.",
    ]
    assert [r["idx"] for r in got] == [0, 1, 2, 3, 4]


def test_formulaic(rows):
    df = rows([("Min egen kære Mor",), ("Lieber Hans",), ("Mange kærlige hilsener",), ("Din egen Peter",), ("Han kære",), ("Kærester",)], "s string")
    assert [r[0] for r in df.select(S.is_formulaic(F.col("s"))).collect()] == [True, True, True, True, False, False]


def test_richness_by_hand(rows):
    words = ["a", "b", "a", "c"] * 20
    df = rows([(1, " ".join(words)), (2, ""), (3, "en to tre")], "id int, t string")
    got = {r["id"]: r for r in L.lexical_richness(df, "id", "t").collect()}
    assert got[1]["word_count"] == 80 and got[1]["type_count"] == 3
    assert abs(got[1]["mattr"] - 3 / 50) < 1e-12
    absent = lambda k: math.prod((80 - k - i) / (80 - i) for i in range(42))
    assert abs(got[1]["hdd"] - sum((1 - absent(k)) / 42 for k in (40, 20, 20))) < 1e-9
    assert got[2]["mattr"] is None and got[2]["hapax_ratio"] == 0
    assert got[3]["mtld"] == 3.0 and got[3]["mattr"] == 1.0 and got[3]["hdd"] is None


def test_mtld_factor_closes_at_threshold(rows):
    r = L.lexical_richness(rows([(1, "a a a a a a")], "id int, t string"), "id", "t").first()
    assert r["mtld"] == 2.0


def test_entropy_and_compression(rows):
    df = rows([("abAB",), ("",), ("x" * 1000,)], "t string")
    got = df.select(L.char_entropy("t").alias("h"), L.compression_ratio("t").alias("c")).collect()
    assert got[0]["h"] == 1.0 and got[1]["h"] == 0.0 and got[1]["c"] == 0.0
    assert got[2]["h"] == 0.0 and got[2]["c"] < 0.1


def test_hapax_finds_umlaut_neighbours_and_skips_names(rows):
    common = " ".join(["måske"] * 5)
    df = rows([(1, common + ". vi maske gik"), (2, "og saa Maaske kom")], "id int, t string")
    got = {r["original"]: r for r in L.hapax_near_common(df, "id", "t").collect()}
    assert got["maske"]["suggested"] == "måske" and got["maske"]["distance"] == 1
    assert got["maske"]["position"] == len(common) + 5
    assert "maaske" not in got


def test_deletion_forms_cover_edit_distance_two(rows):
    df = rows([("kirke", "krike"), ("abc", "xbz")], "a string, b string")
    got = df.select(F.arrays_overlap(L.deletion_forms(F.col("a"), 2), L.deletion_forms(F.col("b"), 2))).collect()
    assert all(r[0] for r in got)


def test_scan_characters_and_errors(rows):
    df = rows([(1, "a´\nb´c «"), (2, "ren")], "id int, t string")
    got = scan_characters(df, "id", "t").orderBy("position").collect()
    assert [(r["position"], r["action"]) for r in got] == [(1, "remove_eol"), (7, "review")]
    e = error_scan(rows([(1, "ok\nTak Tor")], "id int, t string"), "id", "t", ("Tak Tor",)).first()
    assert (e["line_no"], e["offset"]) == (2, 0)


def test_validate_schema(rows):
    df = rows([(1, "", "img/1.jpg", []), (2, "x", "2.jpg", ["a"])], "id int, name string, path string, tags array<string>")
    spec = [{"field": "name", "required": True}, {"field": "path", "prefix": "img/"}, {"field": "tags", "nonempty": True}]
    got = {tuple(r) for r in validate_schema(df, "id", spec).collect()}
    assert got == {(1, "name", "missing"), (1, "tags", "empty"), (2, "path", "prefix")}


def test_long_words_meet_by_parts(spark):
    long = "".join(chr(97 + i * 7 % 26) for i in range(5000))
    pairs = [
        ("forsvarsminister", "forsvarsministre"), ("forsvarsminister", "forsvarministers"), ("forsvarsminister", "xforsvarsministerx"),
        ("forsvarsminister", "forsvarsminist"), ("forsvarsministeren", "forzvarsministerne"), (long, long[:2000] + "x" + long[2001:4000] + long[4001:]),
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    met = F.arrays_overlap(L.word_parts(F.col("a"), 2), L.part_places(F.col("b"), 2))
    near = F.levenshtein("a", "b", 2) >= 0
    rows = df.select(met.alias("met"), near.alias("near"), F.size(L.part_places(F.col("b"), 2)).alias("n")).collect()
    assert any(r.near for r in rows) and all(r.met for r in rows if r.near) and all(r.n <= 75 for r in rows)


def test_hapax_finds_a_word_of_5000_letters(spark):
    long = "".join(chr(97 + i * 7 % 26) for i in range(5000))
    rows = [(i, long + " er her") for i in range(5)] + [(9, "og " + long[:100] + long[101:] + " kom")]
    got = L.hapax_near_common(spark.createDataFrame(rows, "id int, text string"), "id", "text").filter(F.length("original") > 100).collect()
    assert [(r.id, r.distance, r.suggested == long) for r in got] == [(9, 1, True)]
