from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators import corrections as C
from missiva.operators import epithets as E
from missiva.operators import profile as P
from missiva.operators import quality as Q


def correct(rows, text, rules=C.DEFAULT_RULES):
    return C.apply_corrections(rows([(1, text)], "id int, t string"), "id", "t", rules)


def test_default_rules(rows):
    got = correct(rows, "Tak Tor sidst. Love.e det, skál du? ? Han gik.Ja, morsomt.Jeg ude st gaa «Regt.Staben dia´").first()
    assert got["text_corrected"] == "Tak for sidst. Lovede det, skal du? Han gik.Ja, morsomt. Jeg ude at gaa «Regt.Staben du"
    assert {c["category"] for c in got["corrections"]} == {"encoding_artifact", "ocr_artifact", "typing_error"}
    flagged = [c for c in got["corrections"] if c["corrected"] is None]
    assert [c["original"] for c in flagged] == ["«"]


def test_rules_need_their_context(rows):
    got = correct(rows, "Brandenburger Tor. Dia er st").first()
    assert got["text_corrected"] == "Brandenburger Tor. Dia er st"


def test_guards_see_the_whole_window(rows):
    gap = " " * 12
    for text, want in [
        ("Feldpost\nhan sider.Jeg kom", None), ("Feldpost" + " " * 31 + "morsomt.Jeg", None), ("Feldpost" + " " * 41 + "morsomt.Jeg", "morsomt. Je"),
        (f"Tak{gap}Tor", "for"), (f"han.{gap}Dia er", None), (f"Ja{gap}Dia er", "Du"), (f"ude{gap}st gaa", "at"),
    ]:
        got = [(c["position"], c["corrected"]) for c in correct(rows, text).first()["corrections"]]
        assert [c for _, c in got] == ([want] if want else [])
        assert all(text[p] in "mTDs" for p, _ in got)


def test_words_before_decide(rows):
    got = correct(rows, "Korn han korn korn. Rug korn og sæd  korn, mark, korn. Den lier, og lier vj Vj").first()
    assert got["text_corrected"] == "Kom han kom kom. Rug korn og sæd  korn, mark, kom. Den her, og lier vi Vi"


def test_overlaps_apply_from_the_right(rows):
    rules = (C.ScanRule("abc", "X", "a"), C.ScanRule("cd", "Y", "b"))
    assert correct(rows, "abcd", rules).first()["text_corrected"] == "abY"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab.cé Tor", max_size=30))
def test_corrections_can_be_undone(rows, text):
    rules = (C.ScanRule("é", "e", "x"), C.ScanRule(r"[a-c]\.T", "$1 $2", "y", inner=r"(.)\.(.)"), C.ScanRule("oo", "", "z"))
    checks = C.validate_corrections(correct(rows, text, rules), "id", lo=0.0, hi=9.0, allowed="[\\s\\S]", known_errors=()).collect()
    assert not [c for c in checks if c["check"] in ("round_trip", "position", "overlap")]


def test_each_check_can_fail(rows):
    sch = "id int, text_source string, text_corrected string, corrections array<struct<position:int,original:string,corrected:string>>"
    df = rows(
        [(1, "abc", "abd", [(2, "c", "x")]), (2, "abc", "abc ☃ dia x", []), (3, "abcd", "abcd", [(9, "zz", None)]), (4, "abcd", "XYd", [(0, "ab", "X"), (1, "bc", "Y")]), (5, "a«", "a«", [(1, "«", None)])],
        sch,
    )
    got = {(r["id"], r["check"]) for r in C.validate_corrections(df, "id").collect()}
    assert (1, "round_trip") in got and {(2, "alphabet"), (2, "known_error"), (2, "length_ratio")} <= got
    assert (3, "position") in got and (4, "overlap") in got and not [g for g in got if g[0] == 5]


def test_positions_and_sentence(rows):
    df = rows([("Han kom. Saa gik hun hjem. Slut.",)], "t string")
    m = df.select(T.match_positions(F.col("t"), "gik").alias("m"), "t")
    p = m.first()["m"][0]
    assert (p["position"], p["original"]) == (13, "gik")
    got = m.select(C.context_sentence(F.col("t"), F.lit(13), F.lit("gik")).alias("s")).first()["s"]
    assert got == "Saa gik hun hjem."


def test_epithet_use_and_referent(rows):
    texts = [
        (1, date(1915, 1, 1), "Saa kom den gamle og lo. Han er streng."), (2, date(1913, 1, 1), "den gamle kone. Onkel kom."),
        (3, date(1913, 1, 1), "Far skrev; den gamle, ved."), (4, date(1913, 1, 1), "Hun sagde den gamle. hende"),
        (5, date(1912, 1, 1), "mor og børn hjemme: den gamle er god"), (6, date(1913, 1, 1), "den gamle Henningsen"),
    ]
    lt = rows(texts, "id int, date date, t string")
    m = E.scan_epithets(lt, "id", "t")
    use = {(r["id"], r["pattern"]): r["usage"] for r in m.collect()}
    assert use[(1, "den gamle")] == "substantive" and use[(2, "den gamle")] == "adjective" and use[(6, "den gamle")] == "adjective"
    assert use[(2, "Onkel")] == "substantive"
    ref = {(r["id"], r["pattern"]): r["referent"] for r in E.resolve_epithets(m, lt, "id", "date", "t").collect()}
    assert ref[(1, "den gamle")] == "military_superior" and ref[(3, "den gamle")] == "military_superior"
    assert ref[(4, "den gamle")] == "other" and ref[(5, "den gamle")] == "father"
    assert (2, "Onkel") in ref and ref[(2, "Onkel")] is None
    ev = E.resolution_evidence(E.resolve_epithets(m, lt, "id", "date", "t"), "id", (("military_superior", 1), ("father", 1), ("other", 1)))
    assert ev.filter("pattern = 'den gamle'").count() == 3


def test_syntax_by_hand(rows):
    t = rows(
        [(1, 0, 0, 1, "nsubj", "NOUN", None), (1, 0, 1, 1, "ROOT", "VERB", "Past"), (1, 0, 2, 3, "mark", "DET", None), (1, 0, 3, 1, "advcl", "VERB", "Pres"), (1, 1, 4, 4, "ROOT", "NOUN", None)],
        "doc_id int, sent_id int, i int, head_i int, dep string, pos string, tense string",
    )
    m = P.syntax_metrics(t).first()
    assert m["mean_dependency_distance"] == 4 / 3 and m["max_dependency_distance"] == 2 and m["max_tree_depth"] == 2
    assert m["mean_sentence_length"] == 2.5 and m["subordinate_clause_ratio"] == 0.5 and m["past_tense_ratio"] == 0.5
    assert m["lexical_density"] == 0.8


def test_triage(rows):
    f = rows([(1, 0, "hund", False), (1, 5, "xq", False), (1, 9, "Løtzen", True)], "doc_id int, position int, original string, capital boolean")
    t = rows([(1, 0, 0, "hunden", "NOUN", "hund", "", False), (1, 5, 0, "abc", "X", "abc", "", True), (1, 9, 2, "løtzen", "PROPN", "løtzen", "LOC", True)],
             "doc_id int, position int, i int, token string, pos string, lemma string, ent string, is_oov boolean")
    got = {r["position"]: (r["valid_score"], r["suspicious_score"], r["classification"]) for r in P.triage_candidates(f, t).collect()}
    assert got == {0: (2, 0, "likely_valid"), 5: (0, 3, "review_required"), 9: (5, 1, "likely_valid")}


def test_profile_of_an_empty_document(rows):
    lt = rows([(1, date(2020, 1, 1), "m", "jeg og vi tænker altid paa kaserne"), (2, None, "m", "")], "doc_id int, date date, recipient string, t string")
    got = {r["doc_id"]: r.asDict() for r in P.assemble_profile(lt, "doc_id", "t").collect()}
    assert got[2]["word_count"] == 0 and got[2]["mattr"] is None and got[2]["char_entropy"] == 0 and got[2]["hedging_rate"] == 0
    assert got[1]["singular_share"] == 0.5 and got[1]["term_count"] == 1 and round(got[1]["absolutist_rate"], 4) == 14.2857


def test_second_run_finds_nothing_changed(rows):
    df = rows([(1, "a"), (2, None)], "id int, t string")
    fp = Q.fingerprint(df, "id", ["t"])
    assert Q.changed_rows(fp, fp, "id").count() == 0
    new = Q.fingerprint(rows([(1, "b"), (2, None), (3, "c")], "id int, t string"), "id", ["t"])
    assert sorted(r["id"] for r in Q.changed_rows(new, fp, "id").collect()) == [1, 3]


def test_require(rows):
    import pytest

    with pytest.raises(ValueError):
        Q.require(rows([(1,)], "id int"), 2)


def test_very_many_fixes_are_put_in_at_once(spark):
    import time

    text = "á " * 10_000 + "ende ¥"
    df = spark.createDataFrame([(1, text), (2, "á" * 3), (3, "intet")], "id int, t string")
    start = time.perf_counter()
    done = C.apply_corrections(df, "id", "t", C.DEFAULT_RULES)
    got = {r["id"]: r["text_corrected"] for r in done.collect()}
    assert got == {1: "a " * 10_000 + "ende W", 2: "aaa", 3: "intet"}
    assert C.validate_corrections(done, "id").filter("check IN ('round_trip', 'position', 'overlap')").count() == 0
    # A copy of the text per fix would take minutes.
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("few", [0, 32])
def test_fixes_that_lie_apart_or_overlap(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_FIXES", few)
    rules = [C.ScanRule("ab", "X", "a"), C.ScanRule("bc", "YYY", "b"), C.ScanRule("\U0001f600", "", "c"), C.ScanRule("ø", "oe", "d")]
    df = spark.createDataFrame([(1, "abcab \U0001f600ø\U0001f600 bc"), (2, "ab bc ø"), (3, ""), (4, None), (5, "øø\U0001f600")], "id int, t string")
    got = {r["id"]: r["text_corrected"] for r in C.apply_corrections(df, "id", "t", rules).collect()}
    # In text 1 the second rule takes the b that the first one wants too.
    assert got == {1: "aYYYX oe YYY", 2: "X YYY oe", 3: "", 4: None, 5: "oeoe"}
