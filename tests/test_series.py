from datetime import date

from pyspark.sql import functions as F

from missiva.operators import divergence as V
from missiva.operators import scores as S
from missiva.operators import series as R


def sents(rows, docs):
    data = [(d, i, s, f) for d, ss in docs.items() for i, (s, f) in enumerate(ss)]
    return rows(data, "id int, idx int, score double, is_formulaic boolean")


def test_aggregate_falls_back_to_all(rows):
    df = sents(rows, {1: [(0.0, True), (1.0, False), (-1.0, False)], 2: [(0.5, True), (-0.5, True)]})
    got = {r["id"]: r for r in S.aggregate_scores(df, "id").collect()}
    assert got[1]["mean"] == 0.0 and got[1]["p90"] == 0.8 and got[1]["negative_ratio"] == 0.5
    assert got[1]["sentence_count"] == 3 and got[1]["sentence_count_substantive"] == 2
    assert got[2]["mean"] == 0.0 and got[2]["sentence_count_substantive"] == 2


def test_arcs(rows):
    p = lambda *xs: [(x, False) for x in xs]
    df = sents(rows, {1: p(0.5, 0.0, 0.5), 2: p(0.0, 0.5, 0.0), 3: p(0.0, 0.1, 0.5), 4: p(0.5, 0.3, 0.0), 5: p(0.0, 0.9), 6: p(0.0, 0.0, 0.0, 0.05)})
    got = {r["id"]: r["arc_type"] for r in R.classify_arc(df, "id").collect()}
    assert got == {1: "valley", 2: "peak", 3: "rising", 4: "falling", 5: "flat", 6: "flat"}


def test_volatility_needs_two(rows):
    df = sents(rows, {1: [(0.0, False), (1.0, False), (0.5, False)], 2: [(0.3, False), (0.4, True)]})
    got = {r["id"]: r for r in R.volatility_asymmetry(df, "id").collect()}
    assert got[1]["volatility"] == 0.75 and got[1]["asymmetry"] == 0.75
    assert got[2]["volatility"] == 0.0


def test_capped_selection_never_exceeds(rows):
    data = [(d, i, 1.0 - i / 100, ["recipient", "map", "historical", "free"][i % 4]) for d in range(3) for i in range(40)]
    df = rows(data, "doc int, item int, score double, c string")
    got = R.capped_selection(df, "doc", "item", "score", F.col("c"), (("recipient", 2), ("map", 2), ("historical", 1)), 8).collect()
    for d in range(3):
        mine = [r for r in got if r["doc"] == d]
        assert len(mine) == 8
        assert sum(r["item"] % 4 == 0 for r in mine) == 2 and sum(r["item"] % 4 == 2 for r in mine) == 1


def test_rolling_days(rows):
    df = rows([(date(2020, 1, 1), 1.0), (date(2020, 1, 3), 3.0), (date(2020, 1, 3), 5.0), (date(2020, 1, 9), 7.0)], "d date, x double")
    got = {str(r["day"]): r["rolling_mean"] for r in R.rolling_days(df, [], "d", "x", 2).collect()}
    assert got == {"2020-01-01": 1.0, "2020-01-03": 3.0, "2020-01-09": 7.0}


def test_even_sample_and_example(rows):
    df = rows([("k", i, "x" * (85 + i)) for i in range(47)], "k string, i int, t string")
    assert sorted(r["i"] for r in R.even_sample(df, ["k"], ["i"], 20).collect()) == list(range(0, 40, 2))
    assert R.pick_example(df, ["k"], "t", "i").first()["i"] == 5


def test_minmax_constant_and_describe(rows):
    df = rows([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    got = S.minmax_scale(df, ["a", "b"]).collect()
    assert [r["b_scaled"] for r in got] == [0.0, 0.0] and [r["a_scaled"] for r in got] == [0.0, 1.0]
    d = {r["metric"]: r for r in S.describe_methods(df, ["a", "b"]).collect()}
    assert d["a"]["median"] == 2.0 and d["b"]["std"] == 0.0


def test_divergence_bounds_and_symmetry(rows):
    df = rows([("p", "a", "x y z"), ("p", "b", "u v w"), ("q", "a", "x y"), ("q", "b", "x y"), ("r", "a", "x")], "p string, g string, t string")
    ab = {r["p"]: r["jsd"] for r in V.word_divergence(df, "g", "a", "b", "p", "t").collect()}
    ba = {r["p"]: r["jsd"] for r in V.word_divergence(df, "g", "b", "a", "p", "t").collect()}
    assert abs(ab["p"] - 0.6931471805599453 ** 0.5) < 1e-6 and ab["q"] < 1e-6 and "r" not in ab
    assert all(abs(ab[k] - ba[k]) < 1e-9 for k in ab)


def test_travel_log(rows):
    df = rows([(1, "s", date(2020, 1, 1), 0.0, 0.0), (2, "s", date(2020, 1, 1), 0.0, 1.0), (3, "s", date(2020, 1, 5), 0.0, 3.0)], "id int, k string, d date, lat double, lng double")
    got = R.travel_log(df, ["k"], "d", "id").orderBy("id").collect()
    deg = 111.19492664455873
    assert abs(got[1]["km_per_day"] - deg) < 1e-6 and abs(got[2]["total_km"] - 3 * deg) < 1e-6
    assert abs(got[2]["km_per_day"] - deg / 2) < 1e-6
