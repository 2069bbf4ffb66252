"""Joins and counts whose work or memory must not grow faster than their input."""

import datetime
import math
import random
from collections import Counter
from itertools import combinations

import pytest

from missiva.operators import graph as G
from missiva.operators import scale

DAY = datetime.date


def brute_pairs(rows, least):
    docs = {}
    for doc, name, date in rows:
        if doc is not None and name is not None:
            known = docs.setdefault(doc, {})
            known[name] = min(known.get(name, date.year), date.year)
    got, whole = Counter(), Counter()
    for names in docs.values():
        for a, b in combinations(sorted(names), 2):
            got[a, b, names[a]] += 1
            whole[a, b] += 1
    return sorted((*k, n) for k, n in got.items() if whole[k[:2]] >= least)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_of_large_documents_with_rare_names(rows, monkeypatch, least):
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    rnd = random.Random(least)
    data = []
    for doc in range(60):
        size = rnd.choice((1, 2, 3, 4, 9, 14))
        # Names from 30 on are in few large documents.
        data += [(doc, rnd.choice((rnd.randrange(12), rnd.randrange(60))), DAY(1990 + rnd.randrange(3), 1, 1)) for _ in range(size)]
    data += [(None, 1, DAY(1990, 1, 1)), (None, 2, DAY(1990, 1, 1)), (3, None, DAY(1990, 1, 1))]
    out = G.pair_years(rows(data, "doc long, id long, date date"), min_weight=least, heavy=4)
    # The partitions follow the rows, so that a task's memory does not.
    assert out.rdd.getNumPartitions() > 4
    assert sorted(tuple(r) for r in out.collect()) == brute_pairs(data, least)


def test_names_of_large_documents_are_not_looked_up_in_all_of_them(rows, monkeypatch):
    # Every name is in many large documents: they list their pairs, nothing is looked up.
    monkeypatch.setattr(G, "_looked_up", lambda *a: pytest.fail("looked up"))
    data = [(d, n, DAY(1990, 1, 1)) for d in range(20) for n in range(6)] + [(50 + n, m, DAY(1990, 1, 1)) for n in range(5) for m in (n, n + 1)]
    out = G.pair_years(rows(data, "doc long, id long, date date"), heavy=3)
    assert sorted(tuple(r) for r in out.collect()) == brute_pairs(data, 2)


def test_same_day_pairs_scores_whole_texts(spark, tmp_path):
    from missiva.operators.scores import aggregate_scores  # noqa: F401
    from missiva.plans import load_all
    from missiva.plans.catalog import QUERIES, SQL

    load_all()
    assert "FROM documents" in SQL["same_day_pairs"]
    texts = [(0, "La vie est un roman.", "fr"), (1460, "Der Mann und die Frau. Nicht auch.", "de"), (1, "Das und die Sache.", "de"), (2920, None, "fr")]
    spark.createDataFrame([(i, t, g, "s", 9) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = {(r["date"], r["id_a"], r["id_b"]): r["mean_diff"] for r in QUERIES["same_day_pairs"](spark, str(tmp_path)).collect()}
    assert ("2020-01", 0, 1460) in got and got["2020-01", 0, 1460] > 0
    assert all(k[2] != 1 for k in got)


def test_pairs_of_a_crowded_spot_come_from_many_tasks(rows):
    from missiva.operators import spatial

    a = rows([(i, 10.0, 20.0) for i in range(1000)] + [(5000, None, 20.0)], "a long, lat double, lng double")
    b = rows([(i, 10.0, 20.0 + i / 1000) for i in range(9)] + [(99, 50.0, 20.0), (98, None, None)], "b long, lat double, lng double")
    out = spatial.proximity_pairs(a, b, "a", "b", 5.0, dp=3)
    full = [len(p) for p in out.rdd.glom().collect()]
    assert sum(full) == 9000 and sum(n > 0 for n in full) > 2 and max(full) < 5000
    assert {r["km"] for r in out.collect()} == {r["km"] for r in out.filter("km = round(km, 3)").collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_points_meet_lists_and_no_pair_is_shuffled(rows, monkeypatch, broadcast):
    from missiva.operators import spatial

    monkeypatch.setattr(spatial, "LIST_ROWS", 3, raising=False)
    monkeypatch.setattr(spatial, "SPOT_ROWS", 5, raising=False)
    if not broadcast:
        monkeypatch.setattr(spatial, "bounded_broadcast", lambda df: df)
    rnd = random.Random(3)
    at = lambda: rnd.choice((None, 10.0, 10.01, 10.02, 10.03, 11.0))
    a = [(rnd.choice((None, i, i, i)), at(), at()) for i in range(80)]
    b = [(rnd.choice((None, f"b{i}", f"b{i // 2}")), at(), at()) for i in range(60)]
    out = spatial.proximity_pairs(rows(a, "a long, lat double, lng double"), rows(b, "b string, lat double, lng double"), "a", "b", 3.0)

    def km(x, y):
        (p, q), (r, s) = (map(math.radians, z) for z in (x, y))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = Counter()
    for i, *x in a:
        for j, *y in b:
            if None not in (*x, *y) and km(x, y) <= 3:
                want[i, j, round(km(x, y), 6)] += 1
    got = out.collect()
    assert Counter((r["a"], r["b"], round(r["km"], 6)) for r in got) == want and len(got) > 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_gazetteer_pairs_are_reduced_where_they_are_made(rows, monkeypatch):
    from missiva.operators import spatial

    def listed(*a, **kw):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(spatial, "proximity_pairs", listed)
    rnd = random.Random(8)
    at = lambda: rnd.choice((None, 10.0, 10.02, 10.03, 10.06, 10.09, 12.0))
    name = lambda: rnd.choice((None, "Aa", "AA (by)", "aab", "Zz", "Xyz"))
    places = [(rnd.choice((None, i, i // 2)), name(), at(), 20.0) for i in range(120)]
    entries = [(rnd.choice((None, i, i // 2)), name(), at(), rnd.choice((20.0, 20.01, None))) for i in range(14)]
    pl, gz = rows(places, "place_id long, place string, lat double, lng double"), rows(entries, "gaz_id long, label string, lat double, lng double")
    over = rows([(4, 77)], "place_id long, gaz_id long")
    out = spatial.gazetteer_match(pl, gz, over, near=0.5, far=6.0)

    def km(x, y):
        (p, q), (r, s) = (map(math.radians, z) for z in (x, y))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    fold = lambda x: (x or "").lower().split(" (")[0].replace("aa", "å")
    spot = lambda x, y: None not in (*x[2:], *y[2:]) and km(x[2:], y[2:])
    want = Counter()
    for k, *_ in places:
        mine = [p for p in places if k is not None and p[0] == k]
        near = [(1 if d <= 0.5 else 2, d, e[0]) for p in mine for e in entries if (d := spot(p, e)) is not False and d <= 6]
        best = [
            (not (fold(p[1]) in fold(e[1]) or fold(e[1]) in fold(p[1])), d, g)
            for t, d, g in near if t == min(n[0] for n in near) and g is not None for p in mine for e in entries if e[0] == g
        ] if near else []
        method = f"coordinate_{0.5 if min(n[0] for n in near) == 1 else 6}km" if best else "unmatched"
        want[(k, 77, "manual_override") if k == 4 else (k, min(best)[2] if best else None, method)] += 1
    got = Counter((r["place_id"], r["gaz_id"], r["match_method"]) for r in out.collect())
    assert got == want and len({k[2] for k in want}) == 4


@pytest.mark.parametrize("broadcast", [True, False])
def test_image_pairs_are_made_once_and_never_shuffled(rows, monkeypatch, broadcast):
    from missiva.operators import entities as N

    if not broadcast:
        monkeypatch.setattr(N, "bounded_broadcast", lambda df: df)
        monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    rnd = random.Random(5)
    some = lambda pool: rnd.choice((None, [], rnd.choices(pool, k=rnd.randrange(1, 4))))
    day = lambda: rnd.choice((None, DAY(2020, 1, 1) + datetime.timedelta(rnd.randrange(900))))
    people, spots = ["a", "b", "c", "src", None], ["p", "q", "r", None]
    kinds = ["portrait", "map", "historical", "document", "place", "group"]
    docs = [(rnd.choice((None, n, n)), day(), some(spots), some(people), some(people)) for n in range(60)]
    docs += docs[:5]
    images = [(n, day(), some(spots), some(people), rnd.choice(kinds)) for n in range(40)]
    d = rows(docs, "doc_id int, date date, places array<string>, persons array<string>, recipients array<string>")
    i = rows(images, "image_id int, date date, places array<string>, persons array<string>, category string")
    out = N.score_pairs(d, i, frequent=("src",))
    held = lambda x, y: {v for v in x or [] if v} & {v for v in y or [] if v}
    want = Counter()
    for k, dd, dp, dn, dr in docs:
        for m, di, ip, inn, c in images:
            place, person, rec = held(dp, ip), held(dn, inn), held(dr, inn)
            gap = abs((dd - di).days) if dd and di else None
            bonus = 0.0 if gap is None or gap > 365 else 0.1 if gap > 92 else 0.2 if gap > 31 else 0.3
            found = place or (dn is not None and dr is not None and (person or rec)) or (gap is not None and gap <= 92)
            if k is None or not found:
                continue
            kind = "place+person" if place and (person or rec) else "place" if place else "recipient" if rec else "person" if person else "date" if bonus >= 0.2 else "context"
            want[k, m, kind] += kind != "context"
    got = Counter((r["doc_id"], r["image_id"], r["relevance"]) for r in out.collect())
    assert got and all(want[k] == n for k, n in got.items())
    sure = {k for k in want if k[2] in ("place+person",) and images[k[1]][4] in ("group", "place")}
    assert sure <= set(got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # No pair is dealt again after the sides have met.
    assert "HashAggregate" not in plan


@pytest.mark.parametrize("frequent", [(), ("a", "src")])
def test_held_images_give_the_pairs_of_the_keyed_route(rows, monkeypatch, frequent):
    from missiva.operators import entities as N

    rnd = random.Random(9)
    some = lambda pool: rnd.choice((None, [], rnd.choices(pool, k=rnd.randrange(1, 4)), [rnd.choice(pool)]))
    day = lambda: rnd.choice((None, DAY(2020, 1, 1) + datetime.timedelta(rnd.randrange(900))))
    people, spots, kinds = ["a", "b", "c", "src", None], ["p", "q", "r", None], ["portrait", "map", "historical", "document", "place", "group", None]
    docs = [(rnd.choice((None, n, n, n)), day(), some(spots), some(people), some(people)) for n in range(150)]
    images = [(rnd.choice((None, f"i{n // 2}", f"i{n}")), day(), some(spots), some(people), rnd.choice(kinds)) for n in range(90)]
    d = rows(docs, "doc_id int, date date, places array<string>, persons array<string>, recipients array<string>")
    i = rows(images, "image_id string, date date, places array<string>, persons array<string>, category string")
    keyed = []
    meet = N._meet
    monkeypatch.setattr(N, "_meet", lambda *a: keyed.append(1) or meet(*a))
    monkeypatch.setattr(N, "BATCH_PAIRS", 50, raising=False)
    held = N.score_pairs(d, i, frequent)
    got = [Counter(map(tuple, held.collect()))]
    assert not keyed and len(got[0]) > 1000
    # Within a task the pairs lie in the order of a shortlist.
    parts = held.rdd.glom().collect()
    assert all(p == sorted(p, key=lambda r: (r["doc_id"], -r["score"], r["image_id"])) for p in parts)
    monkeypatch.setattr(N, "bounded_broadcast", lambda df: df)
    got.append(Counter(map(tuple, N.score_pairs(d, i, frequent).collect())))
    assert keyed and got[0] == got[1]
    assert N.score_pairs(d, i.limit(0), frequent).count() == N.score_pairs(d.limit(0), i, frequent).count() == 0


def test_both_directions_work_the_edges_out_once(rows):
    e = rows([(1, 2, 3), (2, 4, 1), (None, 4, 1)], "a int, b int, weight int").groupBy("a", "b").sum("weight").withColumnRenamed("sum(weight)", "weight")
    out = G.directed(e)
    assert sorted(map(tuple, out.dropna().collect())) == [(1, 2, 3), (2, 1, 3), (2, 4, 1), (4, 2, 1)] and out.count() == 6
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_moves_texts_once(rows, monkeypatch):
    import math

    from missiva.operators import lexical

    monkeypatch.setattr(scale, "TASK_ROWS", 1)
    texts = [(1, "aa bb aa"), (1, "cc"), (2, "bb dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt uu vv ww xx yy zz" * 2), (3, None), (None, "aa")]
    out = lexical.tfidf(rows(texts, "id long, text string"), "id", "text")
    got = {(r["id"], r["token"]): r["weight"] for r in out.collect()}
    w = {"aa": 2 * (math.log(6 / 3) + 1), "bb": math.log(6 / 3) + 1, "cc": math.log(6 / 2) + 1}
    norm = math.sqrt(sum(x * x for x in w.values()))
    assert all(abs(got[1, k] - x / norm) < 1e-12 for k, x in w.items()) and abs(got[None, "aa"] - 1) < 1e-12
    assert out.rdd.getNumPartitions() > 4
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("columns", [1_000_000, 0])
def test_principal_components_leave_the_weights_where_they_lie(spark, monkeypatch, columns):
    import numpy as np

    from missiva.operators import vectors as V

    rng = np.random.default_rng(3)
    x = rng.random((40, 25)) * (rng.random((40, 25)) > 0.5)
    x[:, 0] *= 6
    x[:, 1] *= 4
    long = spark.createDataFrame([(f"r{i}", f"c{j}", float(x[i, j])) for i in range(40) for j in range(25) if x[i, j]], "r string, c string, w double")
    joined, real = [], V._scores
    monkeypatch.setattr(V, "_scores", lambda *a: joined.append(1) or real(*a))
    monkeypatch.setattr(V, "BROADCAST_COLUMNS", columns, raising=False)
    # Rows go on over many batches.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = np.array([(r["pc1"], r["pc2"]) for r in sorted(V.pca_long(long, "r", "c", "w", 2).collect(), key=lambda r: int(r["r"][1:]))])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-3)
    # With columns that fit a broadcast no round joins and sums the weights by row; only the final scores do.
    assert (len(joined) == 1) == (columns > 0)


def test_arcs_travel_as_numbers(rows):
    from missiva.operators import profile as P

    def by_hand(arcs):
        head = dict(arcs)
        depth = lambda t: 0 if head.get(t, t) == t else 1 + depth(head[t])
        return max(map(depth, head))

    rnd = random.Random(2)
    far = 70_000
    sents = {(d, s): [(i + far * (d == 3), (rnd.randrange(i) if i else 0) + far * (d == 3)) for i in range(rnd.randrange(1, 40))] for d in range(5) for s in range(9)}
    sents[4, 0] = [(-3, 5), (5, far), (far, far), (2, None)]
    data = [(d, s, i, h, rnd.choice(("ROOT", "mark", None, "x")), rnd.choice(("VERB", "NOUN", None)), rnd.choice(("Past", "Pres", None))) for (d, s), arcs in sents.items() for i, h in arcs]
    for kind in ("int", "long"):
        t = rows(data, f"doc_id int, sent_id int, i {kind}, head_i {kind}, dep string, pos string, tense string")
        out = P.syntax_metrics(t)
        for r in out.collect():
            mine = [x for x in data if x[0] == r["doc_id"]]
            gaps = [abs(i - h) for _, _, i, h, dep, _, _ in mine if dep not in (None, "ROOT") and h is not None]
            assert r["max_dependency_distance"] == max(gaps) and abs(r["mean_dependency_distance"] - sum(gaps) / len(gaps)) < 1e-9
            assert r["lexical_density"] == sum(x[5] in ("VERB", "NOUN") for x in mine) / len(mine) and r["mean_sentence_length"] == len(mine) / 9
            if r["doc_id"] < 4:
                assert r["max_tree_depth"] == max(by_hand(arcs) for (d, _), arcs in sents.items() if d == r["doc_id"])
    assert "shiftleft" in out._jdf.queryExecution().optimizedPlan().toString()


def test_markers_split_a_text_once(rows):
    from missiva.operators import lexical

    out = lexical.marker_rates(rows([(1, "Jeg og vi, jeg"), (2, None), (3, "")], "id int, t string"), "id", "t")
    got = {r["id"]: (r["tokens"], round(r["first_person_singular_rate"], 3), r["first_person_plural_rate"]) for r in out.collect()}
    assert got == {1: (4, 50.0, 0.0), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_richness_equals_the_plain_count():
    from missiva.operators.lexical import _factors, _richness

    rnd = random.Random(4)
    for n in (1, 41, 42, 49, 50, 51, 300):
        words = [f"w{int(60 * rnd.random() ** 2)}" for _ in range(n)]
        r = _richness(words, 50, 0.72, 42)
        shares = [len(set(words[k : k + 50])) / 50 for k in range(n - 49)] or [len(set(words)) / n]
        factors = []
        for way in (words, words[::-1]):
            seen, k, f = set(), 0, 0.0
            for w in way:
                seen.add(w)
                k += 1
                if len(seen) / k <= 0.72:
                    seen, k, f = set(), 0, f + 1
            factors.append(f + ((1 - len(seen) / k) / (1 - 0.72) if k else 0))
        assert [_factors(w, 0.72) for w in (words, words[::-1])] == factors
        assert r[:2] == (n, len(set(words))) and abs(r[3] - sum(shares) / len(shares)) < 1e-12 and abs(r[4] - sum(n / (f or 1) for f in factors) / 2) < 1e-9
        assert r[6] == sum(c == 1 for c in Counter(words).values()) / n
