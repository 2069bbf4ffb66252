"""The block-wise routes must agree with plain windows, hot keys and ties included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from missiva.operators import divergence as V
from missiva.operators import scale as C
from missiva.operators import scores as S
from missiva.operators import series as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"k{i % 17}", i, rng.choice([0.0, 0.5, 1.0, rng.random()])) for i in range(3000)]
    return spark.createDataFrame(data, "k string, i int, x double").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_number_rows(skewed):
    same(C.number_rows(skewed, ["k"], ["x", "i"]), C.number_rows(skewed, ["k"], ["x", "i"], limit=50))
    same(C.number_rows(skewed, [], [F.col("x").desc(), "i"]), C.number_rows(skewed, [], [F.col("x").desc(), "i"], limit=50))


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [("a", i) for i in range(5)], "k string, i int")
    same(C.number_rows(df, ["k"], ["i"]), C.number_rows(df, ["k"], ["i"], limit=3))


def test_neighbours(skewed):
    a = R.centered_rolling_mean(skewed, ["k"], ["i"], "x").withColumn("smoothed", F.round("smoothed", 9))
    b = R.centered_rolling_mean(skewed, ["k"], ["i"], "x", limit=40).withColumn("smoothed", F.round("smoothed", 9))
    same(a, b)
    same(R.velocity(skewed, ["k"], ["i"], "x"), R.velocity(skewed, ["k"], ["i"], "x", limit=40))


def test_percentiles(skewed):
    probs = {"q1": 0.25, "p10": 0.1, "m": 0.5, "top": 1.0}
    a = {(r["k"], r["metric"]): r for r in C.percentiles(skewed, ["k"], ["x"], probs).collect()}
    b = C.percentiles(skewed, ["k"], ["x"], probs, limit=20).collect()
    assert len(a) == len(b)
    for r in b:
        for p in probs:
            assert abs(r[p] - a[(r["k"], r["metric"])][p]) < 1e-12


def test_ranks_and_spearman(skewed):
    got = S.correlate(skewed, "x", "i", limit=100).first()
    pdf = skewed.toPandas()
    assert abs(got["spearman"] - pdf["x"].rank().corr(pdf["i"].rank())) < 1e-9
    assert abs(got["pearson"] - pdf["x"].corr(pdf["i"])) < 1e-9


def test_wasserstein_shift(spark):
    data = [("p", "a", float(v)) for v in range(50)] + [("p", "b", v + 2.5) for v in range(50)] + [("q", "a", 1.0)]
    df = spark.createDataFrame(data, "p string, g string, x double")
    for limit in (1000, 7):
        got = {r["p"]: r["wasserstein"] for r in V.wasserstein_1d(df, "g", "a", "b", "p", "x", limit).collect()}
        assert abs(got["p"] - 2.5) < 1e-9 and got["q"] == 0.0


def cusum(v, k=0.5, h=1.5):
    z = (v - v.mean()) / v.std()
    p = n = 0.0
    out = []
    for i in range(1, len(z)):
        p, n = max(0.0, p + z[i] - k), max(0.0, n - z[i] - k)
        if p > h or n > h:
            out.append((i, "positive" if p > h else "negative"))
            p = n = 0.0
    return out


@pytest.mark.parametrize("block", [3, 20, 5000])
def test_cusum_blocks_agree_with_the_sequential_run(spark, block):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=200), "b": np.repeat([0.1, 0.9, 0.2], 40) + rng.normal(size=120) * 0.1, "c": np.ones(10)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, i int, x double")
    got = R.cusum_change_points(df, ["k"], ["i"], "x", block=block).collect()
    for k in ("a", "b"):
        assert sorted((r["index"], r["direction"]) for r in got if r["k"] == k) == cusum(series[k])
    assert not [r for r in got if r["k"] == "c"]


def test_broadcast_only_when_small(spark):
    df = spark.range(100).withColumn("s", F.lit("x" * 100))
    assert "broadcast" in C.bounded_broadcast(df)._jdf.queryExecution().logical().toString().lower()
    for kw in ({"rows": 10}, {"size": 1000}):
        assert "broadcast" not in C.bounded_broadcast(df, **kw)._jdf.queryExecution().logical().toString().lower()
