"""Exact quantiles and hash samples of groups larger than what one task may order."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import breakpoint, points, ranks

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def series():
    rng = np.random.default_rng(9)
    return {
        "even": rng.uniform(-1, 1, 3000).tolist(), "heavy": (rng.pareto(0.3, 2000) * rng.choice([-1, 1], 2000)).tolist(), "ties": rng.integers(0, 5, 1500).astype(float).tolist(),
        "one": [2.5], "two": [-1.0, 4.0], "same": [7.0] * 900, "edges": [-math.inf, -1e308, -5e-324, -0.0, 0.0, 5e-324, 1e-310, 1e308, math.inf] * 40, None: rng.normal(size=700).tolist(),
    }


@pytest.mark.parametrize("how", [{}, {"most": 40, "parts": 8}, {"most": 1, "parts": 64}])
def test_quantiles_are_exact(spark, how):
    data = series()
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["q"] for r in ranks.exact_quantiles(df, ["g"], "x", QS, "q", **how).collect()}
    assert got.keys() == data.keys()
    for g, xs in data.items():
        xs = sorted(xs)
        for q, v in zip(QS, got[g], strict=True):
            place = (len(xs) - 1) * q
            low, high = xs[math.floor(place)], xs[math.ceil(place)]
            assert v == low == high or v == pytest.approx(low + (place - math.floor(place)) * (high - low), rel=1e-12, abs=1e-300)


def test_quantiles_of_the_whole_table_and_of_nothing(spark):
    df = spark.range(10001).select((F.col("id") * 1.0).alias("x"))
    assert ranks.exact_quantiles(df, [], "x", [0.0, 0.5, 1.0], "q", most=100, parts=16).first()["q"] == [0.0, 5000.0, 10000.0]
    assert ranks.exact_quantiles(df.where("x < 0"), [], "x", [0.5], "q").count() == 0


def test_no_task_orders_a_group(spark):
    """Of 20,000 different values, what is put in order has `most` rows for each rank at most."""
    df = spark.range(20000).select(F.lit("g").alias("zone"), (F.sqrt("id") * 1.0).alias("x"), F.lit(1).alias("y"))
    at = ranks.exact_quantiles(df, ["zone"], "x", [0.1, 0.9], "_p", most=50, parts=32)
    assert at.first()["_p"] == pytest.approx([math.sqrt(1999) * 0.1 + math.sqrt(2000) * 0.9, math.sqrt(17999) * 0.9 + math.sqrt(18000) * 0.1], rel=1e-6)
    plan = at._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert breakpoint.theta_range(df, most=50, parts=32).first()["p10"] == at.first()["_p"][0]
    bins = points.quantile_bins(df, ["zone"], most=50, parts=32).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in bins) == [2000] * 10


@pytest.mark.parametrize("how", [{}, {"most": 3, "digits": 1}])
def test_samples_are_the_smallest_hashes(spark, how):
    df = spark.range(3000).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 3 > 0, "a").alias("g"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1).alias("_n"))
    h = lambda *key: hashlib.md5("-".join(map(str, key)).encode()).hexdigest()
    one = points.hash_sample(df, ["cell_id"], 57, **how)
    assert one.columns == df.columns
    assert sorted(r["cell_id"] for r in one.collect()) == sorted(sorted(range(3000), key=lambda k: h(k, 42))[:57])
    assert points.hash_sample(df, ["cell_id"], 5000, **how).count() == 3000 and points.hash_sample(df, ["cell_id"], 0, **how).count() == 0
    got = points.case_control_sample(df, ["g"], ["cell_id"], 20, **how).collect()
    for g in ("a", None):
        for y in (0, 1):
            ids = [k for k in range(3000) if ("a" if k % 3 else None) == g and k % 2 == y]
            want = sorted(ids, key=lambda k: h(*([g] if g else []), k, 42))[:20]
            assert sorted(r["cell_id"] for r in got if r["g"] == g and r["y"] == y) == sorted(want)
    repeats = spark.createDataFrame([(1,)] * 30 + [(2,)] * 30, "cell_id long")
    assert points.hash_sample(repeats, ["cell_id"], 40, **how).count() == 40


def test_sample_sizes_by_group(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    sizes = spark.createDataFrame([(0, 5), (1, 0), (2, 10**6)], "k long, n long")
    got = {r["k"]: r["n"] for r in ranks.smallest(df, ["k"], "h", ["id"], sizes, most=4, digits=1).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 5, 2: 250}
