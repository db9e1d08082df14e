"""Calibration blocks against pool-adjacent-violators and the minimax formula on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlake.operators import isotonic as I
from leadlake.operators import train as TR


def minimax(x, y, w):
    """(score, fitted value) of every distinct score: the greatest lower of all means of runs through it."""
    xs = sorted(set(x))
    total = [sum(b * c for a, b, c in zip(x, y, w, strict=True) if a == v) for v in xs]
    weight = [sum(c for a, c in zip(x, w, strict=True) if a == v) for v in xs]
    n = len(xs)
    mean = lambda a, b: sum(total[a:b + 1]) / sum(weight[a:b + 1])
    low = [[None] * n for _ in range(n)]
    for a in range(n):
        best = float("inf")
        for b in range(n - 1, a - 1, -1):
            best = min(best, mean(a, b))
            low[a][b] = best
    return {xs[i]: max(low[a][i] for a in range(i + 1)) for i in range(n)}


def rows_of(spark, groups):
    data = [(g, float(a), float(b), float(c)) for g, (x, y, w) in groups.items() for a, b, c in zip(x, y, w, strict=True)]
    return spark.createDataFrame(data, "g string, s double, y double, w double").repartition(5)


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_blocks_against_minimax(spark, ranges):
    rng = np.random.default_rng(ranges)
    groups = {}
    for g, n, levels in ((None, 60, 1000), ("ties", 90, 7), ("rising", 40, 1000), ("one", 1, 5), ("flat", 30, 1000)):
        x = rng.integers(0, levels, n) / 8
        y = {"rising": x, "flat": np.ones(n)}.get(g, (rng.random(n) < x / (levels / 8)).astype(float))
        groups[g] = x, y, rng.integers(1, 5, n)
    found = I.isotonic_blocks(rows_of(spark, groups), "s", "y", ["g"], "w", ranges).collect()
    for g, (x, y, w) in groups.items():
        expected = minimax(x.tolist(), y.tolist(), w.tolist())
        blocks = sorted((r for r in found if r.g == g), key=lambda r: r.lo)
        values = [r.value for r in blocks]
        assert values == sorted(set(values)) and sum(r.weight for r in blocks) == w.sum()
        for v, fitted in expected.items():
            [block] = [r for r in blocks if r.lo <= v <= r.hi]
            assert block.value == pytest.approx(fitted, abs=1e-12)
    assert len([r for r in found if r.g == "flat"]) == 1 and len([r for r in found if r.g == "rising"]) == len(set(groups["rising"][0]))


def test_what_is_left_out(spark):
    nan = float("nan")
    data = [(None, 1.0, 1.0), (0.5, None, 1.0), (nan, 1.0, 1.0), (0.2, 1.0, 0.0), (0.3, 0.0, 2.0), (0.3, 1.0, 2.0)]
    rows = spark.createDataFrame(data, "s double, y double, w double")
    assert [tuple(r) for r in I.isotonic_blocks(rows, "s", "y", weight="w").collect()] == [(0.3, 0.3, 0.5, 4.0)]
    assert I.isotonic_blocks(rows.limit(0), "s", "y").count() == 0


def test_model_of_blocks_equals_the_fitted_one(spark, tmp_path):
    from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel

    rng = np.random.default_rng(3)
    x = rng.integers(0, 300, 2000) / 300
    rows = spark.createDataFrame([(float(a), float(rng.random() < a)) for a in x], "raw double, label double")
    mine = I.fit_isotonic(rows)
    theirs = IsotonicRegression(featuresCol="raw", labelCol="label").fit(rows)
    asked = spark.createDataFrame([(v,) for v in np.linspace(-0.1, 1.1, 500).tolist()], "raw double")
    a, b = (TR.calibrated(asked, m, "raw", "p").orderBy("raw").toPandas()["p"] for m in (mine, theirs))
    assert np.allclose(a, b)
    mine.write().save(f"{tmp_path}/m")
    c = TR.calibrated(asked, IsotonicRegressionModel.load(f"{tmp_path}/m"), "raw", "p").orderBy("raw").toPandas()["p"]
    assert (a == c).all()


def test_calibrators_of_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = spark.range(4000).select(
        (F.col("id") % 40).cast("string").alias("tenant_id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("probability"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) < F.pmod(F.xxhash64("id"), F.lit(100))).cast("int").alias("converted"))
    table = I.calibrators(I.isotonic_blocks(rows, "probability", "converted", ["tenant_id"]), ["tenant_id"])
    tuned = TR.recalibrated_scores(rows, table)
    means = tuned.groupBy("tenant_id").agg(F.avg("probability").alias("p"), F.avg("converted").alias("y")).collect()
    assert len(means) == 40 and all(abs(r.p - r.y) < 1e-9 for r in means)
    assert rng is not None
