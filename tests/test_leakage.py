"""Planted leaks are found, honest features are not."""

import numpy as np
import pandas as pd

from leadlake.operators import leakage as L


def found(spark, frame, features):
    return {r["feature"]: r for r in L.detect_leakage(spark.createDataFrame(frame), features).collect()}


def test_category_copy_of_the_target(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    hit = found(spark, pd.DataFrame({"honest": rng.normal(size=500), "leak": np.where(y == 1, "won", "lost"), "converted": y}), ["honest", "leak"])
    assert set(hit) == {"leak"} and hit["leak"]["severity"] == "critical" and hit["leak"]["quarantined"]
    assert "'lost'=0.0%" in hit["leak"]["detail"]


def test_numeric_leak_in_either_direction(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    noisy = y + rng.normal(scale=0.01, size=500)
    hit = found(spark, pd.DataFrame({"copy": noisy, "inverse": -noisy, "converted": y}), ["copy", "inverse"])
    assert {r["reason"] for r in hit.values()} == {"solo_auc"} and len(hit) == 2


def test_clean_features(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"n": rng.normal(size=600), "c": rng.choice(list("abc"), 600), "converted": rng.integers(0, 2, 600)})
    assert found(spark, frame, ["n", "c"]) == {}


def test_tiny_category_is_noise(spark):
    rng = np.random.default_rng(3)
    c = rng.choice(["a", "b"], 800).astype(object)
    y = rng.integers(0, 2, 800)
    c[:3], y[:3] = "rare", 1
    assert found(spark, pd.DataFrame({"mostly_fine": c, "converted": y}), ["mostly_fine"]) == {}


def test_numeric_with_many_nulls_is_read_as_categories(spark):
    y = np.arange(400) % 2
    v = np.where(np.arange(400) % 5 == 0, None, y.astype(float))
    hit = found(spark, pd.DataFrame({"v": pd.Series(v, dtype="float64"), "converted": y}), ["v"])
    assert hit["v"]["reason"] == "category_purity"


def test_override_keeps_the_finding(spark):
    y = np.arange(400) % 2
    frame = pd.DataFrame({"leak": np.where(y == 1, "x", "z"), "fine": "q", "converted": y})
    findings = L.detect_leakage(spark.createDataFrame(frame), ["leak", "fine"])
    features = spark.createDataFrame([("leak",), ("fine",)], "feature string")
    none, approved = (spark.createDataFrame(r, "feature string") for r in ([], [("leak",)]))
    assert [r[0] for r in L.drop_quarantined(features, findings, none).collect()] == ["fine"]
    assert L.drop_quarantined(features, findings, approved).count() == 2 and findings.count() == 1
