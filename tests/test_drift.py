"""Population stability, calibration and health."""

import numpy as np
import pandas as pd
import pytest

from leadlake.operators import drift as DR
from leadlake.operators import metrics as M
from leadlake.session import store


def psi(spark, reference, live, kind="numeric"):
    numeric, categorical = (["total_visits"], []) if kind == "numeric" else ([], ["channel"])
    name = (numeric + categorical)[0]
    make = lambda v: spark.createDataFrame(pd.DataFrame({name: v}))
    stats = (DR.numeric_statistics(make(reference), numeric) if numeric
             else DR.categorical_statistics(make(reference), categorical))
    stats = store(stats)
    row = DR.psi(stats, DR.live_counts(make(live), stats)).first()
    return row["psi"] if row else None


def test_discrete_against_itself(spark):
    v = np.random.default_rng(0).integers(0, 15, 500).astype(float)
    assert psi(spark, v, v) == pytest.approx(0.0)
    assert psi(spark, v, v + 25) > 0.25


def test_heavily_tied_against_itself(spark):
    v = np.array([0.0] * 300 + [1.0] * 120 + list(range(2, 82)), dtype=float)
    assert psi(spark, v, v) == pytest.approx(0.0)


def test_continuous_resample(spark):
    rng = np.random.default_rng(2)
    assert psi(spark, rng.normal(500, 120, 800), rng.normal(500, 120, 800)) < 0.1


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    ref, live = rng.normal(0, 1, 700), rng.normal(0.5, 1.2, 300)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    e = np.histogram(ref, edges)[0] / len(ref)
    o = np.histogram(live, edges)[0].astype(float)
    o /= o.sum()
    e, o = np.clip(e, 1e-6, None), np.clip(o, 1e-6, None)
    assert psi(spark, ref, live) == pytest.approx(float(np.sum((o - e) * np.log(o / e))), rel=1e-6)


def test_empty_reference_bin_still_counts(spark):
    # Interpolated deciles over ties: no reference value lies between two of the edges.
    ref = np.array([0.0] * 64 + [10.0] * 66 + list(np.linspace(11, 40, 30)))
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    live = np.concatenate([(edges[:-1] + edges[1:]) / 2, [0.0] * 20, [10.0] * 5])
    e, o = (np.histogram(v, edges)[0] / len(v) for v in (ref, live))
    assert (e == 0).any()
    e, o = np.clip(e, 1e-6, None), np.clip(o, 1e-6, None)
    assert psi(spark, ref, live) == pytest.approx(float(np.sum((o - e) * np.log(o / e))), rel=1e-6)


def test_all_live_values_outside_the_histogram(spark):
    ref = np.linspace(0, 1, 500)
    e = np.full(10, 0.1)
    want = float(np.sum((1e-6 - e) * np.log(1e-6 / e)))
    assert psi(spark, ref, ref + 50) == pytest.approx(want, rel=0.02)


def test_categorical_shift_and_no_live_values(spark):
    ref = ["a"] * 80 + ["b"] * 20
    assert psi(spark, ref, ["b"] * 90 + ["a"] * 10, "text") > 0.25
    assert psi(spark, ref, ["c"] * 50, "text") > 0.25


def test_few_live_rows_are_insufficient(spark):
    frame = spark.createDataFrame(pd.DataFrame({"total_visits": np.arange(400) % 9 * 1.0}))
    stats = store(DR.numeric_statistics(frame, ["total_visits"]))
    assert DR.detect_drift(stats, frame).first()["status"] == "ok"
    assert DR.detect_drift(stats, frame.limit(3)).first()["status"] == "insufficient_data"


def report(spark, p, y):
    return M.calibration_report(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "p", "y").first()


def test_calibration_states(spark):
    rng = np.random.default_rng(4)
    p = rng.random(3000)
    good = report(spark, p, (rng.random(3000) < p).astype(int))
    assert good["status"] == "ok" and good["expected_calibration_error"] < 0.05
    over = report(spark, rng.uniform(0.8, 1, 1000), (rng.random(1000) < 0.2).astype(int))
    assert over["status"] == "alert"
    single = report(spark, np.full(100, 0.5), np.ones(100, dtype=int))
    assert single["status"] == "insufficient_data" and single["brier"] is None


@pytest.mark.parametrize("drift,calibration,worst", [
    ("ok", "ok", "ok"), ("ok", "insufficient_data", "insufficient_data"), ("warn", "insufficient_data", "warn"), ("ok", "alert", "alert")])
def test_health_is_the_worse_of_both(spark, drift, calibration, worst):
    d = spark.createDataFrame([("t", drift)], "tenant_id string, status string")
    c = spark.createDataFrame([("t", calibration)], "tenant_id string, status string")
    row = DR.health_rollup(d, c).first()
    assert row["status"] == worst and row["action_required"] == (worst == "alert")
