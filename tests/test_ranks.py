"""Bucketed orders against brute force, with a third of all rows in one tie and one group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlake.operators import decide as D
from leadlake.operators import metrics as M
from leadlake.operators import ranks as R


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(0)
    n = 6000
    frame = pd.DataFrame({
        "tenant_id": np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c"], n)),
        "lead_key": rng.permutation(n), "probability": np.round(rng.random(n), 3),
        "converted": rng.integers(0, 2, n), "deal_value": np.round(rng.random(n) * 1e4, 2),
    })
    frame.loc[frame.index % 3 == 1, "probability"] = 0.25
    return frame


@pytest.mark.parametrize("buckets", [4, 16, 256])
def test_global_rank(spark, skewed, buckets):
    got = R.global_rank(spark.createDataFrame(skewed), ["-probability", "lead_key"], ["tenant_id"], buckets).toPandas()
    want = skewed.sort_values(["tenant_id", "probability", "lead_key"], ascending=[True, False, True])
    want["rank"] = want.groupby("tenant_id").cumcount() + 1
    both = got.merge(want, on="lead_key", suffixes=("", "_want"))
    assert len(both) == len(skewed) and (both["rank"] == both["rank_want"]).all()


def test_large_capacity_of_a_column_is_not_cut(spark):
    n = 3000
    rows = pd.DataFrame({
        "tenant_id": ["a"] * n + ["b"] * 40, "lead_key": np.arange(n + 40), "probability": np.linspace(0.01, 0.99, n + 40),
        "deal_value": 100.0, "scored_at": pd.Timestamp("2024-01-01"), "daily_capacity": [2500] * n + [7] * 40,
    })
    got = D.rank_leads(spark.createDataFrame(rows), F.lit("2024-01-01").cast("timestamp"), capacity="daily_capacity").toPandas()
    assert got.groupby("tenant_id")["rank"].agg(["size", "max"]).to_dict("index") == {
        "a": {"size": 2500, "max": 2500}, "b": {"size": 7, "max": 7}}


def test_rank_by_three_levels_of_ties(spark, skewed):
    tied = skewed.assign(priority=1.0, probability=0.5)
    got = R.global_rank(spark.createDataFrame(tied), ["-priority", "-probability", "lead_key"], buckets=16).toPandas()
    assert (got.sort_values("rank")["lead_key"].to_numpy() == np.sort(tied["lead_key"])).all()


def test_quantiles_match_numpy(spark, skewed):
    points = [0, 0.1, 0.25, 0.5, 0.77, 1]
    got = R.exact_quantiles(spark.createDataFrame(skewed), "probability", points, ["tenant_id"], 16).toPandas()
    for tenant, part in got.groupby("tenant_id"):
        values = skewed.loc[skewed.tenant_id == tenant, "probability"]
        assert np.allclose(part["quantile"], np.quantile(values, part["probability"]))


def test_empty_input(spark, skewed):
    none = spark.createDataFrame(skewed).where("false")
    assert R.global_rank(none, ["-probability", "lead_key"]).count() == 0
    assert M.exact_auc(none, "probability", "converted", ["tenant_id"]).count() == 0


def test_auc_matches_pairs(spark, skewed):
    got = M.exact_auc(spark.createDataFrame(skewed), "probability", "converted", ["tenant_id"], 16).toPandas()
    for _, row in got.iterrows():
        part = skewed[skewed.tenant_id == row.tenant_id]
        up = part.loc[part.converted == 1, "probability"].to_numpy()[:, None]
        down = part.loc[part.converted == 0, "probability"].to_numpy()
        assert row.roc_auc == pytest.approx(((up > down) + 0.5 * (up == down)).mean())


def test_auc_needs_both_classes(spark, skewed):
    only = spark.createDataFrame(skewed).where("converted = 1")
    assert M.exact_auc(only, "probability", "converted").first()["roc_auc"] is None


def test_lift_leaves_out_the_tail_rows(spark, skewed):
    part = skewed[skewed.tenant_id == "a"].head(107)
    got = D.lift_by_decile(spark.createDataFrame(part)).toPandas().sort_values("decile")
    want = part.sort_values(["probability", "lead_key"], ascending=[False, True]).head(100)
    rates = want["converted"].to_numpy().reshape(10, 10).mean(axis=1)
    assert list(got["leads"]) == [10] * 10
    assert np.allclose(got["conversion_rate"], rates)
    assert np.allclose(got["lift"], rates / part["converted"].mean(), atol=6e-4)


def test_lift_of_few_rows_and_no_positives(spark, skewed):
    few = spark.createDataFrame(skewed.head(4).assign(converted=1, tenant_id="x"))
    assert D.lift_by_decile(few).count() == 4
    assert D.lift_by_decile(few.withColumn("converted", F.lit(0))).count() == 0


def test_metrics_of_undefined_ratios_are_zero(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    m = M.classification_metrics(rows, "p", "y").first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_bin_edge_of_point_three(spark):
    rows = spark.createDataFrame([(0.3, 1), (1.0, 1), (0.0, 0)], "p double, y int")
    bins = M.calibration_bins(rows, "p", "y").select("bin").collect()
    assert sorted(r["bin"] for r in bins) == [0, 2, 9]


def test_thresholds_keep_the_lowest_tie_and_default(spark):
    good = [("good", 0.9, 1)] * 30 + [("good", 0.05, 0)] * 30
    never = [("never", 0.05, 1)] * 60
    small = [("small", 0.9, 1)] * 10
    rows = spark.createDataFrame(good + never + small, "segment string, probability double, converted int")
    got = {r["segment"]: r["threshold"] for r in D.segment_thresholds(rows, "segment").collect()}
    assert got == {"good": 0.1, "never": 0.5}


def test_weight_grid_has_66_points_and_finds_the_good_model(spark, skewed):
    frame = skewed.assign(good=skewed["converted"] * 0.8 + 0.1, bad=1 - skewed["converted"], flat=0.5)
    best = M.weight_grid_search(spark.createDataFrame(frame), ["good", "bad", "flat"], "converted").first()
    assert len(M.simplex_weights()) == 66
    assert best["accuracy"] == 1.0 and best["w_first"] > best["w_second"]
