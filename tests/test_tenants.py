"""Grouped training of tenants: steps against plain numpy, tiers, routing, odd tenants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlake.operators import tenants as TN
from leadlake.session import store

NUM, CAT = ["total_visits", "time_on_site_seconds"], ["channel"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for tenant, n, slope in (("big", 1500, 0.6), ("other", 700, -0.6), ("few", 60, 0.6), ("one-sided", 30, 0.0), (None, 40, 0.6)):
        for i in range(n):
            visits, channel = float(rng.integers(0, 10)), str(rng.choice(["Google", "Direct", "Reference"]))
            logit = slope * (visits - 4.5) + (0.8 if channel == "Google" else -0.3)
            y = 1 if tenant == "one-sided" else int(rng.random() < 1 / (1 + np.exp(-logit)))
            data.append((f"{tenant}-{i}", tenant, visits if i % 9 else None, float(rng.integers(0, 900)), channel, y if i % 7 else None))
    return store(spark.createDataFrame(data, "external_id string, tenant_id string, total_visits double, time_on_site_seconds double, channel string, converted int"))


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([("big",), ("other",), ("few",), ("one-sided",), ("empty",)], "tenant_id string")


@pytest.fixture(scope="module")
def trained(rows, tenants):
    return TN.train_tenants(rows, tenants, "v1", F.lit("2024-02-01").cast("timestamp"), numeric=NUM, categorical=CAT)


def test_tiers(trained):
    tiers = {r.tenant_id: (r.tier, r.action, r.own) for r in trained[0].tiers.collect()}
    assert tiers == {
        "big": ("tenant", "train_tenant_model", True), "other": ("tenant", "train_tenant_model", True), "few": ("recalibrated", "recalibrate", False),
        "one-sided": ("recalibrated", "keep_base_model", False), "empty": ("generic", "keep_base_model", False)}


def test_metrics_and_challengers(trained):
    _, metrics, challengers = trained
    auc = {(r.tenant_id, r.model): r.roc_auc for r in metrics.collect()}
    assert {(None, "base_model"), ("big", "hybrid_ensemble"), ("other", "hybrid_ensemble"), ("few", "hybrid_ensemble")} <= set(auc)
    assert ("one-sided", "hybrid_ensemble") not in auc
    assert auc["other", "hybrid_ensemble"] > 0.75 > auc["other", "base_model"]  # its slope is the opposite of the base's
    assert auc["big", "hybrid_ensemble"] > 0.75
    made = {r.tenant_id: r for r in challengers.collect()}
    assert set(made) == {"big", "other", "few"} and made["few"].training_rows == 51 and made["few"].roc_auc == auc["few", "hybrid_ensemble"]


def test_scores_by_route(spark, rows, trained):
    models = trained[0]
    extra = spark.createDataFrame([("new", "never seen", 3.0, None, "Fax", None)], rows.schema)
    leads = rows.unionByName(extra).withColumn("model", F.lit("old"))
    scored = models.score(leads)
    assert scored.count() == leads.count() and set(scored.columns) == {*leads.columns, "probability"}
    routes = {(r.tenant_id, r.model) for r in scored.collect()}
    assert routes == {("big", "own"), ("other", "own"), ("few", "recalibrated"), ("one-sided", "base"), (None, "base"), ("never seen", "base")}
    means = {r.tenant_id: (r.p, r.y) for r in scored.where("converted is not null").groupBy("tenant_id").agg(
        F.avg("probability").alias("p"), F.avg("converted").alias("y")).collect()}
    assert means["few"][0] == pytest.approx(means["few"][1], abs=1e-6)
    assert means["big"][0] == pytest.approx(means["big"][1], abs=0.05)


def test_sums_and_steps_against_numpy(spark):
    rng = np.random.default_rng(0)
    data, expected = [], {}
    for model, n in (("a", 200), ("b", 37)):
        x = np.concatenate([np.ones((n, 1)), rng.normal(size=(n, 3))], 1)
        y = (rng.random(n) < 0.4).astype(int)
        data += [(model, int(t), v.tolist()) for v, t in zip(x, y, strict=True)]
        beta = np.zeros(4)
        for _ in range(6):  # the penalised fit by itself
            p = 1 / (1 + np.exp(-x @ beta))
            penalty = np.diag([1e-9, 1, 1, 1])
            beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        expected[model] = beta
        assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.diag(penalty) * beta).max() < 1e-8
    rows = spark.createDataFrame(data, "model_of string, label int, x array<double>").repartition(5)
    rates = rows.groupBy("model_of").agg(F.avg("label").alias("rate"))
    got = {r.model_of: np.array(r.beta) for r in TN._fit(rows, rates, 4, 7).collect()}
    assert all(np.abs(got[m] - expected[m]).max() < 1e-6 for m in expected)


def test_effects_leave_out_their_fold(spark):
    train = spark.createDataFrame([("base", i % 4, int(i < 6), "x" if i < 8 else None) for i in range(12)], "model_of string, _fold int, label int, channel string")
    table = {r.value: r for r in TN._effects(train, ["channel"]).collect()}
    assert (table["x"].n, table["x"].positives, table["x"].n_fold, table["x"].positives_fold) == (8, 6, [2, 2, 2, 2], [2, 2, 1, 1])
    assert (table["Unknown"].n, table["Unknown"].positives) == (4, 0)


def test_one_class_cannot_be_trained(rows, tenants):
    with pytest.raises(ValueError, match="both classes"):
        TN.train_tenants(rows.where("tenant_id = 'one-sided'"), tenants, "v", F.current_timestamp(), numeric=NUM, categorical=CAT)
    with pytest.raises(ValueError, match="both classes"):
        TN.train_tenants(rows.limit(0), tenants, "v", F.current_timestamp(), numeric=NUM, categorical=CAT)
