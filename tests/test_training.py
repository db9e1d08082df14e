"""Training on a small table with few rounds: leaks stay out, scores are calibrated."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlake.operators import clean as C
from leadlake.operators import train as TR
from leadlake.session import store


def frame(n=900, seed=11):
    rng = np.random.default_rng(seed)
    engaged = rng.random(n) < 0.4
    y = (rng.random(n) < np.where(engaged, 0.8, 0.1)).astype(int)
    return pd.DataFrame({
        "external_id": [f"L{i:05d}" for i in range(n)], "tenant_id": np.where(np.arange(n) % 3 == 0, "a", "b"),
        "time_on_site_seconds": np.where(engaged, rng.integers(600, 2500, n), rng.integers(0, 300, n)).astype(float),
        "total_visits": rng.integers(0, 12, n).astype(float),
        "channel": rng.choice(["Google", "Direct", "Reference"], n),
        "occupation": np.where(np.arange(n) < 6, "Astronaut", rng.choice(["Student", "Manager"], n)),
        "city": np.where(y == 1, "won-city", "lost-city"), "converted": np.where(y == 1, "Yes", "no"),
    })


@pytest.fixture(scope="module")
def rows(spark):
    return store(spark.createDataFrame(frame()))


@pytest.fixture(scope="module")
def model(rows):
    return TR.train_model(rows, "v1", learners={"random_forest": TR.train_forest(8, 5), "boosted_a": TR.train_boosted_a(3)}, folds=2)


def test_metrics_and_weights(model):
    assert set(model.metrics) == {"random_forest", "boosted_a", "hybrid_ensemble"}
    assert model.metrics["hybrid_ensemble"]["roc_auc"] > 0.75
    assert sum(model.weights.values()) == pytest.approx(1.0) and model.training_rows == 900


def test_leak_is_left_out_of_the_model(rows, model):
    assert "city" not in model.features_used and "channel" in model.features_used
    moved = rows.withColumn("city", F.lit("won-city"))
    a = {r["external_id"]: r["probability"] for r in model.score(rows).collect()}
    b = {r["external_id"]: r["probability"] for r in model.score(moved).collect()}
    assert a == b and all(0 <= p <= 1 for p in a.values())


def test_batch_equals_single_and_order_is_kept_apart(rows, model):
    one = rows.where("external_id = 'L00007'")
    whole = model.score(rows).where("external_id = 'L00007'").first()["probability"]
    assert model.score(one).first()["probability"] == pytest.approx(whole)


def test_unseen_and_rare_levels_score_alike(rows, model):
    odd = rows.withColumn("occupation", F.lit("Never seen"))
    rare = rows.withColumn("occupation", F.lit("Astronaut"))
    assert model.score(odd).agg(F.sum("probability")).first()[0] == pytest.approx(model.score(rare).agg(F.sum("probability")).first()[0])


def test_recalibration_fits_the_tenant(rows, model):
    part = rows.where("tenant_id = 'a'")
    tuned = TR.recalibrate(model, part, "v2")
    mean = tuned.score(part).agg(F.avg("probability")).first()[0]
    assert mean == pytest.approx(part.select(F.avg((F.col("converted") == "Yes").cast("int"))).first()[0], abs=0.02)
    with pytest.raises(TR.NotTrainable, match="both"):
        TR.recalibrate(model, part.where("converted = 'no'"), "v3")


def test_saved_models_score_alike(spark, rows, model, tmp_path):
    tuned = TR.recalibrate(model, rows.where("tenant_id = 'a'"), "v2")
    for i, one in enumerate((model, tuned)):
        one.save(f"{tmp_path}/{i}")
        back = TR.Ensemble.load(spark, f"{tmp_path}/{i}")
        a, b = ({r["external_id"]: r["probability"] for r in m.score(rows).collect()} for m in (one, back))
        assert a == b
        assert (back.version, back.tier, back.weights, back.features_used) == (one.version, one.tier, one.weights, one.features_used)
        assert {"metrics", "weights", "baseline", "category_options", "statistics"} <= set(back.tables)
        assert back.tables["statistics"].count() == one.tables["statistics"].count() > 0


def test_folds_share_a_rare_class(spark):
    rows = spark.createDataFrame([(i, float(i < 12)) for i in range(600)], "id long, label double")
    counts = TR._folded(rows, "id", 4, 7).groupBy("_fold").agg(F.sum("label").alias("n")).collect()
    assert sorted(r["n"] for r in counts) == [3.0] * 4


def test_too_few_rows(rows):
    with pytest.raises(TR.NotTrainable, match="at least 200"):
        TR.train_model(rows.limit(50), "v")


def test_split_is_exact_and_repeatable(rows):
    clean = rows.select("external_id", (F.col("converted") == "Yes").cast("int").alias("y"))
    first = TR.stratified_split(clean, "y", "external_id")
    shares = {r["y"]: (r["n"], r["t"]) for r in first.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == int(n * 0.2 + 0.5) for n, t in shares.values())
    assert set(first.where("is_test").collect()) == set(TR.stratified_split(clean.repartition(5), "y", "external_id").where("is_test").collect())


def test_explanations_are_ranked_and_signed(rows, model):
    base = store(C.baseline_row(C.clean_frame(rows)))
    few = rows.where("external_id < 'L00020'")
    top = TR.top_contributions(TR.explain_ablation(few, model, base, ["external_id"]), ["external_id"], 3)
    got = top.orderBy("external_id", "rank").toPandas()
    assert not got.empty and (got["impact"].abs() >= 0.0009).all() and got.groupby("external_id").size().max() <= 3
    assert ((got["impact"] > 0) == (got["direction"] == "increases")).all()
    text = TR.explain_summary(model.score(few), top, ["external_id"]).collect()
    assert len(text) == 20 and all("This lead scores" in r["summary"] for r in text)


def test_platt_scores_are_probabilities(rows):
    clean = C.clean_frame(rows, keep=["external_id", "converted"])
    prep = TR.Preprocessor(["time_on_site_seconds"], ["channel"]).fit(clean)
    made = prep.apply(clean).select("external_id", (F.col("converted") == "Yes").cast("double").alias("label"), "features")
    ready = store(TR.with_balance(made))
    fitted = TR.platt_cv("rf", TR.train_forest(5, 4), ready, "external_id", 2)
    low, high = fitted.score(ready, "p").agg(F.min("p"), F.max("p")).first()
    assert 0 < low < high < 1


def test_promotion_cases(spark):
    shape = "challenger_auc double, has_champion boolean, champion_auc double"
    cases = [(None, True, 0.8), (0.7, False, None), (0.7, True, None), (0.806, True, 0.8), (0.804, True, 0.8)]
    got = [r["promote"] for r in TR.should_promote(spark.createDataFrame(cases, shape)).collect()]
    assert got == [False, True, True, True, False]


def test_calibrators_per_tenant(spark):
    scored = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "tenant_id string, probability double")
    arrays = spark.createDataFrame([("a", [0.0, 1.0], [0.2, 0.4])], "tenant_id string, boundaries array<double>, predictions array<double>")
    got = {r["tenant_id"]: r["probability"] for r in TR.recalibrated_scores(scored, arrays).collect()}
    assert got["a"] == pytest.approx(0.3) and got["b"] == 0.5


def test_passthrough_columns_are_not_scaled(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 9.0)], "total_visits double, encoded double")
    made = TR.Preprocessor(["total_visits"], [], ["encoded"]).fit(df).apply(df).orderBy("encoded").collect()
    assert [list(r["features"]) for r in made] == [[-1.0, 7.0], [1.0, 9.0]]
