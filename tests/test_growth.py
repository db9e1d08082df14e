"""What kept work from growing with the tables: steps that ran again and again, and tasks with a fixed share of a table."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadlake.operators import metrics as M
from leadlake.operators import score as SC
from leadlake.operators import tenants as TN
from leadlake.operators import train as TR
from leadlake.plans import fixtures as FX
from leadlake.plans import ingesting as IN
from leadlake.plans import modelling as MO
from leadlake.session import new_folder, store


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_leads(spark, n=400):
    i = np.arange(n)
    made = spark.createDataFrame(pd.DataFrame({
        "tenant_id": np.where(i % 2 == 0, "ASIA", "AFRICA"), "lead_key": i, "external_id": i.astype(str), "converted": i % 3 % 2,
        "time_on_site_seconds": i % 300 * 1.0, "total_visits": i % 10 * 1.0, "page_views_per_visit": i % 5 * 1.0,
        **{c: np.where(i % 4 == 0, "a", "b") for c in MO.CAT}}))
    return made.join(made.select("lead_key"), "lead_key")


def test_filter_of_impacts_does_not_run_the_models(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1)], "id long, x double")
    after = rows.select("id", F.lit("channel").alias("field"), F.lit("a").alias("value"), F.lit("b").alias("baseline"), F.sqrt("x").alias("after"))
    impacts = TR._impacts(after.join(rows.select("id", F.exp("x").alias("before")), "id"), ["id"])
    assert not [line for line in plan_of(impacts).splitlines() if "Filter" in line and ("SQRT" in line or "EXP" in line)]
    assert sorted(r["id"] for r in impacts.collect()) == [1, 3]


def test_training_rows_are_stored(spark):
    rows = MO.training_rows(spark, None, some_leads(spark))
    assert "Join" not in plan_of(rows) and rows.count() == 400


def test_scored_table_derives_leads_once(spark, monkeypatch):
    calls = []

    class Fixed:
        def score(self, df):
            return df.withColumn("probability", F.lit(0.5))

    def leads(session, sf_dir, orders=None):
        calls.append(sf_dir)
        return some_leads(spark)

    def versions(session, sf_dir, leads_=None):
        labelled = leads(session, sf_dir) if leads_ is None else leads_
        return labelled.select("tenant_id").distinct().unionByName(spark.createDataFrame([(None,)], "tenant_id string")).select(
            "tenant_id", F.lit("20240101").alias("version"), F.lit("tenant").alias("tier"), F.lit(0.5).alias("conversion_rate"),
            F.lit(True).alias("is_active"), FX.as_of().alias("created_at"))

    monkeypatch.setattr(FX, "leads", leads)
    monkeypatch.setattr(FX, "model_versions", versions)
    monkeypatch.setattr(MO, "small_model", lambda *given: Fixed())
    monkeypatch.setattr(TR, "recalibrate", lambda base, rows, version: base)
    scored = MO._scored_table(spark, "nowhere")
    assert "lead_key = lead_key" not in plan_of(scored) and scored.count() == 400
    assert len(calls) == 1


class Seen(Exception):
    """What a step was given; nothing after it runs."""


def test_leads_are_stored_without_columns_no_step_reads(spark, monkeypatch):
    unread = ["lead_id", "source_id", "display_name", "do_not_contact", "deal_value", "scored_at"]

    def stop(what):
        raise Seen(what)

    monkeypatch.setattr(FX, "leads", lambda *given: some_leads(spark).withColumns({c: F.lit("x") for c in [*unread, "created_at"]}))
    monkeypatch.setattr(MO, "training_rows", lambda session, sf_dir, leads=None: stop(leads.columns))
    kept = {"tenant_id", "lead_key", "external_id", "converted", "created_at", *MO.NUM, *MO.CAT}
    for query in (MO.score_tenants, MO.score_table_rows):
        with pytest.raises(Seen) as seen:
            query(spark, "nowhere")
        assert set(seen.value.args[0]) == kept


def test_training_cleans_once(spark, monkeypatch):
    def stop(clean, *given):
        raise Seen(plan_of(clean))

    monkeypatch.setattr(TR, "detect_leakage", stop)
    with pytest.raises(Seen) as seen:
        TR.train_model(some_leads(spark), "v1", id_column="lead_key")
    assert seen.value.args[0].startswith("Relation")


def test_tenants_rows_hold_their_features_alone(spark, monkeypatch):
    def stop(train, *given):
        raise Seen(train.columns)

    monkeypatch.setattr(TN, "_statistics", stop)
    with pytest.raises(Seen) as seen:
        TN.train_tenants(some_leads(spark), some_leads(spark).select("tenant_id").distinct(), "v1", F.current_timestamp(), "lead_key",
                         numeric=["total_visits"], categorical=["channel"])
    assert set(seen.value.args[0]) == {"lead_key", "tenant_id", "label", "is_test", "total_visits", "channel", "_fold", "model_of"}


def test_model_metrics_read_the_rows_once(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"model": np.where(rng.random(500) < 0.5, "a", "b"), "odd_name": np.round(rng.random(500), 2), "y": rng.integers(0, 2, 500)})
    frame.loc[::50, "odd_name"] = None
    rows = store(spark.createDataFrame(frame).withColumn("odd_name", F.nullif("odd_name", F.lit(float("nan")))))
    made = M.model_metrics(rows, "odd_name", "y", ["model"])
    assert "odd_name" not in plan_of(made)
    want = {r["model"]: r for r in M.classification_metrics(rows, "odd_name", "y", ["model"]).collect()}
    auc = {r["model"]: r["roc_auc"] for r in M.exact_auc(rows, "odd_name", "y", ["model"]).collect()}
    for r in made.collect():
        assert r["roc_auc"] == auc[r["model"]]
        for name in ("accuracy", "precision", "recall", "f1", "brier"):
            assert r[name] == pytest.approx(want[r["model"]][name], abs=1e-12)


def test_landed_files_grow_with_the_shuffle(spark):
    path = new_folder(spark, "landed")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = spark.range(4000).select((F.col("id") % 500).alias("key"), "id")
        files = IN._landed(rows, path, "key", 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    written = len(glob.glob(f"{path}/*.parquet"))
    assert files == 8 and written == 24 and -(-written // files) == 3
    back = spark.read.parquet(path).select("key", F.input_file_name().alias("file"))
    assert back.count() == 4000 and back.groupBy("key").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0


def test_vectors_under_cross_validation_are_spread(spark):
    rows = spark.range(0, 1000, 1, 2)
    with TR._spread(rows, 100) as data:
        sizes = data.groupBy(F.spark_partition_id()).count().collect()
        assert data.count() == 1000 and max(r["count"] for r in sizes) <= 200
    with TR._spread(rows, 500) as data:
        assert data is rows


def test_calibration_searches_once(spark):
    rows = spark.createDataFrame([(0.1, [0.0, 0.5, 1.0], [0.0, 0.2, 0.9]), (0.75, [0.0, 0.5, 1.0], [0.0, 0.2, 0.9]), (0.3, None, None)],
                                 "p double, xs array<double>, ys array<double>")
    made = rows.select("p", SC.interpolate_arrays(F.col("p"), F.col("xs"), F.col("ys")).alias("v"))
    assert plan_of(made).count("aggregate(") == 1
    assert {r["p"]: r["v"] for r in made.collect()} == {0.1: pytest.approx(0.04), 0.75: pytest.approx(0.55), 0.3: None}


def test_large_methods_are_split(spark):
    assert entry._prepared(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
