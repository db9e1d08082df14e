"""Score rules: heuristic, decay, queues, next action, plans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadlake.functions import scoring as X
from leadlake.functions import text as TX
from leadlake.operators import clean as C
from leadlake.operators import decide as D
from leadlake.operators import score as SC

NOW = datetime(2024, 2, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_heuristic_orders_engaged_before_cold(spark):
    rows = spark.createDataFrame([(1200.0, 5.0, 8.0), (5.0, 1.0, 1.0), (None, None, None)],
                                 "time_on_site_seconds double, page_views_per_visit double, total_visits double")
    engaged, cold, nothing = [r["p"] for r in rows.select(X.heuristic_score().alias("p")).collect()]
    assert engaged == pytest.approx(0.5 + 0.25 + 0.2) and engaged > cold > nothing == 0.0


@pytest.mark.parametrize("days,factor", [(21.0, 0.5), (42.0, 0.25), (0.0, 1.0), (None, 1.0)])
def test_decay(spark, days, factor):
    assert one(spark, X.decay_factor(F.lit(days).cast("double"))) == pytest.approx(factor)


def test_decay_can_be_switched_off(spark):
    assert one(spark, X.decay_factor(F.lit(50.0), enabled=False)) == 1.0
    assert one(spark, X.decay_factor(F.lit(50.0), half_life=0)) == 1.0


def queue(spark):
    rows = [
        ("t", 1, "a", 0.9, 100.0, NOW), ("t", 2, "b", 0.4, 10000.0, NOW), ("t", 3, "c", 0.6, None, NOW),
        ("t", 4, "d", 0.9, 100.0, NOW - timedelta(days=21)), ("u", 5, "e", 0.1, 0.0, NOW),
    ]
    return spark.createDataFrame(
        rows, "tenant_id string, lead_key long, external_id string, probability double, deal_value double, scored_at timestamp")


@pytest.mark.parametrize("strategy,order", [
    ("expected_value", ["b", "c", "a", "d"]), ("probability", ["a", "d", "c", "b"]), ("value", ["c", "a", "d", "b"])])
def test_strategies(spark, strategy, order):
    ranked = D.rank_leads(queue(spark), F.lit(NOW), strategy, capacity=10)
    got = [r["external_id"] for r in ranked.where("tenant_id = 't'").orderBy("rank").collect()]
    assert got == order


def test_capacity_and_full_rank_agree(spark):
    full = D.rank_leads(queue(spark), F.lit(NOW), capacity=None)
    cut = D.rank_leads(queue(spark), F.lit(NOW), capacity=2)
    assert cut.count() == 3
    assert set(cut.select("external_id", "rank").collect()) <= set(full.select("external_id", "rank").collect())


def test_candidate_limit_can_lose_a_large_deal(spark):
    leads = queue(spark).withColumns({"converted": F.lit(None).cast("int"), "band": X.band(F.col("probability")), "source_id": F.lit("s")})
    tenants = spark.createDataFrame([("t", 1, 1000.0)], "tenant_id string, daily_capacity int, default_deal_value double")
    top = lambda **kw: D.priority_queue(leads, tenants, None, F.lit(NOW), **kw).where("tenant_id = 't'").first()["external_id"]
    assert top() == "b" and top(candidate_limit=2) != "b"


def test_next_best_action(spark):
    rows = [(0.9, " YES ", "Working Professional", None, 0.0), (0.8, None, "working", None, 0.0),
            (0.65, "no", None, "SMS Sent", 0.0), (0.55, None, None, None, 0.0), (0.1, None, None, None, 301.0), (0.1, None, None, None, None)]
    df = spark.createDataFrame(rows, "p double, d string, o string, l string, t double")
    made = X.next_best_action(*[F.col(c) for c in "pdolt"])
    got = [r["action"] for r in df.select(made["action"].alias("action")).collect()]
    assert got == ["no_outreach", "call_now", "call_now", "personal_email", "nurture_sequence", "monitor"]


@pytest.mark.parametrize("n,tier,following", [(0, "generic", 1), (1, "recalibrated", 500), (500, "tenant", 5000), (5000, "continuous", None)])
def test_training_plan(spark, n, tier, following):
    plan = X.training_plan(F.lit(n))
    assert one(spark, plan["tier"]) == tier and one(spark, plan["next_tier_at"]) == following


@pytest.mark.parametrize("text,value", [("1f", None), ("nan", None), (" 12.5 ", 12.5), ("1e3", 1000.0), ("", None), ("12a", None)])
def test_to_number(spark, text, value):
    assert one(spark, TX.to_number(F.lit(text))) == value


def test_coerce_words(spark):
    got = [one(spark, TX.coerce_bool(F.lit(w))) for w in ("Won", " y", "LOST", "maybe", None)]
    assert got == [True, True, False, None, None]


def test_blend_renormalises_and_falls_to_null(spark):
    parts = {"a": F.lit(0.2), "b": F.lit(None).cast("double")}
    assert one(spark, SC.blend(parts, {"a": 0.3, "b": 0.7})) == pytest.approx(0.2)
    assert one(spark, SC.blend({"b": F.lit(None).cast("double")}, {"b": 1.0})) is None


def test_interpolate_clips_and_interpolates(spark):
    at = lambda p: one(spark, SC.interpolate(F.lit(p), [0.2, 0.4, 0.8], [0.1, 0.3, 0.9]))
    assert at(0.0) == 0.1 and at(1.0) == 0.9 and at(0.6) == pytest.approx(0.6) and at(0.4) == pytest.approx(0.3)


def test_clean_frame_nulls_placeholders_and_adds_columns(spark):
    df = spark.createDataFrame([("Select", "5"), ("Google", "x")], "channel string, total_visits string")
    rows = C.clean_frame(df).collect()
    assert [r["channel"] for r in rows] == [None, "Google"] and [r["total_visits"] for r in rows] == [5.0, None]
    assert len(rows[0]) == 25


def test_first_of_two_columns_of_a_field_wins(spark):
    df = spark.createDataFrame([("x", "y", "z")], "A string, B string, C string")
    out = C.apply_mapping(df, {"A": "channel", "B": "channel", "missing": "city"})
    assert out.columns == ["channel"] and out.first()["channel"] == "x"


def test_as_of_join(spark):
    log = spark.createDataFrame([("t", "l", datetime(2024, m, 10), f"v{m}", m / 10) for m in (1, 2, 4)],
                                "tenant_id string, lead_id string, created_at timestamp, model_version string, probability double")
    asks = spark.createDataFrame([("t", "l", datetime(2024, m, d)) for m, d in ((1, 1), (1, 10), (3, 5), (4, 9), (6, 1))],
                                 "tenant_id string, lead_id string, asked_at timestamp")
    got = [r["model_version"] for r in SC.scores_as_of(asks, log).orderBy("asked_at").collect()]
    assert got == [None, "v1", "v2", "v2", "v4"]


def test_model_falls_back_to_base_then_heuristic(spark):
    shape = "tenant_id string, created_at timestamp, version string, tier string, conversion_rate double, is_active boolean"
    models = spark.createDataFrame([("t", NOW, "own", "tenant", 0.2, True), ("u", NOW, "old", "tenant", 0.3, False), (None, NOW, "base", "generic", 0.4, True)], shape)
    leads = spark.createDataFrame([("t",), ("u",)], "tenant_id string")
    got = {r["tenant_id"]: r["model_version"] for r in SC.with_active_model(leads, models).collect()}
    assert got == {"t": "own", "u": "base"}
    none = SC.with_active_model(leads, models.where("false")).collect()
    assert {r["model_version"] for r in none} == {"unversioned"}
