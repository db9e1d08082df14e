"""Queries on queues, lift, thresholds, outcomes and model resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake import settings as S
from leadlake.functions import scoring as X
from leadlake.functions.numbers import round_to
from leadlake.operators import clean as C
from leadlake.operators import decide as D
from leadlake.operators import score as SC
from leadlake.operators import train as TR
from leadlake.plans import fixtures as FX
from leadlake.plans.cleaning import ADJUSTED_CTE, DAYS_SQL, DECAY_SQL, PLAN_SQL, TIER_SQL
from leadlake.plans.fixtures import band_sql, round_sql, with_leads, with_scored
from leadlake.plans.registry import query
from leadlake.session import store

NTZ = "timestamp_ntz"


@query("queue_filter", with_scored("""SELECT lead_key, tenant_id, band FROM scored
WHERE probability IS NOT NULL AND coalesce(converted, 0) = 0 AND band = 'warm'"""))
def queue_filter(spark, sf):
    return D.queue_filter(FX.scored(spark, sf), band="warm").select("lead_key", "tenant_id", "band")


_RANKED_COLUMNS = ["tenant_id", "rank", "external_id", "probability", "adjusted_probability", "expected_value",
                   "priority", "adjusted_band", "days_stale"]


def _shown(df):
    return df.select("tenant_id", "rank", "external_id", round_to(F.col("probability"), 4).alias("probability"),
                     *_RANKED_COLUMNS[4:])


def _rank_sql(strategy: str, source: str = "scored", base: str = "0.38e0", default: str = "1000e0") -> str:
    prio = {"expected_value": "ev", "probability": "p",
            "value": f"CASE WHEN p >= 0.5e0 THEN coalesce(nullif(deal_value, 0e0), {default}) ELSE 0e0 END"}[strategy]
    return f"""aged AS (SELECT *, {DAYS_SQL.format('scored_at')} AS days FROM {source}),
factored AS (SELECT *, {DECAY_SQL.format('days')} AS factor FROM aged),
moved AS (SELECT *, CASE WHEN factor >= 1 THEN probability ELSE {base} + (probability - {base}) * factor END AS p FROM factored),
valued AS (SELECT *, p * CASE WHEN deal_value > 0 THEN deal_value ELSE {default} END AS ev FROM moved),
placed AS (SELECT *, {round_sql('p', 4)} AS adjusted_probability, {round_sql('ev', 2)} AS expected_value,
  {round_sql(prio, 4)} AS priority, {band_sql('p')} AS adjusted_band, {round_sql('days', 2)} AS days_stale FROM valued),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY priority DESC, probability DESC, lead_key) AS BIGINT) AS rank FROM placed)"""


_SHOW_SQL = f"SELECT tenant_id, rank, external_id, {round_sql('probability', 4)} AS probability, adjusted_probability, expected_value, priority, adjusted_band, days_stale FROM ranked"

for _strategy in ("expected_value", "probability", "value"):
    @query(f"rank_leads_{_strategy}", with_scored(f"{_SHOW_SQL} WHERE rank <= 50", _rank_sql(_strategy)))
    def _rank(spark, sf, strategy=_strategy):
        return _shown(D.rank_leads(FX.scored(spark, sf), FX.as_of(), strategy, 50))


@query("rank_leads_all", with_scored(_SHOW_SQL, _rank_sql("expected_value")))
def rank_leads_all(spark, sf):
    return _shown(D.rank_leads(store(FX.scored(spark, sf)), FX.as_of(), capacity=None))


_ACTIVE_SQL = """active AS (SELECT tenant_id, version, tier, conversion_rate FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, version DESC) AS i FROM models WHERE is_active) WHERE i = 1),
base_model AS (SELECT * FROM active WHERE tenant_id IS NULL),
routed AS (SELECT scored.*, coalesce(a.version, b.version, 'unversioned') AS model_version, coalesce(a.tier, b.tier, 'generic') AS model_tier,
  CASE WHEN a.version IS NOT NULL THEN a.conversion_rate ELSE b.conversion_rate END AS model_rate
  FROM scored LEFT JOIN active a USING (tenant_id) LEFT JOIN base_model b ON TRUE)"""
_QUEUE_SQL = f"""{FX.TENANTS_SQL}, {FX.MODELS_SQL}, {_ACTIVE_SQL},
pool AS (SELECT routed.*, daily_capacity, default_deal_value, coalesce(nullif(model_rate, 0e0), 0.38e0) AS base_rate
  FROM routed JOIN tenants USING (tenant_id) WHERE coalesce(converted, 0) = 0), """ + _rank_sql(
    "expected_value", "pool", "base_rate", "default_deal_value")


@query("priority_queue", with_scored(
    _SHOW_SQL.replace("days_stale FROM", "days_stale, model_tier FROM") + " WHERE rank <= daily_capacity", _QUEUE_SQL))
def priority_queue(spark, sf):
    queue = D.priority_queue(FX.scored(spark, sf), FX.tenants(spark, sf), FX.model_versions(spark, sf), FX.as_of())
    return queue.select("tenant_id", "rank", "external_id", round_to(F.col("probability"), 4).alias("probability"),
                        *_RANKED_COLUMNS[4:], "model_tier")


@query("queue_summary", with_scored(f"""
SELECT tenant_id, COUNT(*) AS count, CAST(SUM(CAST(expected_value AS DECIMAL(20,2))) AS DOUBLE) AS total_expected_value,
  CAST(SUM(CASE WHEN adjusted_band = 'hot' THEN 1 ELSE 0 END) AS BIGINT) AS hot,
  CAST(SUM(CASE WHEN adjusted_band = 'warm' THEN 1 ELSE 0 END) AS BIGINT) AS warm,
  CAST(SUM(CASE WHEN adjusted_band = 'cool' THEN 1 ELSE 0 END) AS BIGINT) AS cool,
  CAST(SUM(CASE WHEN adjusted_band = 'cold' THEN 1 ELSE 0 END) AS BIGINT) AS cold,
  {round_sql('AVG(adjusted_probability)', 4)} AS mean_probability, MIN(adjusted_probability) AS cutoff_probability
FROM ranked WHERE rank <= daily_capacity GROUP BY 1""", _QUEUE_SQL))
def queue_summary(spark, sf):
    queue = D.priority_queue(FX.scored(spark, sf), FX.tenants(spark, sf), FX.model_versions(spark, sf), FX.as_of())
    return D.queue_summary(queue)


@query("with_tenant_defaults", with_leads("""
SELECT lead_key, tenant_id, daily_capacity, default_deal_value FROM leads JOIN tenants USING (tenant_id)""", FX.TENANTS_SQL))
def with_tenant_defaults(spark, sf):
    return D.with_tenant_defaults(FX.leads(spark, sf), FX.tenants(spark, sf)).select(
        "lead_key", "tenant_id", "daily_capacity", "default_deal_value")


@query("active_model", with_scored(
    f"SELECT tenant_id, version AS model_version, tier AS model_tier, {round_sql('conversion_rate', 6)} AS model_conversion_rate FROM active",
    f"{FX.MODELS_SQL}, {_ACTIVE_SQL}"))
def active_model(spark, sf):
    return SC.active_models(FX.model_versions(spark, sf)).withColumn(
        "model_conversion_rate", round_to(F.col("model_conversion_rate"), 6))


@query("with_active_model", with_scored(
    f"SELECT lead_key, model_version, model_tier, {round_sql('model_rate', 6)} AS model_conversion_rate FROM routed",
    f"{FX.MODELS_SQL}, {_ACTIVE_SQL}"))
def with_active_model(spark, sf):
    return SC.with_active_model(FX.scored(spark, sf), FX.model_versions(spark, sf)).select(
        "lead_key", "model_version", "model_tier", round_to(F.col("model_conversion_rate"), 6).alias("model_conversion_rate"))


@query("model_history", with_leads(f"""
SELECT tenant_id, version, tier, is_active, training_rows, {round_sql('roc_auc', 6)} AS roc_auc, 'seed' AS promoted_reason, created_at FROM models""", FX.MODELS_SQL))
def model_history(spark, sf):
    m = FX.model_versions(spark, sf)
    metrics = F.create_map(F.lit("hybrid_ensemble"), F.create_map(F.lit("roc_auc"), F.col("roc_auc")))
    h = SC.model_history(m.withColumns({"metrics": metrics, "promoted_reason": F.lit("seed")}))
    return h.withColumns({"roc_auc": round_to(F.col("roc_auc"), 6), "created_at": F.col("created_at").cast(NTZ)})


@query("score_batch_ranked", with_scored(
    f"SELECT lead_key, {round_sql('probability', 4)} AS probability, band FROM scored"))
def score_batch_ranked(spark, sf):
    return D.score_batch_ranked(FX.scored(spark, sf))


@query("score_table_heuristic", with_scored(f"""
SELECT lead_key, {round_sql('probability', 6)} AS probability, band, prediction, model_version FROM routed""", f"{FX.MODELS_SQL}, {_ACTIVE_SQL}"))
def score_table_heuristic(spark, sf):
    out = SC.score_table(FX.leads(spark, sf), {}, FX.model_versions(spark, sf))
    return out.select("lead_key", round_to(F.col("probability"), 6).alias("probability"), "band", "prediction", "model_version")


@query("lead_stats", with_scored(f"""
SELECT tenant_id, total, scored, labelled, converted, CASE WHEN labelled > 0 THEN {round_sql('converted / labelled', 4)} END AS conversion_rate,
  {TIER_SQL.format('labelled')} AS tier, {PLAN_SQL.format('labelled')} FROM (
  SELECT tenant_id, COUNT(*) AS total, COUNT(probability) AS scored, COUNT(converted) AS labelled,
         COUNT(*) FILTER (converted = 1) AS converted FROM scored GROUP BY 1)"""))
def lead_stats(spark, sf):
    return D.lead_stats(FX.scored(spark, sf))


_LIFT_SQL = f"""known AS (SELECT tenant_id, probability, converted, COUNT(*) OVER (PARTITION BY tenant_id) AS n,
  ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY probability DESC, lead_key) AS rn,
  AVG(converted) OVER (PARTITION BY tenant_id) AS base FROM scored WHERE converted IS NOT NULL),
sized AS (SELECT *, CAST(floor((rn - 1) / greatest(n // 10, 1)) AS BIGINT) + 1 AS decile FROM known)"""


@query("lift_by_decile", with_scored(f"""
SELECT tenant_id, decile, COUNT(*) AS leads, {round_sql('AVG(converted)', 4)} AS conversion_rate,
  {round_sql('AVG(converted) / MAX(base)', 3)} AS lift, {round_sql('AVG(probability)', 4)} AS mean_score
FROM sized WHERE decile <= 10 AND base > 0 GROUP BY 1, 2""", _LIFT_SQL))
def lift_by_decile(spark, sf):
    return D.lift_by_decile(store(FX.scored(spark, sf).select("tenant_id", "lead_key", "probability", "converted")))


_CUTS = [i / 20 for i in range(2, 19)]
_CUT_COUNTS = ", ".join(
    f"COUNT(*) FILTER (probability >= {c!r}::DOUBLE AND converted = 1) AS tp{i}, COUNT(*) FILTER (probability >= {c!r}::DOUBLE AND converted = 0) AS fp{i}"
    for i, c in enumerate(_CUTS))
_CUT_ROWS = " UNION ALL ".join(
    f"SELECT tenant_id, channel, support, pos, {c!r}::DOUBLE AS cut, tp{i} AS tp, fp{i} AS fp FROM wide_counts" for i, c in enumerate(_CUTS))
_THRESHOLD_SQL = f"""wide_counts AS (SELECT tenant_id, channel, COUNT(*) AS support, COUNT(*) FILTER (converted = 1) AS pos, {_CUT_COUNTS}
  FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2),
counted AS ({_CUT_ROWS}),
judged AS (SELECT *, CASE WHEN tp > 0 THEN CAST(tp * 2 AS DOUBLE) / (tp + fp + pos) END AS f1 FROM counted WHERE support >= 50),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, channel ORDER BY f1 DESC NULLS LAST, cut) AS i FROM judged)"""


@query("segment_thresholds", with_scored(f"""
SELECT tenant_id, channel, support, CASE WHEN f1 IS NULL THEN 0.5e0 ELSE cut END AS threshold, {round_sql('f1', 6)} AS f1 FROM best WHERE i = 1""", _THRESHOLD_SQL))
def segment_thresholds(spark, sf):
    return D.segment_thresholds(FX.scored(spark, sf), "channel", by=["tenant_id"])


_OUTCOME_MATCH = f"""{FX.OUTCOMES_SQL},
by_ext AS (SELECT tenant_id, external_id, MIN(lead_id) AS lead_id FROM leads GROUP BY 1, 2),
matched AS (SELECT o.*, coalesce(a.lead_id, b.lead_id) AS lead_id, coalesce(a.external_id, b.external_id) AS external_id
  FROM outcomes o LEFT JOIN leads a ON a.tenant_id = o.tenant_id AND a.lead_id = o.lead_ref
  LEFT JOIN by_ext b ON b.tenant_id = o.tenant_id AND b.external_id = o.lead_ref)"""


@query("record_outcomes", with_leads("""
SELECT lead_key, CASE WHEN m.lead_id IS NOT NULL THEN CAST(m.converted AS INTEGER) ELSE l.converted END AS converted,
  CASE WHEN m.converted THEN m.recorded_at END AS converted_at, coalesce(m.deal_value, l.deal_value) AS deal_value,
  m.lead_id IS NOT NULL AS outcome_recorded
FROM leads l LEFT JOIN matched m ON m.tenant_id = l.tenant_id AND m.lead_id = l.lead_id""", _OUTCOME_MATCH))
def record_outcomes(spark, sf):
    out = D.record_outcomes(FX.leads(spark, sf), FX.outcomes(spark, sf))
    return out.select("lead_key", "converted", F.col("converted_at").cast(NTZ).alias("converted_at"), "deal_value", "outcome_recorded")


@query("unmatched_outcomes", with_leads(
    "SELECT tenant_id, lead_ref, converted FROM matched WHERE lead_id IS NULL", _OUTCOME_MATCH))
def unmatched_outcomes(spark, sf):
    return D.unmatched_outcomes(FX.leads(spark, sf), FX.outcomes(spark, sf)).select("tenant_id", "lead_ref", "converted")


@query("matched_predictions", with_scored(f"""
SELECT lead_key, model_version, {round_sql('log.probability', 6)} AS probability, l.converted FROM log JOIN leads l USING (tenant_id, lead_id, lead_key)
WHERE l.converted IS NOT NULL""", FX.LOG_SQL))
def matched_predictions(spark, sf):
    pairs = D.matched_predictions(FX.prediction_log(spark, sf).drop("converted"), FX.leads(spark, sf))
    return pairs.select("lead_key", "model_version", round_to(F.col("probability"), 6).alias("probability"), "converted")


@query("score_as_of", with_scored(f"""
SELECT lead_key, model_version, {round_sql('probability', 6)} AS probability FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY created_at DESC) AS i FROM log WHERE created_at <= TIMESTAMP '2024-01-16 12:00:00') WHERE i = 1""", FX.LOG_SQL))
def score_as_of(spark, sf):
    out = SC.score_as_of(FX.prediction_log(spark, sf), F.to_timestamp(F.lit("2024-01-16 12:00:00")))
    return out.select("lead_key", "model_version", round_to(F.col("probability"), 6).alias("probability"))


@query("scores_as_of", with_scored(f"""
SELECT a.lead_id, asked_at, l.model_version, {round_sql('l.probability', 6)} AS probability
FROM (SELECT tenant_id, lead_id, TIMESTAMP '2024-01-08' + to_days(CAST(lead_key % 28 AS INTEGER)) + INTERVAL 6 HOUR AS asked_at FROM leads) a
ASOF LEFT JOIN log l ON a.lead_id = l.lead_id AND a.asked_at >= l.created_at""", FX.LOG_SQL))
def scores_as_of(spark, sf):
    day = F.unix_micros(F.to_timestamp(F.lit("2024-01-08 06:00:00"))) + F.pmod(F.col("lead_key"), F.lit(28)) * 86_400_000_000
    asks = FX.leads(spark, sf).select("tenant_id", "lead_id", F.timestamp_micros(day).alias("asked_at"))
    out = SC.scores_as_of(asks, FX.prediction_log(spark, sf))
    return out.select("lead_id", F.col("asked_at").cast(NTZ).alias("asked_at"), "model_version",
                      round_to(F.col("probability"), 6).alias("probability"))


_RECENT = "SELECT {0} AS grp, lead_key, CAST(i AS BIGINT) AS row FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {0} ORDER BY {1} DESC, lead_key) AS i FROM scored) WHERE i <= {2}"


@query("recent_scored", with_scored(_RECENT.format("tenant_id", "scored_at", 1000)))
def recent_scored(spark, sf):
    return D.recent_per_group(FX.scored(spark, sf), "scored_at", 1000, ["tenant_id"]).select(
        F.col("tenant_id").alias("grp"), "lead_key", "row")


@query("recently_updated", with_scored(_RECENT.format("source_id", "created_at", 100)))
def recently_updated(spark, sf):
    return D.recent_per_group(FX.leads(spark, sf), "created_at", 100, ["source_id"]).select(
        F.col("source_id").alias("grp"), "lead_key", "row")


_PUSH_SQL = f"""{FX.SOURCES_SQL}, top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY probability DESC, external_id) AS i
  FROM scored JOIN sources USING (source_id) WHERE supports_writeback)"""


@query("writeback_export", with_scored(
    f"SELECT source_id, external_id, {round_sql('probability', 4)} AS probability, band FROM top WHERE i <= 100", _PUSH_SQL))
def writeback_export(spark, sf):
    return D.writeback_export(FX.scored(spark, sf), FX.sources(spark, sf), 100)


@query("writeback_counts", with_scored("""
SELECT source_id, COUNT(*) AS attempted, COUNT(*) FILTER (band <> 'cold') AS pushed FROM top WHERE i <= 100 GROUP BY 1""", _PUSH_SQL))
def writeback_counts(spark, sf):
    sent = D.writeback_export(FX.scored(spark, sf), FX.sources(spark, sf), 100)
    return D.writeback_counts(sent, sent.where(F.col("band") == "cold"))


@query("writeback_report", with_scored("""
SELECT a.source_id, CASE WHEN coalesce(supports_writeback, FALSE) THEN 'done' ELSE 'refused' END AS status,
  CASE WHEN supports_writeback THEN coalesce(attempted, 0) ELSE 0 END AS attempted, CASE WHEN supports_writeback THEN coalesce(pushed, 0) ELSE 0 END AS pushed,
  CASE WHEN s.source_id IS NULL THEN a.source_id || ' is not a known source.' WHEN NOT supports_writeback THEN a.source_id || ' is read-only.' END AS reason
FROM (SELECT DISTINCT source_id FROM leads UNION SELECT 'FAX') a LEFT JOIN sources s ON s.source_id = a.source_id
LEFT JOIN (SELECT source_id, COUNT(*) AS attempted, COUNT(*) FILTER (band <> 'cold') AS pushed FROM top WHERE i <= 100 GROUP BY 1) c ON c.source_id = a.source_id""", _PUSH_SQL))
def writeback_report(spark, sf):
    """Scores are asked back for every source of the leads and for one that nobody knows."""
    scored, sources = FX.scored(spark, sf), FX.sources(spark, sf)
    sent = D.writeback_export(scored, sources, 100)
    asked = scored.select("source_id").distinct().unionByName(spark.range(1).select(F.lit("FAX").alias("source_id")))
    return D.writeback_report(asked, sources, D.writeback_counts(sent, sent.where(F.col("band") == "cold")))


@query("simulate", with_scored(f"""
SELECT lead_key, {round_sql('before', 4)} AS before, {round_sql('after', 4)} AS after, {round_sql('after - before', 4)} AS delta,
  {round_sql('(after - before) * 100e0', 2)} AS delta_points,
  CASE WHEN after > before THEN 'improves' WHEN after < before THEN 'worsens' ELSE 'no change' END AS verdict FROM (
  SELECT lead_key, probability AS before, {FX.HEURISTIC_SQL.replace('coalesce(total_visits, 0e0)', '8e0').replace('coalesce(time_on_site_seconds, 0e0)', 'coalesce(time_on_site_seconds / 2e0, 0e0)')} AS after FROM scored)"""))
def simulate(spark, sf):
    out = SC.simulate(FX.leads(spark, sf), {"total_visits": F.lit(8.0), "time_on_site_seconds": F.col("time_on_site_seconds") / 2.0})
    return out.select("lead_key", "before", "after", "delta", "delta_points", "verdict")


@query("blend", with_scored(f"""
SELECT lead_key, {round_sql('(coalesce(a * 0.5e0, 0e0) + coalesce(b * 0.3e0, 0e0) + coalesce(c * 0.2e0, 0e0)) / (CASE WHEN a IS NULL THEN 0e0 ELSE 0.5e0 END + CASE WHEN b IS NULL THEN 0e0 ELSE 0.3e0 END + CASE WHEN c IS NULL THEN 0e0 ELSE 0.2e0 END)', 6)} AS blended
FROM (SELECT lead_key, probability AS a, CASE WHEN channel <> 'Select' THEN probability * 0.9e0 END AS b,
  CASE WHEN occupation = 'Student' THEN page_views_per_visit / 10e0 END AS c FROM scored)"""))
def blend(spark, sf):
    p = F.col("probability")
    parts = {"a": p, "b": F.when(F.col("channel") != "Select", p * 0.9),
             "c": F.when(F.col("occupation") == "Student", F.col("page_views_per_visit") / 10.0)}
    return FX.scored(spark, sf).select(
        "lead_key", round_to(SC.blend(parts, {"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("blended"))


_CHALLENGER_SQL = f"""{FX.MODELS_SQL},
champion AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, version DESC) AS i FROM models WHERE is_active) WHERE i = 1 AND tenant_id IS NOT NULL),
challenger AS (SELECT tenant_id, 'new' AS version, 'tenant' AS tier, 0.5e0 + AVG(converted) * 0.4e0 AS roc_auc, AVG(converted) AS conversion_rate,
  COUNT(converted) AS training_rows FROM leads GROUP BY 1),
pairs AS (SELECT c.*, h.version AS champion_version, h.roc_auc AS champion_auc, h.version IS NOT NULL AS has_champion FROM challenger c LEFT JOIN champion h USING (tenant_id)),
judged AS (SELECT *, CASE WHEN NOT has_champion THEN TRUE ELSE roc_auc >= champion_auc + 0.005e0 END AS promote,
  CASE WHEN NOT has_champion THEN 'first model for this tenant (AUC ' || printf('%.4f', {round_sql('roc_auc', 4)}) || ')'
       WHEN roc_auc >= champion_auc + 0.005e0 THEN 'challenger AUC ' || printf('%.4f', {round_sql('roc_auc', 4)}) || ' beats champion ' || printf('%.4f', {round_sql('champion_auc', 4)}) || ' by at least 0.005'
       ELSE 'challenger AUC ' || printf('%.4f', {round_sql('roc_auc', 4)}) || ' did not beat champion ' || printf('%.4f', {round_sql('champion_auc', 4)}) || ' by the required 0.005; keeping the incumbent' END AS reason FROM pairs)"""


def _challengers(spark, sf):
    l = FX.leads(spark, sf)
    return l.groupBy("tenant_id").agg(F.avg("converted").alias("conversion_rate"), F.count("converted").alias("training_rows")).select(
        "tenant_id", F.lit("new").alias("version"), F.lit("tenant").alias("tier"), "conversion_rate",
        (0.5 + F.col("conversion_rate") * 0.4).alias("roc_auc"), "training_rows", FX.as_of().alias("created_at"))


@query("should_promote", with_leads("SELECT tenant_id, promote, reason FROM judged", _CHALLENGER_SQL))
def should_promote(spark, sf):
    made = TR.promote(FX.model_versions(spark, sf).withColumn("promoted_reason", F.lit(None).cast("string")), _challengers(spark, sf))
    return made.where(F.col("version") == "new").select(
        "tenant_id", F.col("is_active").alias("promote"), F.col("promoted_reason").alias("reason"))


@query("promote", with_leads("""
SELECT tenant_id, version, is_active AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.promote AND j.tenant_id = models.tenant_id AND j.champion_version = models.version) AS is_active FROM models
UNION ALL SELECT tenant_id, version, promote FROM judged""", _CHALLENGER_SQL))
def promote(spark, sf):
    made = TR.promote(FX.model_versions(spark, sf).withColumn("promoted_reason", F.lit(None).cast("string")), _challengers(spark, sf))
    return made.select("tenant_id", "version", "is_active")


@query("label_sufficiency", with_leads("""
SELECT source_id, channel, rows, positives, negatives, CASE WHEN rows < 200 THEN 'Need at least 200 labelled leads to train; got ' || CAST(rows AS VARCHAR) || '. The base model keeps scoring until then.'
  WHEN least(positives, negatives) < 25 THEN 'Need at least 25 examples of each outcome; got ' || CAST(positives AS VARCHAR) || ' converted and ' || CAST(negatives AS VARCHAR) || ' not converted.' END AS reason,
  rows >= 200 AND least(positives, negatives) >= 25 AS sufficient FROM (
  SELECT source_id, channel, COUNT(*) AS rows, COUNT(*) FILTER (converted = 1) AS positives, COUNT(*) FILTER (converted = 0) AS negatives
  FROM leads WHERE converted IS NOT NULL GROUP BY 1, 2)"""))
def label_sufficiency(spark, sf):
    return TR.label_sufficiency(FX.leads(spark, sf), by=["source_id", "channel"])


@query("stratified_split", with_leads("""
SELECT tenant_id, converted, COUNT(*) AS rows, CAST(floor(COUNT(*) * 0.2e0 + 0.5e0) AS BIGINT) AS test_rows
FROM leads WHERE converted IS NOT NULL GROUP BY 1, 2"""))
def stratified_split(spark, sf):
    known = store(FX.leads(spark, sf).where(F.col("converted").isNotNull()).select("tenant_id", "lead_key", "converted"))
    split = TR.stratified_split(known, "converted", "lead_key", ["tenant_id"])
    return split.groupBy("tenant_id", "converted").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


_ABL_FIELDS = ["time_on_site_seconds", "total_visits", "page_views_per_visit"]
_ABLATION_SQL = f"""base AS (SELECT tenant_id, quantile_cont(time_on_site_seconds, 0.5) AS b_t, quantile_cont(total_visits, 0.5) AS b_v, quantile_cont(page_views_per_visit, 0.5) AS b_p FROM leads GROUP BY 1),
open_leads AS (SELECT lead_key, coalesce(time_on_site_seconds, b_t) AS t, coalesce(total_visits, b_v) AS v, coalesce(page_views_per_visit, b_p) AS p, b_t, b_v, b_p
  FROM scored JOIN base USING (tenant_id) WHERE converted IS NULL),
cells AS (SELECT lead_key, 'time_on_site_seconds' AS field, t AS value, b_t AS typical, t, v, p, b_t AS ct, v AS cv, p AS cp FROM open_leads WHERE abs(t - b_t) >= 1e-9
  UNION ALL SELECT lead_key, 'total_visits', v, b_v, t, v, p, t, b_v, p FROM open_leads WHERE abs(v - b_v) >= 1e-9
  UNION ALL SELECT lead_key, 'page_views_per_visit', p, b_p, t, v, p, t, v, b_p FROM open_leads WHERE abs(p - b_p) >= 1e-9),
deltas AS (SELECT *, (least(t / 300e0, 1e0) * 0.5e0 + least(p / 5e0, 1e0) * 0.25e0 + least(v / 10e0, 1e0) * 0.25e0)
  - (least(ct / 300e0, 1e0) * 0.5e0 + least(cp / 5e0, 1e0) * 0.25e0 + least(cv / 10e0, 1e0) * 0.25e0) AS delta FROM cells),
impacts AS (SELECT lead_key, field, {round_sql('delta', 4)} AS impact, CASE WHEN delta > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM deltas WHERE abs(delta) >= 0.001e0)"""


def _baseline(spark, sf):
    clean = C.clean_frame(FX.leads(spark, sf), keep=["tenant_id"])
    medians = C.baseline_medians(clean, _ABL_FIELDS, ["tenant_id"])
    return store(medians.groupBy("tenant_id").agg(*[
        F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in _ABL_FIELDS]))


def _impacts(spark, sf):
    pool = FX.leads(spark, sf).where(F.col("converted").isNull())
    return TR.explain_heuristic(pool, _baseline(spark, sf), ["lead_key"], ["tenant_id"])


@query("explain_ablation", with_scored("SELECT * FROM impacts", _ABLATION_SQL))
def explain_ablation(spark, sf):
    return _impacts(spark, sf).select("lead_key", "field", "impact", "direction")


@query("ablation_grid", with_scored("SELECT lead_key, field FROM cells", _ABLATION_SQL))
def ablation_grid(spark, sf):
    pool = FX.leads(spark, sf).where(F.col("converted").isNull()).select("lead_key", "tenant_id", *_ABL_FIELDS)
    return TR.ablation_grid(pool, _baseline(spark, sf), _ABL_FIELDS, ["tenant_id"]).select("lead_key", "field")


@query("top_contributions", with_scored("""
SELECT lead_key, field, impact, CAST(i AS BIGINT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_key ORDER BY abs(impact) DESC, field) AS i FROM impacts) WHERE i <= 2""", _ABLATION_SQL))
def top_contributions(spark, sf):
    return TR.top_contributions(_impacts(spark, sf), ["lead_key"], 2).select("lead_key", "field", "impact", "rank")


_POINTS_SQL = f"printf('%.1f', {round_sql('abs(impact) * 100e0', 1)})"
_LABEL_SQL = "upper(substr(replace(field, '_', ' '), 1, 1)) || substr(replace(field, '_', ' '), 2)"


@query("explain_summary", with_scored(f"""
SELECT lead_key, '{S.SUMMARY_OPENING}' || printf('%.1f', {round_sql('probability * 100e0', 1)})
  || CASE WHEN probability >= 0.5e0 THEN '{S.SUMMARY_ABOVE}' ELSE '{S.SUMMARY_BELOW}' END
  || coalesce('{S.SUMMARY_FACTORS}' || drivers || '.', '{S.SUMMARY_NO_FACTOR}') AS summary
FROM scored LEFT JOIN (
  SELECT lead_key, string_agg({_LABEL_SQL} || ' (' || CAST(value AS VARCHAR) || ') ' || CASE WHEN impact > 0 THEN 'raising' ELSE 'lowering' END
    || ' it by ' || {_POINTS_SQL} || ' points', '; ' ORDER BY i) AS drivers
  FROM (SELECT *, row_number() OVER (PARTITION BY lead_key ORDER BY abs(impact) DESC, field) AS i
        FROM (SELECT lead_key, field, value, {round_sql('delta', 4)} AS impact FROM deltas WHERE abs(delta) >= 0.001e0)) WHERE i <= 3 GROUP BY 1) USING (lead_key)
WHERE converted IS NULL""", _ABLATION_SQL))
def explain_summary(spark, sf):
    pool = FX.scored(spark, sf).where(F.col("converted").isNull())
    top = TR.top_contributions(_impacts(spark, sf), ["lead_key"], 6)
    return TR.explain_summary(pool.select("lead_key", "probability"), top, ["lead_key"])
