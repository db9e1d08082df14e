"""Queries on metrics, curves, calibration and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions.numbers import round_to
from leadlake.operators import leakage as L
from leadlake.operators import metrics as M
from leadlake.operators import score as SC
from leadlake.plans import fixtures as FX
from leadlake.plans.fixtures import round_sql, with_scored
from leadlake.plans.registry import query
from leadlake.session import store


def _scored(spark, sf):
    return FX.scored(spark, sf).select("tenant_id", "lead_key", "probability", "converted", "prediction", "channel")


def _r6(df, *names):
    return df.withColumns({n: round_to(F.col(n), 6) for n in names})


GAIN_SQL = """dist AS (SELECT tenant_id, probability AS score, COUNT(*) FILTER (converted = 1) AS pos, COUNT(*) FILTER (converted = 0) AS neg
  FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2),
gain AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER g AS positives, SUM(neg) OVER g AS negatives FROM dist
  WINDOW w AS (PARTITION BY tenant_id ORDER BY score DESC), g AS (PARTITION BY tenant_id))"""
_G_COLS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives"
AUC_SQL = "SUM(CAST(pos AS DOUBLE) * (negatives - fp + neg / 2e0)) / (SUM(CAST(pos AS DOUBLE)) * SUM(CAST(neg AS DOUBLE)))"


@query("cumulative_gain", with_scored(f"SELECT tenant_id, {round_sql('score', 9)} AS score, pos, neg, {_G_COLS} FROM gain", GAIN_SQL))
def cumulative_gain(spark, sf):
    g = M.cumulative_gain(_scored(spark, sf), "probability", "converted", ["tenant_id"])
    return g.withColumn("score", round_to(F.col("score"), 9))


@query("exact_auc", with_scored(f"""SELECT tenant_id, CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives,
  {round_sql(AUC_SQL, 6)} AS roc_auc FROM gain GROUP BY 1""", GAIN_SQL))
def exact_auc(spark, sf):
    return _r6(M.exact_auc(_scored(spark, sf), "probability", "converted", ["tenant_id"]), "roc_auc")


@query("exact_auc_global", with_scored(f"""SELECT positives, negatives, {round_sql('won / (CAST(positives AS DOUBLE) * negatives)', 6)} AS roc_auc FROM (
  SELECT COUNT(*) FILTER (converted = 1) AS positives, COUNT(*) FILTER (converted = 0) AS negatives,
    SUM(CASE WHEN converted = 1 THEN r END) - COUNT(*) FILTER (converted = 1) * (COUNT(*) FILTER (converted = 1) + 1) / 2e0 AS won
  FROM (SELECT converted, RANK() OVER (ORDER BY probability) + (COUNT(*) OVER (PARTITION BY probability) - 1) / 2e0 AS r FROM scored WHERE converted IS NOT NULL))"""))
def exact_auc_global(spark, sf):
    return _r6(M.exact_auc(_scored(spark, sf), "probability", "converted"), "roc_auc")


@query("average_precision", with_scored(f"""
SELECT tenant_id, {round_sql('SUM(CAST(pos AS DOUBLE) / positives * tp / (tp + fp))', 6)} AS average_precision FROM gain GROUP BY 1""", GAIN_SQL))
def average_precision(spark, sf):
    return _r6(M.average_precision(_scored(spark, sf), "probability", "converted", ["tenant_id"]), "average_precision")


@query("roc_curve", with_scored(f"""SELECT tenant_id, {round_sql('score', 9)} AS threshold, {round_sql('CAST(fp AS DOUBLE) / negatives', 6)} AS fpr,
  {round_sql('CAST(tp AS DOUBLE) / positives', 6)} AS tpr FROM gain""", GAIN_SQL))
def roc_curve(spark, sf):
    c = M.roc_curve(_scored(spark, sf), "probability", "converted", ["tenant_id"])
    return _r6(c, "fpr", "tpr").withColumn("threshold", round_to(F.col("threshold"), 9))


@query("pr_curve", with_scored(f"""SELECT tenant_id, {round_sql('score', 9)} AS threshold, {round_sql('CAST(tp AS DOUBLE) / (tp + fp)', 6)} AS precision,
  {round_sql('CAST(tp AS DOUBLE) / positives', 6)} AS recall FROM gain""", GAIN_SQL))
def pr_curve(spark, sf):
    c = M.pr_curve(_scored(spark, sf), "probability", "converted", ["tenant_id"])
    return _r6(c, "precision", "recall").withColumn("threshold", round_to(F.col("threshold"), 9))


COUNTS_SQL = """counts AS (SELECT tenant_id, COUNT(*) AS n, COUNT(*) FILTER (converted = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (converted = 0 AND prediction = 1) AS fp,
  COUNT(*) FILTER (converted = 1 AND prediction = 0) AS fn, COUNT(*) FILTER (converted = 0 AND prediction = 0) AS tn, AVG((probability - converted) * (probability - converted)) AS brier
  FROM scored WHERE converted IS NOT NULL GROUP BY 1)"""


def _safe(top: str, bottom: str) -> str:
    return round_sql(f"CASE WHEN ({bottom}) = 0 THEN 0e0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END", 6)


@query("classification_metrics", with_scored(f"""SELECT tenant_id, n AS rows, {_safe('tp + tn', 'n')} AS accuracy, {_safe('tp', 'tp + fp')} AS precision,
  {_safe('tp', 'tp + fn')} AS recall, {_safe('tp * 2', 'tp * 2 + fp + fn')} AS f1, {round_sql('brier', 6)} AS brier FROM counts""", COUNTS_SQL))
def classification_metrics(spark, sf):
    m = M.classification_metrics(_scored(spark, sf), "probability", "converted", ["tenant_id"])
    return _r6(m, "accuracy", "precision", "recall", "f1", "brier")


@query("confusion_matrix", with_scored("""
SELECT tenant_id, converted AS actual, prediction AS predicted, COUNT(*) AS n FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2, 3"""))
def confusion_matrix(spark, sf):
    known = _scored(spark, sf).where(F.col("converted").isNotNull())
    return M.confusion_matrix(known, "converted", "prediction", ["tenant_id"])


def _macro(a: str, b: str, wa: str = "1e0", wb: str = "1e0") -> str:
    return f"({a} * {wa} + {b} * {wb}) / ({wa} + {wb})"


def _q(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN 0e0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END)"


_P = (_q("tn", "tn + fn"), _q("tp", "tp + fp"))
_R = (_q("tn", "tn + fp"), _q("tp", "tp + fn"))
_F = (_q("tn * 2", "tn * 2 + fn + fp"), _q("tp * 2", "tp * 2 + fp + fn"))


def _report_row(label: str, p: str, r: str, f: str, support: str) -> str:
    accuracy = _q("tp + tn", "n")
    return (f"SELECT tenant_id, {round_sql(accuracy, 6)} AS accuracy, {round_sql(f'1e0 - {accuracy}', 6)} AS error, '{label}' AS label, "
            f"{round_sql(p, 6)} AS precision, {round_sql(r, 6)} AS recall, {round_sql(f, 6)} AS f1, {support} AS support FROM counts")


_W = ("(tn + fp)::DOUBLE", "(tp + fn)::DOUBLE")
_REPORT_SQL = " UNION ALL ".join([
    _report_row("0", _P[0], _R[0], _F[0], "tn + fp"), _report_row("1", _P[1], _R[1], _F[1], "tp + fn"),
    _report_row("macro avg", _macro(*_P), _macro(*_R), _macro(*_F), "n"),
    _report_row("weighted avg", _macro(*_P, *_W), _macro(*_R, *_W), _macro(*_F, *_W), "n"),
])


@query("classification_report", with_scored(_REPORT_SQL, COUNTS_SQL))
def classification_report(spark, sf):
    known = _scored(spark, sf).where(F.col("converted").isNotNull())
    r = M.classification_report(known, "converted", "prediction", ["tenant_id"])
    return _r6(r, "accuracy", "error", "precision", "recall", "f1")


@query("class_balance", with_scored(f"""
SELECT tenant_id, 0 AS class, tn + fp AS actual, tn + fn AS predicted, {_safe('greatest(tn + fp, tp + fn)', 'n')} AS majority_accuracy FROM counts
UNION ALL SELECT tenant_id, 1, tp + fn, tp + fp, {_safe('greatest(tn + fp, tp + fn)', 'n')} FROM counts""", COUNTS_SQL))
def class_balance(spark, sf):
    known = _scored(spark, sf).where(F.col("converted").isNotNull())
    return _r6(M.class_balance(known, "converted", "prediction", ["tenant_id"]), "majority_accuracy")


def _bin_sql(bins: int) -> str:
    step = 1.0 / bins
    edges = [i * step for i in range(bins)]
    cases = " ".join(f"WHEN probability >= {e!r}::DOUBLE THEN {i}" for i, e in reversed(list(enumerate(edges))))
    return f"CASE {cases} END"


@query("reliability_curve", with_scored(f"""SELECT tenant_id, {_bin_sql(5)} AS bin, COUNT(*) AS n, {round_sql('AVG(probability)', 6)} AS mean_predicted,
  {round_sql('AVG(converted)', 6)} AS observed_rate FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2"""))
def reliability_curve(spark, sf):
    return _r6(M.reliability_curve(_scored(spark, sf), "probability", "converted", ["tenant_id"]), "mean_predicted", "observed_rate")


CAL_SQL = f"""cal_bins AS (SELECT tenant_id, {_bin_sql(10)} AS bin, COUNT(*) AS n, AVG(probability) AS mean_predicted, AVG(converted) AS observed_rate
  FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2)"""


@query("calibration_bins", with_scored(f"""SELECT tenant_id, bin, {round_sql('bin / 10e0', 2)} AS bin_low, {round_sql('(bin + 1) / 10e0', 2)} AS bin_high, n,
  {round_sql('mean_predicted', 6)} AS mean_predicted, {round_sql('observed_rate', 6)} AS observed_rate, {round_sql('observed_rate - mean_predicted', 6)} AS gap FROM cal_bins""", CAL_SQL))
def calibration_bins(spark, sf):
    return _r6(M.calibration_bins(_scored(spark, sf), "probability", "converted", ["tenant_id"]), "mean_predicted", "observed_rate", "gap")


CAL_REPORT_SQL = f"""{CAL_SQL}, {GAIN_SQL},
ece AS (SELECT tenant_id, SUM(abs(observed_rate - mean_predicted) * n) / SUM(n) AS ece FROM cal_bins GROUP BY 1),
auc AS (SELECT tenant_id, {AUC_SQL} AS auc FROM gain GROUP BY 1),
basics AS (SELECT tenant_id, COUNT(*) AS sample_size, AVG((probability - converted) * (probability - converted)) AS brier, AVG(converted) AS rate, AVG(probability) AS mean_p
  FROM scored WHERE converted IS NOT NULL GROUP BY 1),
calibration AS (SELECT tenant_id, CASE WHEN ece <= 0.05e0 THEN 'ok' WHEN ece <= 0.12e0 THEN 'warn' ELSE 'alert' END AS status, sample_size,
  {round_sql('ece', 4)} AS expected_calibration_error, {round_sql('brier', 4)} AS brier, {round_sql('auc', 4)} AS roc_auc, {round_sql('rate', 4)} AS observed_rate, {round_sql('mean_p', 4)} AS mean_predicted
  FROM basics JOIN ece USING (tenant_id) JOIN auc USING (tenant_id))"""


@query("calibration_report", with_scored("SELECT * FROM calibration", CAL_REPORT_SQL))
def calibration_report(spark, sf):
    return M.calibration_report(store(_scored(spark, sf)), "probability", "converted", ["tenant_id"])


# Three "models" for the comparison: the score itself and two distortions of it.
_MODEL_SQL = """model_scores AS (SELECT 'RandomForest' AS model, converted AS y, probability AS p FROM scored WHERE converted IS NOT NULL
  UNION ALL SELECT 'XGBoost', converted, page_views_per_visit / 10e0 FROM scored WHERE converted IS NOT NULL AND page_views_per_visit IS NOT NULL
  UNION ALL SELECT 'LightGBM', converted, CASE WHEN total_visits > 10 THEN 1e0 ELSE total_visits / 10e0 END FROM scored WHERE converted IS NOT NULL AND total_visits IS NOT NULL),
mdist AS (SELECT model, p, COUNT(*) FILTER (y = 1) AS pos, COUNT(*) FILTER (y = 0) AS neg FROM model_scores GROUP BY 1, 2),
mgain AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER g AS positives, SUM(neg) OVER g AS negatives FROM mdist
  WINDOW w AS (PARTITION BY model ORDER BY p DESC), g AS (PARTITION BY model)),
mauc AS (SELECT model, SUM(CAST(pos AS DOUBLE) * (negatives - fp + neg / 2e0)) / (SUM(CAST(pos AS DOUBLE)) * SUM(CAST(neg AS DOUBLE))) AS roc_auc,
  SUM(CAST(pos AS DOUBLE) / positives * tp / (tp + fp)) AS pr_auc FROM mgain GROUP BY 1),
mcounts AS (SELECT model, COUNT(*) AS n, COUNT(*) FILTER (y = 1 AND p >= 0.5e0) AS tp, COUNT(*) FILTER (y = 0 AND p >= 0.5e0) AS fp, COUNT(*) FILTER (y = 1 AND p < 0.5e0) AS fn,
  COUNT(*) FILTER (y = 0 AND p < 0.5e0) AS tn, AVG((p - y) * (p - y)) AS brier FROM model_scores GROUP BY 1),
mm AS (SELECT model, CAST(tp + tn AS DOUBLE) / n AS accuracy, roc_auc, pr_auc, CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp * 2 + fp + fn = 0 THEN 0e0 ELSE CAST(tp * 2 AS DOUBLE) / (tp * 2 + fp + fn) END AS f1, brier FROM mcounts JOIN mauc USING (model))"""


def _model_scores(spark, sf):
    known = FX.scored(spark, sf).where(F.col("converted").isNotNull())
    visits = F.col("total_visits")
    pairs = F.array(
        F.struct(F.lit("RandomForest").alias("model"), F.col("probability").alias("p")),
        F.struct(F.lit("XGBoost").alias("model"), (F.col("page_views_per_visit") / 10.0).alias("p")),
        F.struct(F.lit("LightGBM").alias("model"), F.when(visits > 10, 1.0).otherwise(visits / 10.0).alias("p")))
    return known.select(F.col("converted").alias("y"), F.inline(pairs)).where(F.col("p").isNotNull())


_M7 = ["accuracy", "roc_auc", "pr_auc", "precision", "recall", "f1", "brier"]


@query("model_metrics", with_scored(f"SELECT model, {', '.join(round_sql(c, 6) + ' AS ' + c for c in _M7)} FROM mm", _MODEL_SQL))
def model_metrics(spark, sf):
    return _r6(M.model_metrics(store(_model_scores(spark, sf)), "p", "y", ["model"]), *_M7)


@query("model_comparison", with_scored(f"""SELECT model, {', '.join(round_sql(c, 4) + ' AS ' + c for c in ['accuracy', 'precision', 'recall', 'f1', 'roc_auc'])},
  {round_sql('(accuracy + f1 + roc_auc) / 3e0', 4)} AS predictive_efficiency FROM mm""", _MODEL_SQL))
def model_comparison(spark, sf):
    return M.model_comparison(store(_model_scores(spark, sf)), "p", "y")


@query("auc_weights", with_scored(f"SELECT model, {round_sql('CASE WHEN SUM(greatest(roc_auc - 0.5e0, 0e0)) OVER () > 0 THEN greatest(roc_auc - 0.5e0, 0e0) / SUM(greatest(roc_auc - 0.5e0, 0e0)) OVER () ELSE 1e0 / COUNT(*) OVER () END', 6)} AS weight FROM mm", _MODEL_SQL))
def auc_weights(spark, sf):
    # The tiny metrics table has one row per model.
    m = store(M.model_metrics(store(_model_scores(spark, sf)), "p", "y", ["model"]))
    return _r6(SC.auc_weights(m), "weight")


_GRID_SQL = f"""grid AS (SELECT ROW_NUMBER() OVER (ORDER BY a, b) - 1 AS weight_id, a / 10e0 AS wa, b / 10e0 AS wb, (10 - a - b) / 10e0 AS wc
  FROM range(0, 11) s(a), range(0, 11) t(b) WHERE a + b <= 10),
blended AS (SELECT weight_id, converted AS y, probability * wa + coalesce(page_views_per_visit, 0e0) / 10e0 * wb + coalesce(total_visits, 0e0) / 13e0 * wc AS p
  FROM scored, grid WHERE converted IS NOT NULL),
bd AS (SELECT weight_id, p, COUNT(*) FILTER (y = 1) AS pos, COUNT(*) FILTER (y = 0) AS neg FROM blended GROUP BY 1, 2),
bg AS (SELECT *, SUM(neg) OVER (PARTITION BY weight_id ORDER BY p DESC) AS fp, SUM(neg) OVER (PARTITION BY weight_id) AS negatives FROM bd),
ba AS (SELECT weight_id, SUM(CAST(pos AS DOUBLE) * (negatives - fp + neg / 2e0)) / (SUM(CAST(pos AS DOUBLE)) * SUM(CAST(neg AS DOUBLE))) AS roc_auc FROM bg GROUP BY 1),
bc AS (SELECT weight_id, AVG(CASE WHEN (p >= 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END) AS accuracy, COUNT(*) FILTER (p >= 0.5e0 AND y = 1) AS tp, COUNT(*) FILTER (p >= 0.5e0 AND y = 0) AS fp,
  COUNT(*) FILTER (p < 0.5e0 AND y = 1) AS fn FROM blended GROUP BY 1)"""


def _three_scores(spark, sf):
    s = FX.scored(spark, sf).where(F.col("converted").isNotNull())
    zero = F.lit(0.0)
    return store(s.select("converted", F.col("probability").alias("a"),
                          (F.coalesce("page_views_per_visit", zero) / 10.0).alias("b"),
                          (F.coalesce("total_visits", zero) / 13.0).alias("c")))


@query("weight_grid", with_scored(f"""SELECT CAST(weight_id AS INTEGER) AS weight_id, {round_sql('accuracy', 6)} AS accuracy, {round_sql('CASE WHEN tp * 2 + fp + fn = 0 THEN 0e0 ELSE CAST(tp * 2 AS DOUBLE) / (tp * 2 + fp + fn) END', 6)} AS f1,
  {round_sql('roc_auc', 4)} AS roc_auc FROM bc JOIN ba USING (weight_id)""", _GRID_SQL))
def weight_grid(spark, sf):
    g = M.weight_grid(_three_scores(spark, sf), ["a", "b", "c"], "converted")
    return _r6(g, "accuracy", "f1").select("weight_id", "accuracy", "f1", round_to(F.col("roc_auc"), 4).alias("roc_auc"))


@query("weight_grid_search", with_scored(f"""SELECT wa AS w_first, wb AS w_second, wc AS w_third, {round_sql('accuracy', 6)} AS accuracy FROM bc JOIN ba USING (weight_id) JOIN grid USING (weight_id)
ORDER BY bc.accuracy DESC, CASE WHEN tp * 2 + fp + fn = 0 THEN 0e0 ELSE CAST(tp * 2 AS DOUBLE) / (tp * 2 + fp + fn) END DESC, ba.roc_auc DESC, weight_id LIMIT 1""", _GRID_SQL))
def weight_grid_search(spark, sf):
    best = M.weight_grid_search(_three_scores(spark, sf), ["a", "b", "c"], "converted")
    return _r6(best, "accuracy").select("w_first", "w_second", "w_third", "accuracy")


@query("union_predictions", with_scored("""
SELECT lead_key, converted, prediction, 'train' AS part FROM scored WHERE converted IS NOT NULL AND created_at < TIMESTAMP '1999-01-01'
UNION ALL SELECT lead_key, converted, prediction, 'test' FROM scored WHERE converted IS NOT NULL AND created_at >= TIMESTAMP '1999-01-01'"""))
def union_predictions(spark, sf):
    s = FX.scored(spark, sf).where(F.col("converted").isNotNull())
    early = F.col("created_at") < F.to_timestamp(F.lit(FX.PERIOD_SPLIT))
    keep = ["lead_key", "converted", "prediction"]
    train = s.where(early).select(*keep, F.lit("train").alias("part"))
    return train.unionByName(s.where(~early).select(*keep, F.lit("test").alias("part")))


# ------------------------------------------------------------------ leakage

_VALUES_SQL = " UNION ALL ".join(
    f"SELECT tenant_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS value, converted AS y FROM leaky" for c in FX.LEAKY_FEATURES)
_NUM_SQL = r"TRY_CAST(CASE WHEN regexp_matches(trim(value), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN trim(value) END AS DOUBLE)"
LEAK_SQL = f"""{FX.LEAKY_SQL}, vals AS ({_VALUES_SQL}),
counts AS (SELECT tenant_id, feature, value, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(y) AS DOUBLE) / COUNT(*) AS rate, {_NUM_SQL} AS num FROM vals GROUP BY tenant_id, feature, value),
kinds AS (SELECT tenant_id, feature, COUNT(value) AS distinct_values, SUM(CASE WHEN num IS NOT NULL THEN n ELSE 0 END) / SUM(n)::DOUBLE > 0.9e0 AS is_numeric FROM counts GROUP BY 1, 2),
extreme AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, feature ORDER BY value) AS i FROM counts WHERE value IS NOT NULL AND n >= 25 AND (rate >= 0.95e0 OR rate <= 0.05e0)),
totals AS (SELECT tenant_id, feature, SUM(n) AS rows FROM counts WHERE value IS NOT NULL GROUP BY 1, 2),
purity AS (SELECT e.tenant_id, e.feature, COUNT(*) AS extreme_values, CAST(SUM(n) AS DOUBLE) / MAX(rows) AS coverage, MAX(greatest(rate, 1e0 - rate)) AS worst,
  string_agg(CASE WHEN i <= 3 THEN '''' || value || '''=' || printf('%.1f%%', {round_sql('rate * 100e0', 1)}) END, ', ' ORDER BY i) AS examples
  FROM extreme e JOIN totals t USING (tenant_id, feature) GROUP BY 1, 2),
ndist AS (SELECT tenant_id, feature, num, CAST(SUM(pos) AS BIGINT) AS pos, CAST(SUM(n) - SUM(pos) AS BIGINT) AS neg FROM counts WHERE num IS NOT NULL GROUP BY 1, 2, 3),
ngain AS (SELECT *, SUM(neg) OVER (PARTITION BY tenant_id, feature ORDER BY num DESC) AS fp, SUM(neg) OVER (PARTITION BY tenant_id, feature) AS negatives FROM ndist),
nauc AS (SELECT tenant_id, feature, SUM(CAST(pos AS DOUBLE) * (negatives - fp + neg / 2e0)) / (SUM(CAST(pos AS DOUBLE)) * SUM(CAST(neg AS DOUBLE))) AS auc FROM ngain GROUP BY 1, 2
  HAVING SUM(pos) > 0 AND SUM(neg) > 0 AND SUM(pos) + SUM(neg) >= 25),
found AS (
  SELECT tenant_id, feature, CASE WHEN coverage >= 0.25e0 THEN 'critical' WHEN coverage >= 0.08e0 THEN 'high' ELSE 'moderate' END AS severity, 'category_purity' AS reason, {round_sql('worst', 4)} AS statistic,
    CAST(extreme_values AS VARCHAR) || ' category value(s) covering ' || printf('%.0f%%', {round_sql('coverage * 100e0', 0)}) || ' of rows are near-perfectly separated (' || examples || ')' AS detail
  FROM purity JOIN kinds USING (tenant_id, feature) WHERE coverage >= 0.02e0 AND NOT is_numeric AND distinct_values >= 2
  UNION ALL
  SELECT tenant_id, feature, CASE WHEN greatest(auc, 1e0 - auc) >= 0.98e0 THEN 'critical' ELSE 'high' END, 'solo_auc', {round_sql('greatest(auc, 1e0 - auc)', 4)},
    'alone predicts the outcome at AUC ' || printf('%.3f', {round_sql(round_sql('greatest(auc, 1e0 - auc)', 4), 3)}) || '; a legitimate single feature rarely exceeds 0.90'
  FROM nauc JOIN kinds USING (tenant_id, feature) WHERE greatest(auc, 1e0 - auc) >= 0.93e0 AND is_numeric AND distinct_values >= 2),
findings AS (SELECT tenant_id, feature, severity2 AS severity, reason, statistic, detail, severity2 IN ('critical', 'high') AS quarantined FROM (
  SELECT *, CASE WHEN regexp_matches(lower(feature), 'tag|status|stage|quality|grade|disposition|outcome|result|closed|won|lost|rating|score|profile')
    THEN CASE severity WHEN 'moderate' THEN 'high' ELSE 'critical' END ELSE severity END AS severity2 FROM found))"""


def _leaky(spark, sf):
    return FX.leaky(spark, sf).select("tenant_id", "converted", *FX.LEAKY_FEATURES)


@query("category_conversion", with_scored(f"SELECT tenant_id, feature, value, n, {round_sql('rate', 6)} AS rate FROM counts WHERE value IS NOT NULL AND feature NOT IN ('score_copy', 'time_on_site_seconds', 'total_visits', 'page_views_per_visit')", LEAK_SQL))
def category_conversion(spark, sf):
    texts = [c for c in FX.LEAKY_FEATURES if c not in ("score_copy", "time_on_site_seconds", "total_visits", "page_views_per_visit")]
    return _r6(L.category_conversion(_leaky(spark, sf), texts, "converted", ["tenant_id"]), "rate")


@query("category_purity", with_scored(f"""SELECT tenant_id, feature, CASE WHEN coverage >= 0.25e0 THEN 'critical' WHEN coverage >= 0.08e0 THEN 'high' ELSE 'moderate' END AS severity,
  {round_sql('worst', 4)} AS statistic, extreme_values, {round_sql('coverage', 6)} AS coverage, examples FROM purity WHERE coverage >= 0.02e0""", LEAK_SQL))
def category_purity(spark, sf):
    counts = L.value_counts(_leaky(spark, sf), FX.LEAKY_FEATURES, "converted", ["tenant_id"])
    return _r6(L.category_purity(counts, ["tenant_id"]), "coverage")


@query("numeric_solo_auc", with_scored(f"""SELECT tenant_id, feature, {round_sql('auc', 6)} AS roc_auc, {round_sql('greatest(auc, 1e0 - auc)', 4)} AS statistic,
  CASE WHEN greatest(auc, 1e0 - auc) >= 0.98e0 THEN 'critical' WHEN greatest(auc, 1e0 - auc) >= 0.93e0 THEN 'high' END AS severity FROM nauc""", LEAK_SQL))
def numeric_solo_auc(spark, sf):
    counts = L.value_counts(_leaky(spark, sf), FX.LEAKY_FEATURES, "converted", ["tenant_id"])
    return _r6(L.numeric_solo_auc(counts, ["tenant_id"]), "roc_auc")


@query("detect_leakage", with_scored("SELECT * FROM findings", LEAK_SQL))
def detect_leakage(spark, sf):
    return L.detect_leakage(_leaky(spark, sf), FX.LEAKY_FEATURES, by=["tenant_id"])


@query("leakage_summary", with_scored("""
SELECT tenant_id, COUNT(*) AS findings, COUNT(*) FILTER (quarantined) AS quarantined,
  CAST(COUNT(*) AS VARCHAR) || ' potential leak(s) found; ' || CAST(COUNT(*) FILTER (quarantined) AS VARCHAR) || ' feature(s) quarantined.' || chr(10) ||
  string_agg('  [' || severity || '] ' || feature || ': ' || detail, chr(10) ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, statistic DESC, feature) AS summary
FROM findings GROUP BY 1""", LEAK_SQL))
def leakage_summary(spark, sf):
    return L.leakage_summary(L.detect_leakage(_leaky(spark, sf), FX.LEAKY_FEATURES, by=["tenant_id"]), ["tenant_id"])


@query("drop_quarantined", with_scored(f"""
SELECT feature FROM (SELECT unnest({FX.LEAKY_FEATURES!r}) AS feature) f WHERE feature NOT IN (SELECT feature FROM findings WHERE quarantined AND feature <> 'last_touch')""", LEAK_SQL))
def drop_quarantined(spark, sf):
    found = store(L.detect_leakage(_leaky(spark, sf), FX.LEAKY_FEATURES, by=["tenant_id"]))
    features = spark.createDataFrame([(c,) for c in FX.LEAKY_FEATURES], "feature string")
    approved = spark.createDataFrame([("last_touch",)], "feature string")
    return L.drop_quarantined(features, found, approved)


@query("document_label_leakage", f"""
WITH d AS (SELECT lang, source, CAST(n_chars AS VARCHAR) AS n_chars, CAST(toxic AS VARCHAR) AS toxic, quality AS y FROM documents JOIN labels USING (doc_id)),
v AS (SELECT 'lang' AS feature, lang AS value, y FROM d UNION ALL SELECT 'source', source, y FROM d UNION ALL SELECT 'toxic', toxic, y FROM d UNION ALL SELECT 'n_chars', n_chars, y FROM d)
SELECT feature, value, COUNT(*) AS n, {round_sql('CAST(SUM(y) AS DOUBLE) / COUNT(*)', 6)} AS rate FROM v GROUP BY 1, 2""")
def document_label_leakage(spark, sf):
    return _r6(L.category_conversion(FX.doc_labels(spark, sf), ["lang", "source", "toxic", "n_chars"], "quality"), "rate")


@query("escalate", with_scored("""
SELECT tenant_id, stage, last_touch, COUNT(*) AS n, CASE WHEN stage = 'won' THEN 'critical' ELSE 'moderate' END AS plain, CASE WHEN stage = 'won' THEN 'critical' ELSE 'high' END AS raised
FROM leaky GROUP BY 1, 2, 3""", FX.LEAKY_SQL))
def escalate(spark, sf):
    g = FX.leaky(spark, sf).groupBy("tenant_id", "stage", "last_touch").agg(F.count(F.lit(1)).alias("n"))
    severity = F.when(F.col("stage") == "won", "critical").otherwise("moderate")
    return g.withColumns({"plain": L.escalate(severity, F.lit("plain_column")), "raised": L.escalate(severity, F.lit("deal_stage"))})


