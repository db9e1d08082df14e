"""Queries on reference statistics, drift, health and their windowed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions.numbers import round_to
from leadlake.operators import clean as C
from leadlake.operators import drift as DR
from leadlake.operators import metrics as M
from leadlake.plans import fixtures as FX
from leadlake.plans.cleaning import placeholder_sql
from leadlake.plans.evaluation import CAL_REPORT_SQL, _bin_sql
from leadlake.plans.fixtures import round_sql, with_leads, with_scored
from leadlake.plans.registry import query
from leadlake.session import new_folder, store
from leadlake.streaming import jobs as J

NUM = ["time_on_site_seconds", "total_visits", "page_views_per_visit"]
CAT = ["channel", "industry", "country", "occupation"]
BY = ["tenant_id"]


def clean_period(df):
    return C.clean_frame(df, keep=["tenant_id", "lead_key", "created_at"]).select(
        "tenant_id", "lead_key", "created_at", *NUM, *CAT)


def reference_table(spark, sf):
    reference, _ = FX.periods(spark, sf)
    return DR.feature_statistics(clean_period(reference), BY, NUM, CAT)


def _long(source: str, columns: list[str], null: bool = False) -> str:
    keep = "" if null else " WHERE {0} IS NOT NULL"
    return " UNION ALL ".join(f"SELECT tenant_id, created_at, '{c}' AS feature, {c} AS value FROM {source}{keep.format(c)}" for c in columns)


def _period_sql(shifted: bool, live_where: str = f"WHERE created_at >= TIMESTAMP '{FX.PERIOD_SPLIT}'") -> str:
    cats = ", ".join(f"{placeholder_sql(c)} AS {c}" for c in CAT)
    visits = "total_visits + 5e0 AS total_visits" if shifted else "total_visits"
    moved = cats
    if shifted:
        moved = cats.replace(f"{placeholder_sql('channel')} AS channel",
                             f"CASE WHEN tenant_id = 'ASIA' THEN '7-REFERRAL' ELSE {placeholder_sql('channel')} END AS channel")
    other = "time_on_site_seconds, page_views_per_visit"
    return f"""ref AS (SELECT tenant_id, created_at, total_visits, {other}, {cats} FROM leads WHERE created_at < TIMESTAMP '{FX.PERIOD_SPLIT}'),
live AS (SELECT tenant_id, created_at, {visits}, {other}, {moved} FROM leads {live_where})"""


STAT_SQL = f"""ref_num AS ({_long('ref', NUM)}), ref_cat AS ({_long('ref', CAT)}),
stat_basics AS (SELECT tenant_id, feature, COUNT(DISTINCT value) AS d, COUNT(*) AS total, AVG(value) AS mean,
  list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM ref_num GROUP BY 1, 2),
listed AS (SELECT tenant_id, feature, value, COUNT(*) AS n FROM ref_num GROUP BY 1, 2, 3),
bins AS (SELECT tenant_id, feature, edges, total, mean, unnest(range(1, len(edges))) AS bin FROM stat_basics WHERE d > 20 AND len(edges) >= 3),
num_stats AS (
  SELECT tenant_id, feature, 'numeric_discrete' AS kind, CAST(value AS VARCHAR) AS bin_key, value AS low, value AS high, n::DOUBLE / total AS share, mean
  FROM listed JOIN stat_basics USING (tenant_id, feature) WHERE d <= 20
  UNION ALL
  SELECT b.tenant_id, b.feature, 'numeric', CAST(b.bin AS VARCHAR), any_value(b.edges[b.bin]), any_value(b.edges[b.bin + 1]), coalesce(SUM(l.n), 0)::DOUBLE / any_value(b.total), any_value(b.mean)
  FROM bins b LEFT JOIN listed l ON l.tenant_id = b.tenant_id AND l.feature = b.feature AND l.value >= b.edges[b.bin]
    AND (l.value < b.edges[b.bin + 1] OR (b.bin = len(b.edges) - 1 AND l.value <= b.edges[b.bin + 1])) GROUP BY b.tenant_id, b.feature, b.bin),
cat_counts AS (SELECT tenant_id, feature, value, COUNT(*) AS n FROM ref_cat GROUP BY 1, 2, 3),
cat_stats AS (SELECT tenant_id, feature, 'categorical' AS kind, value AS bin_key, NULL::DOUBLE AS low, NULL::DOUBLE AS high, share, NULL::DOUBLE AS mean FROM (
  SELECT *, n::DOUBLE / SUM(n) OVER (PARTITION BY tenant_id, feature) AS share, ROW_NUMBER() OVER (PARTITION BY tenant_id, feature ORDER BY n DESC, value) AS i FROM cat_counts) WHERE i <= 25),
stats AS (SELECT * FROM num_stats UNION ALL SELECT * FROM cat_stats)"""

LIVE_SQL = f"""live_vals AS (SELECT tenant_id, created_at, feature, CAST(value AS VARCHAR) AS text FROM ({_long('live', NUM)}) UNION ALL {_long('live', CAT).replace(' AS value', ' AS text')}),
packed AS (SELECT tenant_id, feature, MIN(kind) AS kind, list_sort(list_distinct(list_concat(list(low), list(high)))) AS edges, list(bin_key) AS keys FROM stats GROUP BY 1, 2),
live_binned AS (SELECT tenant_id, created_at, feature, kind, CASE
    WHEN kind = 'numeric' THEN CASE WHEN TRY_CAST(text AS DOUBLE) >= edges[1] AND TRY_CAST(text AS DOUBLE) <= edges[len(edges)]
       THEN CAST(least(len(list_filter(edges, lambda e: e <= TRY_CAST(text AS DOUBLE))), len(edges) - 1) AS VARCHAR) END
    WHEN list_contains(keys, text) THEN text END AS bin_key FROM live_vals JOIN packed USING (tenant_id, feature))"""


def psi_sql(window: str = "") -> str:
    """CTEs from live_binned to psi, optionally with a leading window column."""
    w = f"{window}, " if window else ""
    keys = f"{w}tenant_id, feature"
    return f"""live_counts AS (SELECT {keys}, bin_key, COUNT(*) AS n FROM live_binned GROUP BY ALL),
seen AS (SELECT DISTINCT {keys} FROM live_counts),
expected0 AS (SELECT seen.*, kind, bin_key, share FROM seen JOIN stats USING (tenant_id, feature)),
expected AS (SELECT * FROM expected0 UNION ALL SELECT {keys}, kind, '(other)', greatest(1e0 - SUM(share), 0e0) FROM expected0 WHERE kind <> 'numeric' GROUP BY ALL),
totals AS (SELECT {keys}, CAST(SUM(n) AS DOUBLE) AS all_n, CAST(SUM(CASE WHEN bin_key IS NOT NULL THEN n END) AS DOUBLE) AS inside_n FROM live_counts GROUP BY ALL),
paired AS (SELECT e.*, coalesce(n / nullif(CASE WHEN kind = 'numeric' THEN inside_n ELSE all_n END, 0e0), 0e0) AS observed FROM expected e JOIN totals USING ({keys})
  LEFT JOIN (SELECT {keys}, coalesce(bin_key, '(other)') AS bin_key, n FROM live_counts) c USING ({keys}, bin_key)),
psi AS (SELECT {keys}, SUM((greatest(observed, 1e-6) - greatest(share, 1e-6)) * ln(greatest(observed, 1e-6) / greatest(share, 1e-6))) AS psi FROM paired GROUP BY ALL)"""


DRIFT_SQL = f"{STAT_SQL}, {LIVE_SQL}, {psi_sql()}"


@query("feature_statistics", with_leads(f"SELECT tenant_id, feature, kind, bin_key, {round_sql('low', 6)} AS low, {round_sql('high', 6)} AS high, {round_sql('share', 6)} AS share, {round_sql('mean', 6)} AS mean FROM stats", f"{_period_sql(False)}, {STAT_SQL}"))
def feature_statistics(spark, sf):
    return reference_table(spark, sf).withColumns({c: round_to(F.col(c), 6) for c in ("low", "high", "share", "mean")})


def _shifted(spark, sf):
    stats = store(reference_table(spark, sf))
    return stats, clean_period(FX.periods(spark, sf, shifted=True)[1])


@query("reference_vs_live", with_leads(f"SELECT tenant_id, feature, kind, bin_key, {round_sql('share', 6)} AS expected, {round_sql('observed', 6)} AS observed FROM paired", f"{_period_sql(True)}, {DRIFT_SQL}"))
def reference_vs_live(spark, sf):
    stats, live = _shifted(spark, sf)
    bins = DR.reference_vs_live(stats, DR.live_counts(live, stats, BY), BY)
    return bins.withColumns({c: round_to(F.col(c), 6) for c in ("expected", "observed")})


@query("psi", with_leads(f"SELECT tenant_id, feature, {round_sql('psi', 6)} AS psi FROM psi", f"{_period_sql(True)}, {DRIFT_SQL}"))
def psi(spark, sf):
    stats, live = _shifted(spark, sf)
    return DR.psi(stats, DR.live_counts(live, stats, BY), BY).withColumn("psi", round_to(F.col("psi"), 6))


@query("psi_same_period", with_leads(f"SELECT tenant_id, feature, {round_sql('psi', 6)} AS psi FROM psi",
                                     f"{_period_sql(False, 'WHERE FALSE').replace('live AS', 'later AS')}, live AS (SELECT * FROM ref), {DRIFT_SQL}"))
def psi_same_period(spark, sf):
    stats = store(reference_table(spark, sf))
    same = clean_period(FX.periods(spark, sf)[0])
    return DR.psi(stats, DR.live_counts(same, stats, BY), BY).withColumn("psi", round_to(F.col("psi"), 6))


SIGNAL_SQL = f"""signals AS (SELECT tenant_id, feature, {round_sql('psi', 4)} AS psi, CASE WHEN psi >= 0.25e0 THEN 'alert' ELSE 'warn' END AS severity,
  'PSI ' || printf('%.3f', {round_sql('psi', 3)}) || ' — the distribution of ''' || feature || ''' has moved ' || CASE WHEN psi >= 0.25e0 THEN 'materially' ELSE 'noticeably' END || ' since training' AS detail
  FROM psi WHERE psi >= 0.1e0),
drift AS (SELECT r.tenant_id, CASE WHEN n < 50 THEN 'insufficient_data' WHEN coalesce(alerts, 0) > 0 THEN 'alert' WHEN coalesce(warnings, 0) > 0 THEN 'warn' ELSE 'ok' END AS status, n AS rows_examined,
  CAST(CASE WHEN n < 50 THEN 0 ELSE coalesce(alerts, 0) END AS BIGINT) AS alerts, CAST(CASE WHEN n < 50 THEN 0 ELSE coalesce(warnings, 0) END AS BIGINT) AS warnings, CASE WHEN n >= 50 THEN worst_psi END AS worst_psi
  FROM (SELECT tenant_id, COUNT(*) AS n FROM live GROUP BY 1) r LEFT JOIN (SELECT tenant_id, COUNT(*) FILTER (severity = 'alert') AS alerts, COUNT(*) FILTER (severity = 'warn') AS warnings, MAX(psi) AS worst_psi FROM signals GROUP BY 1) s USING (tenant_id))"""


@query("drift_signals", with_leads("SELECT * FROM signals", f"{_period_sql(True)}, {DRIFT_SQL}, {SIGNAL_SQL}"))
def drift_signals(spark, sf):
    stats, live = _shifted(spark, sf)
    return DR.drift_signals(stats, live, BY)


@query("detect_drift", with_leads("SELECT * FROM drift", f"{_period_sql(True)}, {DRIFT_SQL}, {SIGNAL_SQL}"))
def detect_drift(spark, sf):
    stats, live = _shifted(spark, sf)
    return DR.detect_drift(stats, live, BY)


_ADVICE = ("CASE status WHEN 'ok' THEN 'No action needed.' WHEN 'insufficient_data' THEN 'Collect more scored leads and outcomes.' "
           "WHEN 'warn' THEN 'Monitor; schedule a retrain if the trend continues.' ELSE 'Retrain on recent data.' END")


@query("health_rollup", with_scored(f"""
SELECT tenant_id, status, drift, calibration, status = 'alert' AS action_required, {_ADVICE} AS recommendation FROM (
  SELECT tenant_id, d.status AS drift, c.status AS calibration, ['ok','insufficient_data','warn','alert'][greatest(
    list_position(['ok','insufficient_data','warn','alert'], d.status), list_position(['ok','insufficient_data','warn','alert'], c.status))] AS status
  FROM drift d JOIN calibration c USING (tenant_id))""",
    f"{_period_sql(True)}, {DRIFT_SQL}, {SIGNAL_SQL}, {CAL_REPORT_SQL}"))
def health_rollup(spark, sf):
    stats, live = _shifted(spark, sf)
    calibration = M.calibration_report(store(FX.scored(spark, sf).select("tenant_id", "probability", "converted")),
                                       "probability", "converted", BY)
    return DR.health_rollup(DR.detect_drift(stats, live, BY), calibration, BY)


# ------------------------------------------------------------------ windowed, as streams

WIDTH, DELAY = "90 days", "10 days"
_SECONDS = 90 * 86400
_WINDOW_SQL = f"to_timestamp(floor(epoch(created_at) / {_SECONDS}) * {_SECONDS})::TIMESTAMP"
_CLOSED_SQL = f"window_start + INTERVAL 90 DAY <= (SELECT MAX(created_at) - INTERVAL 10 DAY FROM leads)"


def _order_stream(spark, sf):
    schema = FX.table(spark, sf, "orders").schema
    return J.file_stream(spark, sf, schema, glob="orders.parquet")


@query("windowed_drift", with_leads(f"SELECT window_start, tenant_id, feature, {round_sql('psi', 6)} AS psi FROM psi",
       f"{_period_sql(False, '')}, {STAT_SQL}, " + LIVE_SQL.replace("live_binned AS (", "binned_at AS (")
       + ", live_binned AS (SELECT * FROM (SELECT *, " + _WINDOW_SQL + " AS window_start FROM binned_at) WHERE " + _CLOSED_SQL + "), " + psi_sql("window_start")))
def windowed_drift(spark, sf):
    stats = store(reference_table(spark, sf))
    live = clean_period(FX.leads(spark, sf, _order_stream(spark, sf)))
    out, mark = new_folder(spark, "window-bins"), new_folder(spark, "window-mark")
    job = J.stream_drift(live, stats, "created_at", WIDTH, DELAY, out, mark, BY)
    job.awaitTermination()
    counts = spark.read.parquet(out)
    scores = J.windowed_psi(counts, stats, BY)
    return scores.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tenant_id", "feature",
                         round_to(F.col("psi"), 6).alias("psi"))


@query("windowed_calibration", with_scored(f"""
SELECT window_start, tenant_id, CAST(SUM(n) AS BIGINT) AS sample_size, {round_sql('SUM(abs(positives - score_sum)) / SUM(n)', 6)} AS expected_calibration_error,
  {round_sql('SUM(squared_error) / SUM(n)', 6)} AS brier, {round_sql('CAST(SUM(positives) AS DOUBLE) / SUM(n)', 6)} AS observed_rate
FROM (SELECT {_WINDOW_SQL} AS window_start, tenant_id, {_bin_sql(10)} AS bin, COUNT(*) AS n, SUM(probability) AS score_sum, SUM(converted) AS positives,
   SUM((probability - converted) * (probability - converted)) AS squared_error FROM scored WHERE converted IS NOT NULL GROUP BY 1, 2, 3)
WHERE {_CLOSED_SQL.replace('FROM leads', 'FROM leads WHERE converted IS NOT NULL')} GROUP BY 1, 2"""))
def windowed_calibration(spark, sf):
    scored = FX.scored(spark, sf, _order_stream(spark, sf)).where(F.col("converted").isNotNull())
    out, mark = new_folder(spark, "window-scores"), new_folder(spark, "window-mark")
    job = J.stream_calibration(scored, "created_at", WIDTH, DELAY, out, mark, BY)
    job.awaitTermination()
    rolled = J.windowed_calibration(spark.read.parquet(out), BY)
    return rolled.withColumns({c: round_to(F.col(c), 6) for c in ("expected_calibration_error", "brier", "observed_rate")}
                              ).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
