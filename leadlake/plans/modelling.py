"""Queries that fit models, on all labelled leads; ``isotonic_cv`` and ``cross_validate_models`` as published, others with few rounds and folds.
Where no SQL twin exists, tests check their properties."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from leadlake.functions.numbers import round_to
from leadlake.operators import boosting as BO
from leadlake.operators import clean as C
from leadlake.operators import isotonic as IS
from leadlake.operators import preprocess as PP
from leadlake.operators import score as SC
from leadlake.operators import tenants as TN
from leadlake.operators import train as TR
from leadlake.plans import fixtures as FX
from leadlake.plans.fixtures import round_sql, with_leads, with_scored
from leadlake.plans.registry import query
from leadlake.session import store

ROUNDS, TREES, FOLDS = 5, 10, 2
NUM = ["time_on_site_seconds", "total_visits", "page_views_per_visit"]
CAT = ["channel", "industry", "country", "occupation", "last_activity"]
UNREAD = ["lead_id", "source_id", "display_name", "do_not_contact", "deal_value", "scored_at"]  # by training, versions and scores


def training_rows(spark, sf, leads=None):
    """Labelled leads with a label that follows engagement, so that there is something to learn.

    Stored: training reads them many times, and each time would derive all leads anew.
    """
    s = SC.heuristic_scores(FX.leads(spark, sf) if leads is None else leads).where(F.col("converted").isNotNull())
    noise = F.pmod(F.col("lead_key") * 7919, F.lit(1000)) / 1000.0
    return store(s.select("tenant_id", "lead_key", "external_id", *NUM, *CAT,
                          (F.col("probability") + noise * 0.6 > 0.8).cast("int").alias("converted")))


TRAINING_SQL = f"""training AS (
  SELECT tenant_id, lead_key, external_id, {', '.join(NUM)},
         {', '.join(f"CASE WHEN {c} IN ('Select', 'Unknown') THEN 'Unknown' ELSE {c} END AS {c}" for c in CAT)}, probability,
         CAST(probability + ((lead_key * 7919) % 1000) / 1000e0 * 0.6e0 > 0.8e0 AS INTEGER) AS converted
  FROM scored WHERE converted IS NOT NULL)"""


def small_learners():
    """The three learners of the ensemble."""
    return {"random_forest": TR.train_forest(TREES, 6), "boosted_a": TR.train_boosted_a(ROUNDS), "boosted_b": TR.train_boosted_b(ROUNDS)}


def small_model(rows):
    return TR.train_model(rows, "v1", id_column="lead_key", learners=small_learners(), folds=FOLDS)


def _prepared(spark, sf):
    """(fitted preprocessor, feature vectors of the training rows)."""
    clean = C.clean_frame(training_rows(spark, sf), keep=["lead_key", "converted"])
    prep = TR.Preprocessor(NUM, CAT).fit(clean)
    made = prep.apply(clean).select("lead_key", F.col("converted").cast("double").alias("label"), "features")
    return prep, TR.with_balance(store(made))


def ready(spark, sf):
    return _prepared(spark, sf)[1]


def _level_sql(c):
    return (f"SELECT '{c}' AS feature, {c} AS value, row_number() OVER (ORDER BY md5({c}), {c}) - 1 AS slot "
            f"FROM training GROUP BY {c} HAVING COUNT(*) >= 25")


def _z_sql(c):
    filled = f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM training))"
    return (f"{round_sql(f'({filled} - (SELECT avg({filled}) FROM training)) / (SELECT stddev_pop({filled}) FROM training)', 6)} AS {c}")


@query("preprocess", with_scored(f"""
SELECT lead_key, converted AS label, {', '.join(map(_z_sql, NUM))},
       {', '.join(f"coalesce((SELECT CAST(slot AS INTEGER) FROM levels l WHERE l.feature = '{c}' AND l.value = t.{c}), "
                  f"(SELECT CAST(COUNT(*) AS INTEGER) FROM levels WHERE feature = '{c}')) AS {c}" for c in CAT)}
FROM training t""", f"{TRAINING_SQL}, levels AS ({' UNION ALL '.join(map(_level_sql, CAT))})"))
def preprocess(spark, sf):
    """The scaled numbers and the slots that are set in the feature vectors of all labelled leads."""
    clean = C.clean_frame(training_rows(spark, sf), keep=["lead_key", "converted"])
    prep = PP.Preprocessor(NUM, CAT).fit(clean)
    made = prep.apply(clean).select("lead_key", F.col("converted").alias("label"), vector_to_array("features").alias("v"))
    out, at = [round_to(F.get("v", F.lit(i)), 6).alias(c) for i, c in enumerate(NUM)], len(NUM)
    for c, n in prep.sizes.items():
        out.append((F.array_position(F.slice("v", at + 1, n), 1.0) - 1).cast("int").alias(c))
        at += n
    return made.select("lead_key", "label", *out)


@query("isotonic_blocks", with_scored(f"""
SELECT tenant_id, {round_sql('min(x)', 6)} AS lo, {round_sql('max(x)', 6)} AS hi, {round_sql('value', 9)} AS value, CAST(sum(w) AS DOUBLE) AS weight
FROM fitted JOIN points USING (tenant_id, i) GROUP BY tenant_id, value""", f"""{TRAINING_SQL},
points AS (
  SELECT *, row_number() OVER o AS i, sum(t) OVER o AS tt, sum(w) OVER o AS ww
  FROM (SELECT tenant_id, probability AS x, sum(converted) AS t, count(*) AS w FROM training GROUP BY 1, 2)
  WINDOW o AS (PARTITION BY tenant_id ORDER BY x)),
runs AS (
  SELECT tenant_id, a.i AS a, b.i AS i, CAST(b.tt - a.tt + a.t AS DOUBLE) / (b.ww - a.ww + a.w) AS mean
  FROM points a JOIN points b USING (tenant_id) WHERE b.i >= a.i),
lower AS (SELECT tenant_id, a, i, min(mean) OVER (PARTITION BY tenant_id, a ORDER BY i DESC) AS low FROM runs),
fitted AS (SELECT tenant_id, i, max(low) AS value FROM lower GROUP BY 1, 2)"""))
def isotonic_blocks(spark, sf):
    """The calibration of every tenant's scores, as blocks; the oracle is the minimax formula."""
    rows = FX.scored(spark, sf).select("lead_key", "probability").join(training_rows(spark, sf), "lead_key")
    blocks = IS.isotonic_blocks(rows, "probability", "converted", ["tenant_id"])
    return blocks.select("tenant_id", round_to(F.col("lo"), 6).alias("lo"), round_to(F.col("hi"), 6).alias("hi"),
                         round_to(F.col("value"), 9).alias("value"), "weight")


PARTLY_SQL = """partly AS (SELECT * FROM training WHERE tenant_id NOT IN ('EUROPE', 'MIDDLE EAST') OR (tenant_id = 'EUROPE' AND lead_key % 20 = 0))"""


def partly_labelled(spark, sf, leads=None):
    """The training rows, of which one tenant has few labels and one has none."""
    few = (F.col("tenant_id") == "EUROPE") & (F.pmod(F.col("lead_key"), F.lit(20)) == 0)
    return training_rows(spark, sf, leads).where(~F.col("tenant_id").isin("EUROPE", "MIDDLE EAST") | few)


@query("train_tenants", with_scored(f"""
SELECT tenant_id, model, labels, positives, tier, action, model = 'hybrid_ensemble' AND champion IS DISTINCT FROM 1e0 AS promote,
       CASE WHEN model = 'base_model' THEN 'shared' WHEN champion IS NULL THEN 'first model'
            WHEN champion < 0.5e0 THEN 'beats champion' ELSE 'keeps champion' END AS outcome
FROM tiers CROSS JOIN (VALUES ('base_model'), ('hybrid_ensemble')) m(model)
WHERE model = 'base_model' OR action <> 'keep_base_model'""", f"""{FX.TENANTS_SQL}, {TRAINING_SQL}, {PARTLY_SQL},
counted AS (SELECT tenant_id, COUNT(p.lead_key) AS labels, CAST(coalesce(SUM(converted), 0) AS BIGINT) AS positives
            FROM tenants LEFT JOIN partly p USING (tenant_id) GROUP BY 1),
tiers AS (SELECT *, CASE WHEN labels >= 5000 THEN 'continuous' WHEN labels >= 500 THEN 'tenant' WHEN labels >= 1 THEN 'recalibrated' ELSE 'generic' END AS tier,
  CASE WHEN least(positives, labels - positives) = 0 THEN 'keep_base_model'
       WHEN labels >= 500 AND least(positives, labels - positives) >= 25 THEN 'train_tenant_model' ELSE 'recalibrate' END AS action,
  CASE tenant_id WHEN 'ASIA' THEN 1e0 WHEN 'AMERICA' THEN 0.1e0 WHEN 'EUROPE' THEN 0.1e0 END AS champion FROM counted)"""))
def train_tenants(spark, sf):
    """Every tenant's tier, its models, and whether the new one takes over; one grouped training job."""
    tenants = FX.tenants(spark, sf)
    made, metrics, challengers = TN.train_tenants(partly_labelled(spark, sf), tenants, "v2", FX.as_of(), "lead_key", numeric=NUM, categorical=CAT)
    auc = F.when(F.col("tenant_id") == "ASIA", 1.0).when(F.col("tenant_id").isin("AMERICA", "EUROPE"), 0.1)
    pairs = challengers.withColumns({"challenger_auc": F.col("roc_auc"), "champion_auc": auc, "has_champion": auc.isNotNull()})
    judged = TR.should_promote(pairs).select(F.col("tenant_id").alias("_of"), "promote", "reason")
    known = metrics.where("model = 'hybrid_ensemble'").select(F.col("tenant_id").alias("_measured"))
    joined = made.tiers.join(judged, F.col("tenant_id") == F.col("_of"), "left").join(known, F.col("tenant_id") == F.col("_measured"), "left")
    models = F.when(F.col("_measured").isNotNull(), F.array(F.lit("base_model"), F.lit("hybrid_ensemble"))).otherwise(F.array(F.lit("base_model")))
    rows = joined.withColumn("model", F.explode(models))
    base = F.col("model") == "base_model"
    outcome = (F.when(base, "shared").when(F.col("reason").startswith("first model"), "first model")
               .when(F.col("reason").contains("beats champion"), "beats champion").otherwise("keeps champion"))
    return rows.select("tenant_id", "model", "labels", "positives", "tier", "action", (~base & F.col("promote")).alias("promote"), outcome.alias("outcome"))


@query("score_tenants")
def score_tenants(spark, sf):
    """Every lead's probability by its own tenant's model, calibration or the base model."""
    leads = store(FX.leads(spark, sf).drop(*UNREAD))
    models, _, _ = TN.train_tenants(partly_labelled(spark, sf, leads), FX.tenants(spark, sf), "v2", FX.as_of(), "lead_key", numeric=NUM, categorical=CAT)
    scored = SC.with_decision(models.score(leads, "lead_key"))
    return scored.select("tenant_id", "lead_key", "model", round_to(F.col("probability"), 6).alias("probability"), "band", "prediction")


def _halves(data):
    """(rows to fit, rows held out): a fifth is held out, by its key."""
    held = F.pmod(F.col("lead_key") * 31, F.lit(5)) == 0
    return data.where(~held), data.where(held)


def _fitted(spark, sf, learner, name, fit, folds=None):
    """Calibrated scores of rows that the fit has not seen; the published number of folds if none is given."""
    train, held = _halves(ready(spark, sf))
    model = fit(name, learner, train, "lead_key", folds or TR.calibration_folds(train))
    return model.score(held.select("lead_key", "label", "features"), "p").select("lead_key", "label", round_to(F.col("p"), 6).alias("p"))


def _predicted(spark, sf, learner):
    train, held = _halves(ready(spark, sf))
    return learner.fit(train).transform(held).select("lead_key", "label", "prediction")


@query("train_forest")
def train_forest(spark, sf):
    return _predicted(spark, sf, TR.train_forest(TREES, 6))


@query("train_boosted_a")
def train_boosted_a(spark, sf):
    return _predicted(spark, sf, TR.train_boosted_a(ROUNDS))


@query("train_boosted_b")
def train_boosted_b(spark, sf):
    return _predicted(spark, sf, TR.train_boosted_b(ROUNDS))


@query("train_leafwise")
def train_leafwise(spark, sf):
    """Leaf-wise boosted trees of up to 31 leaves; the probabilities of rows held out."""
    train, held = _halves(store(training_rows(spark, sf).select("lead_key", F.col("converted").alias("label"), *NUM)))
    model = BO.fit(train, NUM, "label", "lead_key", BO.Settings(rounds=2, bins=64))
    return model.score(held).select("lead_key", "label", round_to(F.col("probability"), 6).alias("probability"))


@query("isotonic_cv")
def isotonic_cv(spark, sf):
    """The published forest and folds."""
    return _fitted(spark, sf, TR.train_forest(), "random_forest", TR.isotonic_cv)


@query("platt_cv")
def platt_cv(spark, sf):
    return _fitted(spark, sf, TR.train_forest(TREES, 6), "random_forest", TR.platt_cv, FOLDS)


@query("train_model")
def train_model(spark, sf):
    return small_model(training_rows(spark, sf)).tables["metrics"]


def _newest(versions, tenant):
    mine = versions.where(F.col("is_active") & F.col("tenant_id").eqNullSafe(F.lit(tenant)))
    return mine.agg(F.max_by("version", "created_at")).first()[0]


def _scored_table(spark, sf):
    """The shared base model and two tenants' own models score the whole lead table."""
    leads = store(FX.leads(spark, sf).drop(*UNREAD))
    rows, versions = training_rows(spark, sf, leads), FX.model_versions(spark, sf, leads)
    base = small_model(rows)
    own = {t: TR.recalibrate(base, rows.where(F.col("tenant_id") == t), f"own-{t}") for t in ("ASIA", "AFRICA")}
    # Versions are month stamps, so tenants may share one: the key is tenant and version.
    named = versions.withColumn("version", F.when(F.col("tenant_id").isNull(), F.concat(F.lit("base-"), "version"))
                                .otherwise(F.concat("tenant_id", F.lit("-"), "version")))
    scorers = {_newest(named, None): base} | {_newest(named, t): m for t, m in own.items()}
    scored = SC.score_table(leads, scorers, named)
    return scored.withColumn("model_version", F.regexp_replace("model_version", "^[^-]*-", ""))


@query("score_table", with_leads(f"""
SELECT lead_key, l.tenant_id, version AS model_version, TRUE AS in_range, TRUE AS band_fits, TRUE AS prediction_fits
FROM leads l JOIN (SELECT coalesce(o.tenant_id, t.tenant_id) AS tenant_id, coalesce(o.version, b.version) AS version FROM tenants t
  LEFT JOIN (SELECT tenant_id, arg_max(version, created_at) AS version FROM models WHERE is_active AND tenant_id IS NOT NULL GROUP BY 1) o USING (tenant_id)
  CROSS JOIN (SELECT arg_max(version, created_at) AS version FROM models WHERE is_active AND tenant_id IS NULL) b) v USING (tenant_id)""",
                              f"{FX.TENANTS_SQL}, {FX.MODELS_SQL}"))
def score_table(spark, sf):
    """Every lead with the version that scores it, and whether band and prediction are those of its probability."""
    scored = store(_scored_table(spark, sf).select("lead_key", "tenant_id", "model_version", "probability", "band", "prediction"))
    p = F.col("probability")
    band = F.when(p >= 0.75, "hot").when(p >= 0.5, "warm").when(p >= 0.25, "cool").otherwise("cold")
    return scored.select("lead_key", "tenant_id", "model_version", F.coalesce(p.between(0, 1), F.lit(False)).alias("in_range"),
                         (F.col("band") == band).alias("band_fits"), ((F.col("prediction") == 1) == (p >= 0.5)).alias("prediction_fits"))


@query("score_table_rows")
def score_table_rows(spark, sf):
    """The scores themselves."""
    return _scored_table(spark, sf).select("lead_key", "tenant_id", "model_version", round_to(F.col("probability"), 6).alias("probability"), "band", "prediction")


@query("recalibrate")
def recalibrate(spark, sf):
    rows = training_rows(spark, sf)
    tuned = TR.recalibrate(small_model(rows), rows.where(F.col("tenant_id") == "ASIA"), "v2")
    return tuned.score(rows).select("lead_key", "tenant_id", "probability")


@query("explain_model")
def explain_model(spark, sf):
    rows = training_rows(spark, sf)
    model = small_model(rows)
    base = store(C.baseline_row(C.clean_frame(rows)))
    impacts = TR.explain_ablation(rows, model, base, ["lead_key"])
    return TR.top_contributions(impacts, ["lead_key"], 6)


@query("cross_validate_models")
def cross_validate_models(spark, sf):
    """Ten folds of all labelled leads for each of seven classifiers."""
    prep, data = _prepared(spark, sf)
    return TR.cross_validate_models(data, TR.comparison_learners(prep.width))


@query("random_search")
def random_search(spark, sf):
    space = {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 4]}
    return TR.random_search(ready(spark, sf), TR.train_forest(TREES, 6), space, tries=3, folds=FOLDS)[0]


