"""Training, calibration and promotion of every tenant's model in one grouped job.

All statistics and gradients are keyed by the model they belong to, so a thousand tenants cost
the jobs of one. The number of labels decides a tenant's tier: without labels the shared base
model scores it; with few the base model is recalibrated to it; with enough it gets a model of its own. A model
is a ridge-penalised logistic regression on scaled numbers and on level effects: the smoothed
log odds of a level against the model's rate, counted without the row's own fold while
training. A row is therefore as wide as there are features, however many levels they have.

Newton steps run for all models together: a task adds the gradient and curvature of each model
whose rows it holds, Spark sums them by model, and each model's small system is solved in its
own row. A tenant with a third of all rows is only more partial sums. Nothing of the data and
no model passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake import schema, settings as S
from leadlake.functions import scoring as X
from leadlake.operators.clean import baseline_medians, clean_frame, long_features
from leadlake.operators.isotonic import calibrators, isotonic_blocks
from leadlake.operators.metrics import model_metrics
from leadlake.operators.score import interpolate_arrays
from leadlake.operators.train import stratified_split
from leadlake.session import store

BASE = "base"
FOLDS = 4
PRIOR = 20.0  # rows of the model's rate that every level starts with
RIDGE = 1.0
STEPS = 8


def tenant_tiers(labelled: DataFrame, tenants: DataFrame, label: str = "converted") -> DataFrame:
    """A row per tenant: tenant_id, labels, positives, tier, action, and ``own``: whether it can have a model of its own.

    A tenant with one class alone cannot be trained or recalibrated; it keeps the base model.
    """
    y = F.col(label).cast("int")
    counts = labelled.where(y.isNotNull()).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(y).cast("bigint").alias("positives"))
    joined = tenants.select("tenant_id").join(counts, "tenant_id", "left").fillna(0, ["labels", "positives"])
    plan = X.training_plan(F.col("labels"))
    few = F.least("positives", F.col("labels") - F.col("positives"))
    action = (F.when(few == 0, "keep_base_model")
              .when((plan["action"] == "train_tenant_model") & (few < S.MIN_CLASS_ROWS), "recalibrate").otherwise(plan["action"]))
    return joined.select("tenant_id", "labels", "positives", plan["tier"].alias("tier"), action.alias("action"),
                         (action == "train_tenant_model").alias("own"))


def _fold(id_column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(11)), F.lit(FOLDS)).cast("int")


def _effect(positives: Column, n: Column, rate: Column) -> Column:
    odds = (positives + PRIOR * rate) / (n - positives + PRIOR * (1.0 - rate))
    return F.log(odds) - F.log(rate / (1.0 - rate))


@dataclass
class TenantModels:
    """Every model of a training run, as tables: statistics (a row per model), effects (per model, feature and
    level), weights (a row per model), calibration (a row per recalibrated tenant) and tiers (a row per tenant)."""

    numeric: list[str]
    categorical: list[str]
    statistics: DataFrame
    effects: DataFrame
    tiers: DataFrame
    weights: DataFrame | None = None
    calibration: DataFrame | None = None

    def encode(self, rows: DataFrame, training: Column) -> DataFrame:
        """Adds ``x`` to clean rows with model_of and _fold; where ``training`` holds, a level's effect leaves out the row's fold.

        Statistics and each feature's levels are joined by model; Catalyst broadcasts what is small.
        """
        made = rows.join(self.statistics, "model_of").withColumn("_train", training)
        kept = [*rows.columns, "_train", "rate"]
        x = [F.lit(1.0)]
        for c in self.numeric:
            x.append((F.coalesce(F.col(c), F.col(f"{c}_fill")) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
        for c in self.categorical:
            part = self.effects.where(F.col("feature") == c).select(
                F.col("model_of").alias("_of"), F.col("value").alias("_value"), F.struct("n", "positives", "n_fold", "positives_fold").alias(f"_{c}"))
            same = (F.col("model_of") == F.col("_of")) & (F.coalesce(F.col(c), F.lit(schema.UNKNOWN)) == F.col("_value"))
            made = made.join(part, same, "left").drop("_of", "_value")
            own = lambda name, c=c: F.when(F.col("_train"), F.get(F.col(f"_{c}.{name}_fold"), F.col("_fold"))).otherwise(0)
            effect = _effect(F.col(f"_{c}.positives") - own("positives"), F.col(f"_{c}.n") - own("n"), F.col("rate"))
            x.append(F.coalesce(effect, F.lit(0.0)))
        return made.select(*kept, F.array(*x).alias("x")).drop("_train", "rate")

    def probabilities(self, encoded: DataFrame, name: str = "p") -> DataFrame:
        """Adds the model's probability to rows with model_of and x."""
        joined = encoded.join(self.weights, "model_of")
        score = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return joined.withColumn(name, 1.0 / (1.0 + F.exp(-score))).drop("beta")

    def score(self, leads: DataFrame, id_column: str = "external_id") -> DataFrame:
        """Adds ``probability`` and ``model`` (own, recalibrated or base) to leads with tenant_id.

        A tenant that training has not seen, or a null one, has the base model.
        """
        body = leads.withColumn("_lead", F.struct(*leads.columns))
        clean = clean_frame(body, keep=["_lead"]).withColumn("_tenant", F.col("_lead.tenant_id"))
        tiers = self.tiers.select(F.col("tenant_id").alias("_tier_of"), "own")
        routed = clean.join(tiers, F.col("_tenant") == F.col("_tier_of"), "left")
        own = F.coalesce("own", F.lit(False))
        routed = routed.withColumn("model_of", F.when(own, F.concat(F.lit("tenant:"), "_tenant")).otherwise(BASE)).withColumn("_fold", F.lit(0))
        scored = self.probabilities(self.encode(routed, F.lit(False)), "_p")
        tuned = self.calibration.select(F.col("tenant_id").alias("_tuned_of"), "boundaries", "predictions")
        scored = scored.join(tuned, F.col("_tenant") == F.col("_tuned_of"), "left")
        fitted = interpolate_arrays(F.col("_p"), F.col("boundaries"), F.col("predictions"))
        model = F.when(F.col("boundaries").isNotNull(), "recalibrated").when(F.col("model_of") != BASE, "own").otherwise(BASE)
        kept = [F.col("_lead").getField(c).alias(c) for c in leads.columns if c not in ("probability", "model")]
        return scored.select(*kept, F.coalesce(fitted, "_p").alias("probability"), model.alias("model"))


def _statistics(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """A row per model: rows, rate, and what fills, centres and scales each number."""
    made = train.groupBy("model_of").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("_rate"))
    made = made.withColumn("rate", F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), "_rate"))).drop("_rate")
    if not numeric:
        return store(made)
    fills = baseline_medians(train, numeric, ["model_of"]).groupBy("model_of").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"{c}_fill") for c in numeric])
    made = store(made.join(fills, "model_of", "left").fillna(0.0, [f"{c}_fill" for c in numeric]))
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}_fill")) for c in numeric}
    spread = train.join(made, "model_of").groupBy("model_of").agg(*[x for c, v in filled.items() for x in (
        F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"))])
    stds = {f"{c}_std": F.coalesce(F.nullif(F.col(f"{c}_std"), F.lit(0.0)), F.lit(1.0)) for c in numeric}
    return store(made.join(spread.withColumns(stds), "model_of"))


def _effects(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(model_of, feature, value): n, positives, and both by fold."""
    named = train.select("model_of", "_fold", "label", *[F.coalesce(F.col(c), F.lit(schema.UNKNOWN)).alias(c) for c in categorical])
    long = long_features(named, categorical, ["model_of", "_fold", "label"])
    n = [F.count_if(F.col("_fold") == k).alias(f"n{k}") for k in range(FOLDS)]
    positives = [F.count_if((F.col("_fold") == k) & (F.col("label") == 1)).alias(f"p{k}") for k in range(FOLDS)]
    counts = long.groupBy("model_of", "feature", "value").agg(*n, *positives)
    both = {"n": [f"n{k}" for k in range(FOLDS)], "positives": [f"p{k}" for k in range(FOLDS)]}
    return store(counts.select(
        "model_of", "feature", "value", *[F.array(*c).alias(f"{name}_fold") for name, c in both.items()],
        *[sum((F.col(x) for x in c), F.lit(0)).alias(name) for name, c in both.items()]))


def newton_sums(rows: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """(model_of, sums): gradient and upper triangle of the curvature of each model's log likelihood at its weights."""
    upper = np.triu_indices(width)
    places = width + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            models = batch.column(0).dictionary_encode()  # a number a row; no row becomes a Python string
            number = models.indices.to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x, beta = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for i in (2, 3))
            p = 1 / (1 + np.exp(-np.clip((x * beta).sum(1), -500, 500)))
            for k, model in enumerate(models.dictionary.to_pylist()):
                own = number == k
                a, heavy = x[own], (p * (1 - p))[own]
                part = np.concatenate([a.T @ (y - p)[own], ((a * heavy[:, None]).T @ a)[upper]])
                totals[model] = totals.get(model, 0) + part
        for model, sums in totals.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([model] * places), pa.array(np.arange(places), pa.int32()), pa.array(sums)], names=["model_of", "place", "part"])

    parts = rows.join(weights, "model_of").select("model_of", F.col("label").cast("double"), "x", "beta")
    summed = parts.mapInArrow(run, "model_of string, place int, part double").groupBy("model_of", "place").agg(F.sum("part").alias("part"))
    ordered = summed.groupBy("model_of").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("s"))  # width squared numbers
    return ordered.select("model_of", F.col("s.part").alias("sums"))


def newton_step(beta: np.ndarray, sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The weights after one step on the penalised log likelihood; the intercept, at place 0, has no penalty."""
    width = len(beta)
    curvature = np.zeros((width, width))
    curvature[np.triu_indices(width)] = sums[width:]
    curvature = curvature + np.triu(curvature, 1).T
    penalty = np.full(width, ridge)
    penalty[0] = 1e-9
    return beta + np.linalg.solve(curvature + np.diag(penalty), sums[:width] - penalty * beta)


def _fit(rows: DataFrame, statistics: DataFrame, width: int, steps: int) -> DataFrame:
    """(model_of, beta) after Newton's steps for all models together; each step's weights are a stored table."""
    start = F.concat(F.array(F.log(F.col("rate") / (1 - F.col("rate")))), F.array_repeat(F.lit(0.0), width - 1))
    weights = store(statistics.select("model_of", start.alias("beta")))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [newton_step(np.array(b), np.array(s)) for b, s in zip(batch["beta"], batch["sums"], strict=True)]
            yield pd.DataFrame({"model_of": batch["model_of"], "beta": [m.tolist() for m in made]})

    for _ in range(steps):
        sums = newton_sums(rows, weights, width)
        weights = store(weights.join(sums, "model_of").select("model_of", "beta", "sums").mapInPandas(step, "model_of string, beta array<double>"))
    return weights


def train_tenants(
    rows: DataFrame, tenants: DataFrame, version: str, created_at: Column, id_column: str = "external_id", label: str = "converted",
    numeric: Sequence[str] = tuple(schema.NUMERIC_FEATURES), categorical: Sequence[str] = tuple(schema.CATEGORICAL_FEATURES), steps: int = STEPS,
) -> tuple[TenantModels, DataFrame, DataFrame]:
    """(models, metrics, challengers) of all tenants.

    ``rows`` have tenant_id, the id, a label of 0, 1 or null, and canonical features. ``metrics`` has a row
    per tenant and model (base_model, and for tenants with labels of both classes hybrid_ensemble, their challenger),
    on held-out rows; a recalibrated tenant is judged on all its labels. Metrics of the base model over all tenants have a null tenant.
    ``challengers`` has what ``promote`` takes. Rows without a tenant train the base model alone. Without any
    labelled row of both classes nothing can be trained: ValueError.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    tiers = store(tenant_tiers(known, tenants, label))
    seen = known.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if seen["low"] is None or int(seen["low"]) == int(seen["high"]):
        raise ValueError("training needs labelled leads of both classes")
    named = known.withColumn("_tenant", F.coalesce("tenant_id", F.lit("")))
    split = stratified_split(named.withColumn("label", F.col(label).cast("int")), "label", id_column, ["_tenant"])
    facts = [id_column, "tenant_id", "label", "is_test"]
    clean = store(clean_frame(split, keep=facts).select(*facts, *numeric, *categorical, _fold(id_column).alias("_fold")))
    own = clean.join(tiers.where("own").select("tenant_id"), "tenant_id", "left_semi")
    scoped = clean.withColumn("model_of", F.lit(BASE)).unionByName(own.withColumn("model_of", F.concat(F.lit("tenant:"), "tenant_id")))
    train = scoped.where("not is_test")
    models = TenantModels(list(numeric), list(categorical), _statistics(train, numeric), _effects(train, categorical), tiers)
    encoded = store(models.encode(scoped, ~F.col("is_test")).select("model_of", "tenant_id", id_column, "label", "is_test", "x"))
    models.weights = _fit(encoded.where("not is_test"), models.statistics, 1 + len(numeric) + len(categorical), steps)

    scored = store(models.probabilities(encoded).select("model_of", "tenant_id", "label", "is_test", "p"))
    tuning = tiers.where("action = 'recalibrate'").select("tenant_id")
    base = scored.where(F.col("model_of") == BASE)
    # as they will be scored: no fold is left out of the effects
    tuned_rows = clean.join(tuning, "tenant_id", "left_semi").withColumn("model_of", F.lit(BASE))
    few = store(models.probabilities(models.encode(tuned_rows, F.lit(False))).select(*scored.columns))
    models.calibration = store(calibrators(isotonic_blocks(few, "p", "label", ["tenant_id"]), ["tenant_id"]))
    tuned = few.join(models.calibration, "tenant_id").withColumn("p", interpolate_arrays(F.col("p"), F.col("boundaries"), F.col("predictions")))

    judged = base.where("is_test").join(tuning, "tenant_id", "left_anti").unionByName(few)
    challenger = F.lit(S.ENSEMBLE_NAME).alias("model")
    pairs = (judged.select("tenant_id", F.lit("base_model").alias("model"), "label", "p")
             .unionByName(base.where("is_test").select(F.lit(None).cast("string").alias("tenant_id"), F.lit("base_model").alias("model"), "label", "p"))
             .unionByName(scored.where(f"is_test and model_of <> '{BASE}'").select("tenant_id", challenger, "label", "p"))
             .unionByName(tuned.select("tenant_id", challenger, "label", "p")))
    metrics = store(model_metrics(pairs.withColumn("_tenant", F.to_json(F.struct("tenant_id"))).drop("tenant_id"), "p", "label", ["_tenant", "model"])
                    .withColumn("tenant_id", F.get_json_object("_tenant", "$.tenant_id")).drop("_tenant"))
    made = metrics.where(F.col("model") == S.ENSEMBLE_NAME).select(F.col("tenant_id").alias("_of"), "roc_auc")
    trained = tiers.where("action <> 'keep_base_model'")
    challengers = trained.join(made, F.col("tenant_id") == F.col("_of"), "left").select(
        "tenant_id", F.lit(version).alias("version"), "tier", "roc_auc", (F.col("positives") / F.col("labels")).alias("conversion_rate"),
        F.col("labels").alias("training_rows"), created_at.alias("created_at"))
    return models, metrics, challengers
