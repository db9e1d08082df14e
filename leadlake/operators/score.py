"""Scoring tables, model resolution, prediction log and what-if."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import settings as S
from leadlake.functions import scoring as X
from leadlake.functions.numbers import round_to
from leadlake.operators.clean import strip_pii


def heuristic_scores(leads: DataFrame) -> DataFrame:
    """Adds probability, band and prediction from the engagement heuristic."""
    out = leads.withColumn("probability", X.heuristic_score())
    return with_decision(out)


def with_decision(scored: DataFrame) -> DataFrame:
    p = F.col("probability")
    return scored.withColumns({"band": X.band(p), "prediction": X.decide(p)})


def blend(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the scores that are present, weights renormalised; null if none."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, score in parts.items():
        weight = F.lit(float(weights.get(name, 0.0)))
        top = top + F.coalesce(score * weight, F.lit(0.0))
        bottom = bottom + F.when(score.isNotNull(), weight).otherwise(0.0)
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0)))


def interpolate(score: Column, boundaries: Sequence[float], predictions: Sequence[float]) -> Column:
    """Isotonic prediction as an expression: linear between boundaries, flat outside.

    A fitted calibrator is two short arrays, so a tenant's calibration costs no model pass.
    """
    xs = F.array(*[F.lit(float(b)) for b in boundaries])
    ys = F.array(*[F.lit(float(v)) for v in predictions])
    return interpolate_arrays(score, xs, ys)


def _at_most(xs: Column, score: Column) -> Column:
    """How many of the ascending ``xs`` are at most ``score``, by binary search."""
    def step(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        go, right = s["low"] < s["high"], F.get(xs, middle) <= score
        return F.struct(
            F.when(go & right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(go & ~right, middle).otherwise(s["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(xs).alias("high")), step)["low"]


def interpolate_arrays(score: Column, xs: Column, ys: Column) -> Column:
    def at(place: Column) -> Column:
        x0, x1 = F.get(xs, place - 1), F.get(xs, place)
        y0, y1 = F.get(ys, place - 1), F.get(ys, place)
        inside = y0 + (y1 - y0) * (score - x0) / F.nullif(x1 - x0, F.lit(0.0))
        return F.when(place == 0, F.get(ys, F.lit(0))).when(place >= F.size(xs), y0).otherwise(inside)

    # The transform binds the place: written out, the search would run once for each of its eight uses.
    return F.get(F.transform(F.array(_at_most(xs, score)), at), F.lit(0))


def active_models(models: DataFrame) -> DataFrame:
    """Newest active model of each tenant (tenant null: the shared base model)."""
    body = F.struct("created_at", "version", "tier", "conversion_rate")
    return models.where("is_active").groupBy("tenant_id").agg(F.max(body).alias("_m")).select(
        "tenant_id", F.col("_m.version").alias("model_version"), F.col("_m.tier").alias("model_tier"),
        F.col("_m.conversion_rate").alias("model_conversion_rate"),
    )


def with_active_model(leads: DataFrame, models: DataFrame) -> DataFrame:
    """Adds model_version, model_tier and model_conversion_rate.

    The tenant's own model, else the base model, else the heuristic. The base model is one
    row, read as a scalar subquery. ``models`` should be a stored table: its file size lets
    Catalyst decide on a broadcast.
    """
    active = active_models(models)
    own = active.where(F.col("tenant_id").isNotNull())
    base = active.where(F.col("tenant_id").isNull()).agg(
        F.max(F.struct("model_version", "model_tier", "model_conversion_rate")).alias("b")
    ).select("b").scalar()
    joined = leads.join(own, "tenant_id", "left").withColumn("_base", base)
    has_own = F.col("model_version").isNotNull()
    out = joined.withColumns({
        "model_version": F.coalesce("model_version", F.col("_base.model_version"), F.lit("unversioned")),
        "model_tier": F.coalesce("model_tier", F.col("_base.model_tier"), F.lit("generic")),
        "model_conversion_rate": F.when(has_own, F.col("model_conversion_rate"))
                                  .otherwise(F.col("_base.model_conversion_rate")),
    })
    return out.drop("_base")


def score_table(leads: DataFrame, scorers: Mapping[str, "object"], models: DataFrame) -> DataFrame:
    """Score every tenant with its active model: one pass per distinct model.

    ``scorers`` maps a model version to an object with ``score(df)`` adding ``probability``
    (see :class:`leadlake.operators.train.Ensemble`). Versions without a scorer fall back
    to the heuristic.
    """
    routed = with_active_model(leads, models)
    parts = [
        scorer.score(routed.where(F.col("model_version") == version))
        for version, scorer in scorers.items()
    ]
    rest = routed.where(~F.col("model_version").isin(*scorers)) if scorers else routed
    parts.append(rest.withColumn("probability", X.heuristic_score()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return with_decision(out)


def prediction_rows(scored: DataFrame, created_at: Column, model_version: Column,
                    model_tier: Column, inputs: Sequence[str]) -> DataFrame:
    """Immutable log rows; personal fields never reach ``inputs``."""
    kept = strip_pii(scored.select(*inputs)).columns
    return scored.select(
        "tenant_id", "lead_id", model_version.alias("model_version"), model_tier.alias("model_tier"),
        "probability", X.decide(F.col("probability")).alias("prediction"),
        F.to_json(F.struct(*kept)).alias("inputs"), created_at.alias("created_at"),
        F.to_date(created_at).alias("score_date"),
    )


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("score_date").parquet(path)


def score_as_of(log: DataFrame, moment: Column, keys: Sequence[str] = ("tenant_id", "lead_id")) -> DataFrame:
    """The log row in force at a moment, per lead (one aggregate, no sort)."""
    rest = [c for c in log.columns if c not in keys]
    row = F.struct("created_at", *[c for c in rest if c != "created_at"])
    known = log.where(F.col("created_at") <= moment).groupBy(*keys).agg(F.max(row).alias("_row"))
    return known.select(*keys, "_row.*")


def scores_as_of(asks: DataFrame, log: DataFrame, keys: Sequence[str] = ("tenant_id", "lead_id")) -> DataFrame:
    """As-of join: for each (lead, asked_at) the newest log row not after it.

    Asks and log rows are merged into one run per lead and month, so a lead with a very
    long history is spread over its months; the last row of each month is carried into the
    next ones through a table with one row per lead and month. No pairs are made.
    """
    keys = list(keys)
    body = F.struct(F.col("created_at").alias("at"), "model_version", "probability")
    rows = log.select(*keys, F.col("created_at").alias("_at"), F.lit(0).alias("_ask"), body.alias("_row"))
    row_type = rows.schema["_row"].dataType
    both = asks.select(
        *keys, F.col("asked_at").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(row_type).alias("_row")
    ).unionByName(rows).withColumn("_month", F.date_trunc("month", "_at"))

    months = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_month").agg(F.max("_row").alias("_last")).select(
        *keys, "_month", F.last("_last", ignorenulls=True).over(months).alias("_carried"))
    run = Window.partitionBy(*keys, "_month").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_row", F.last("_row", ignorenulls=True).over(run)).where("_ask = 1")
    found = inside.join(carried, [*keys, "_month"], "left").withColumn("_row", F.coalesce("_row", "_carried"))
    return found.select(*keys, F.col("_at").alias("asked_at"),
                        F.col("_row.model_version").alias("model_version"),
                        F.col("_row.probability").alias("probability"))


def simulate(leads: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Score before and after overriding fields, side by side, without copying rows."""
    before, after = X.heuristic_score(), X.heuristic_score(dict(changes))
    return leads.withColumns({"_before": before, "_after": after}).withColumns({
        "before": round_to(F.col("_before"), 4), "after": round_to(F.col("_after"), 4),
        "delta": round_to(F.col("_after") - F.col("_before"), 4),
        "delta_points": round_to((F.col("_after") - F.col("_before")) * 100.0, 2),
        "verdict": X.what_if_verdict(F.col("_before"), F.col("_after")),
    }).drop("_before", "_after")


def auc_weights(metrics: DataFrame, by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Weights from how far each AUC is above 0.5; equal weights when none is.

    ``metrics`` has one row per model, a handful per group.
    """
    group = Window.partitionBy(*by)
    lift = F.greatest(F.col("roc_auc") - 0.5, F.lit(0.0))
    total = F.sum(lift).over(group)
    count = F.count(F.lit(1)).over(group)
    weight = F.when(total > 0, lift / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / count)
    return metrics.where(F.col(model) != S.ENSEMBLE_NAME).select(*by, model, weight.alias("weight"))


def model_history(models: DataFrame) -> DataFrame:
    """Versions of each tenant, newest first."""
    return models.select(
        "tenant_id", "version", "tier", "is_active", "training_rows",
        F.col("metrics")[S.ENSEMBLE_NAME]["roc_auc"].alias("roc_auc"), "promoted_reason", "created_at",
    ).orderBy("tenant_id", F.desc("created_at"), F.desc("version"))
