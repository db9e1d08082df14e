"""Training, calibration and promotion on Spark ML.

Features are assembled once by a fitted preprocessor; learners, calibrators and folds then run
on the assembled table. Of the data, only scalars per feature and the final blocks of a
calibrator reach the driver; calibrators score by Spark ML's own binary search.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import schema, settings as S
from leadlake.functions import scoring as X
from leadlake.functions.numbers import round_to
from leadlake.functions.text import field_label
from leadlake.operators import score as scoring
from leadlake.operators.clean import baseline_row, category_options, clean_frame, labelled_rows
from leadlake.operators.drift import feature_statistics
from leadlake.operators.isotonic import fit_isotonic
from leadlake.operators.leakage import detect_leakage
from leadlake.operators.metrics import model_metrics
from leadlake.operators.preprocess import Preprocessor
from leadlake.operators.ranks import global_rank
from leadlake.session import store


ROWS_PER_PARTITION = 100_000  # of feature vectors under cross validation; a cached row takes about a kilobyte
FEWEST_ROWS = 5_000  # below that a partition of vectors costs more to schedule than to learn from


class NotTrainable(RuntimeError):
    """The labelled data does not allow a model; the message says why."""


# ------------------------------------------------------------------ preparation


def label_sufficiency(df: DataFrame, label: str = "converted", by: Sequence[str] = ()) -> DataFrame:
    """Row and class counts per group, whether they suffice, and the reason if not."""
    y = F.col(label).cast("int")
    counts = df.where(y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(y == 1).alias("positives"),
        F.count_if(y == 0).alias("negatives"))
    text = lambda c: F.col(c).cast("string")
    few_rows = F.concat(
        F.lit(f"Need at least {S.MIN_TRAINING_ROWS} labelled leads to train; got "), text("rows"),
        F.lit(". The base model keeps scoring until then."))
    one_sided = F.concat(
        F.lit(f"Need at least {S.MIN_CLASS_ROWS} examples of each outcome; got "), text("positives"),
        F.lit(" converted and "), text("negatives"), F.lit(" not converted."))
    reason = F.when(F.col("rows") < S.MIN_TRAINING_ROWS, few_rows).when(
        F.least("positives", "negatives") < S.MIN_CLASS_ROWS, one_sided)
    return counts.withColumn("reason", reason).withColumn("sufficient", F.col("reason").isNull())


def stratified_split(df: DataFrame, label: str, id_column: str, by: Sequence[str] = (),
                     test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first test_share of each class in hash order.

    Same rows on every run and exact class shares, unlike a random split.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(id_column), F.lit(seed)))
    ranked = global_rank(hashed, ["_h", id_column], [*by, label])
    size = F.floor(F.col("rows") * F.lit(test_share) + F.lit(0.5))
    return ranked.withColumn("is_test", F.col("rank") <= size).drop("_h", "rank", "rows")


# ------------------------------------------------------------------ learners


def train_forest(trees: int = 300, depth: int = 12, min_leaf: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed)


def train_boosted_a(rounds: int = 350, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=5, stepSize=0.05,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)


def train_boosted_b(rounds: int = 350, seed: int = 42) -> GBTClassifier:
    """Up to 32 leaves a tree and at least 25 rows a leaf."""
    return GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=5, stepSize=0.05,
        minInstancesPerNode=25, seed=seed)


def default_learners(trees: int = 300, rounds: int = 350, depth: int = 12) -> dict[str, Any]:
    return {
        "random_forest": train_forest(trees, depth),
        "boosted_a": train_boosted_a(rounds),
        "boosted_b": train_boosted_b(rounds),
    }


def with_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = rows / (2 * rows of the class), from one two-row aggregate."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (2.0 * n))).otherwise(weight)
    return df.withColumn("weight", weight)


def _raw_score(df: DataFrame) -> Column:
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def calibrated(df: DataFrame, calibrator: IsotonicRegressionModel, score: str, out: str) -> DataFrame:
    """Adds ``out``: the calibrated ``score``; the fitted model looks each score up by binary search."""
    return calibrator.copy().setFeaturesCol(score).setPredictionCol(out).transform(df)


@dataclass
class Calibrated:
    """One learner: a fitted classifier and a calibrator per fold; the score is their mean.

    A fold has an isotonic calibrator, or None and an entry of ``sigmoid``.
    """

    name: str
    members: list[tuple[Any, IsotonicRegressionModel | None]] = field(default_factory=list)
    sigmoid: list[tuple[float, float]] | None = None

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Adds ``out`` to a frame that has ``features``."""
        kept = list(df.columns)
        parts = []
        for i, (model, calibrator) in enumerate(self.members):
            made = model.transform(df)
            raw, part = f"_{out}_raw", f"_{out}_{i}"
            df = made.withColumn(raw, _raw_score(made)).select(*kept, *parts, raw)
            if calibrator is None:
                slope, intercept = self.sigmoid[i]
                df = df.withColumn(part, 1.0 / (1.0 + F.exp(-(F.col(raw) * slope + intercept))))
            else:
                df = calibrated(df, calibrator, raw, part)
            df = df.drop(raw)
            parts.append(part)
        total = sum((F.col(p) for p in parts), F.lit(0.0))
        return df.withColumn(out, total / float(len(self.members))).drop(*parts)


def _folded(train: DataFrame, id_column: str, folds: int, seed: int) -> DataFrame:
    """Adds ``_fold``: each class is dealt over the folds in hash order, so every fold has its share."""
    hashed = train.withColumn("_h", F.xxhash64(F.col(id_column), F.lit(seed)))
    ranked = global_rank(hashed, ["_h", id_column], ["label"])
    return store(ranked.withColumn("_fold", F.pmod(F.col("rank"), F.lit(folds))).drop("_h", "rank", "rows"))


def isotonic_cv(name: str, learner: Any, train: DataFrame, id_column: str, folds: int, seed: int = 7, parallelism: int = 8) -> Calibrated:
    """k fits, each calibrated on its held-out fold; ``train`` has features, label, weight."""
    with _spread(_folded(train, id_column, folds, seed)) as parts:
        def member(k: int) -> tuple[Any, IsotonicRegressionModel]:
            model = learner.fit(parts.where(F.col("_fold") != k))
            held = model.transform(parts.where(F.col("_fold") == k))
            return model, fit_isotonic(held.select(_raw_score(held).alias("raw"), "label"))

        return Calibrated(name, _at_once(member, range(folds), parts, parallelism))


def calibration_folds(train: DataFrame) -> int:
    """The published number of folds for so many training rows."""
    return 5 if train.count() >= 2500 else 3


def platt_cv(name: str, learner: Any, train: DataFrame, id_column: str, folds: int, seed: int = 7) -> Calibrated:
    """As isotonic_cv with a sigmoid per fold."""
    out = Calibrated(name, sigmoid=[])
    parts = _folded(train, id_column, folds, seed)
    one = VectorAssembler(inputCols=["raw"], outputCol="raw_vector")
    for k in range(folds):
        model = learner.fit(parts.where(F.col("_fold") != k))
        held = model.transform(parts.where(F.col("_fold") == k))
        scored = one.transform(held.select(_raw_score(held).alias("raw"), "label"))
        curve = LogisticRegression(featuresCol="raw_vector", labelCol="label").fit(scored)
        out.members.append((model, None))
        out.sigmoid.append((float(curve.coefficients[0]), float(curve.intercept)))
    return out


@dataclass
class Ensemble:
    """A trained model: preprocessing, calibrated learners, weights and its metadata."""

    version: str
    tier: str
    preprocessor: Preprocessor
    learners: dict[str, Calibrated]
    weights: dict[str, float]
    features_used: list[str]
    training_rows: int = 0
    conversion_rate: float = 0.0
    calibrator: IsotonicRegressionModel | None = None
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, leads: DataFrame, components: bool = False) -> DataFrame:
        """Adds ``probability`` to leads with canonical columns, in one pass.

        The original columns come back untouched; cleaning only feeds the model.
        """
        body = leads.select(F.struct(*leads.columns).alias("_lead"), *leads.columns)
        clean = clean_frame(body, keep=["_lead"])
        made = self.preprocessor.apply(clean).select("_lead", "features")
        for name, learner in self.learners.items():
            made = learner.score(made, f"_p_{name}")
        parts = {name: F.col(f"_p_{name}") for name in self.learners}
        p = scoring.blend(parts, self.weights)
        made = made.withColumn("_p", p)
        if self.calibrator is not None:
            made = calibrated(made, self.calibrator, "_p", "_tuned").drop("_p").withColumnRenamed("_tuned", "_p")
        shown = [F.col(f"_p_{n}").alias(f"score_{n}") for n in self.learners] if components else []
        kept = [F.col(f"_lead.{c}").alias(c) for c in leads.columns if c != "probability"]
        return made.select(*kept, *shown, F.col("_p").alias("probability"))

    def save(self, path: str) -> None:
        """Everything ``load`` needs, under ``path``: Spark ML folders, tables, and one row of metadata."""
        spark = SparkSession.active()
        preprocess = self.preprocessor.save(f"{path}/preprocess")
        for name, learner in self.learners.items():
            for i, (model, calibrator) in enumerate(learner.members):
                PipelineModel([model]).write().overwrite().save(f"{path}/{name}-{i}")
                if calibrator is not None:
                    calibrator.write().overwrite().save(f"{path}/{name}-{i}-calibrator")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        facts = {
            "version": self.version, "tier": self.tier, "weights": self.weights, "features_used": self.features_used,
            "training_rows": self.training_rows, "conversion_rate": self.conversion_rate, "metrics": self.metrics,
            "preprocess": preprocess, "tables": sorted(self.tables), "calibrated": self.calibrator is not None,
            "learners": {n: {"members": len(x.members), "sigmoid": x.sigmoid} for n, x in self.learners.items()},
        }
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        """The model that ``save`` wrote; it scores alike."""
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        prep = Preprocessor.load(spark, f"{path}/preprocess", facts["preprocess"])
        learners = {}
        for name, made in facts["learners"].items():
            sigmoid = made["sigmoid"] and [tuple(x) for x in made["sigmoid"]]
            members = [(PipelineModel.load(f"{path}/{name}-{i}").stages[0],
                        None if sigmoid else IsotonicRegressionModel.load(f"{path}/{name}-{i}-calibrator"))
                       for i in range(made["members"])]
            learners[name] = Calibrated(name, members, sigmoid)
        return Ensemble(
            facts["version"], facts["tier"], prep, learners, facts["weights"], facts["features_used"], facts["training_rows"],
            facts["conversion_rate"], IsotonicRegressionModel.load(f"{path}/calibrator") if facts["calibrated"] else None,
            facts["metrics"], {n: spark.read.parquet(f"{path}/tables/{n}") for n in facts["tables"]})


def train_model(rows: DataFrame, version: str, tier: str = "tenant", id_column: str = "external_id",
                label: str = "converted", overrides: Sequence[str] = (), check_leakage: bool = True,
                learners: Mapping[str, Any] | None = None, folds: int | None = None) -> Ensemble:
    """Label coercion, leakage gate, split, calibrated fits, weights and metadata.

    Quarantined features are left out of the model, not only reported. The tables ``metrics``,
    ``weights``, ``split``, ``baseline``, ``category_options``, ``statistics`` (the reference of
    drift checks) and, with a leakage check, ``findings`` come with the result.
    """
    clean = store(clean_frame(labelled_rows(rows, label), keep=[id_column, label]))  # the leakage gate and the tables read it many times
    enough = label_sufficiency(clean, label).first()
    if not enough["sufficient"]:
        raise NotTrainable(enough["reason"])
    candidates = [c for c in schema.FEATURES if c in rows.columns]
    findings = None
    blocked: set[str] = set()
    if check_leakage:
        findings = store(detect_leakage(clean, candidates, label))
        flagged = findings.where("quarantined").select("feature").collect()  # 25 at most
        blocked = {r["feature"] for r in flagged} - set(overrides)
    used = [c for c in candidates if c not in blocked]
    if not used:
        raise NotTrainable("No feature is left to train on: all of them look like leaks of the label. "
                           "Pass the ones you trust as overrides.")

    split = store(stratified_split(clean.withColumn("label", F.col(label).cast("double")), label, id_column))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    prep = Preprocessor([c for c in used if c in schema.NUMERIC_FEATURES],
                        [c for c in used if c in schema.CATEGORICAL_FEATURES]).fit(train)
    ready = store(with_balance(prep.apply(train).select(id_column, "label", "features")))
    if folds is None:
        folds = calibration_folds(ready)
    fitted = {
        name: isotonic_cv(name, learner, ready, id_column, folds)
        for name, learner in (learners or default_learners()).items()
    }

    held = prep.apply(test).select(id_column, "label", "features")
    for name, model in fitted.items():
        held = model.score(held, name)
    held = store(held.drop("features"))
    pairs = held.select("label", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(n).alias("p")) for n in fitted])))
    single = store(model_metrics(pairs, "p", "label", ["model"]))
    weighed = store(scoring.auc_weights(single))
    weights = {r["model"]: r["weight"] for r in weighed.collect()}
    blended = held.select("label", F.lit(S.ENSEMBLE_NAME).alias("model"),
                          scoring.blend({n: F.col(n) for n in fitted}, weights).alias("p"))
    metrics = store(single.unionByName(model_metrics(blended, "p", "label", ["model"])))
    per_model = {r["model"]: {k: r[k] for k in r.asDict() if k != "model"} for r in metrics.collect()}
    total = clean.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")).first()
    numeric, categorical = prep.numeric, prep.categorical
    tables = {
        "metrics": metrics, "split": split, "weights": weighed,
        "baseline": store(baseline_row(clean, numeric=numeric, categorical=categorical)),
        "statistics": store(feature_statistics(clean, (), numeric, categorical)),
    }
    if categorical:
        tables["category_options"] = store(category_options(clean, categorical))
    if findings is not None:
        tables["findings"] = findings
    return Ensemble(version, tier, prep, fitted, weights, used, total["n"], total["rate"], None, per_model, tables)


def recalibrate(base: Ensemble, labelled: DataFrame, version: str, label: str = "converted") -> Ensemble:
    """Tier 1: the base ranking with probabilities fitted to this tenant (in-sample metrics)."""
    scored = store(base.score(labelled_rows(labelled, label)).select("probability", label))
    classes = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"),
                         F.count_distinct(label).alias("classes")).first()
    if classes["n"] < 1:
        raise NotTrainable("Need at least 1 labelled lead(s) to recalibrate.")
    if classes["classes"] < 2:
        raise NotTrainable("Recalibration needs both converted and non-converted examples.")
    calibrator = fit_isotonic(scored, "probability", label)
    after = calibrated(scored, calibrator, "probability", "_tuned").select(label, F.inline(F.array(
        F.struct(F.lit("base_model").alias("model"), F.col("probability").alias("p")),
        F.struct(F.lit(S.ENSEMBLE_NAME).alias("model"), F.col("_tuned").alias("p")))))
    metrics = store(model_metrics(after, "p", label, ["model"]))
    per_model = {r["model"]: {k: r[k] for k in r.asDict() if k != "model"} for r in metrics.collect()}
    return Ensemble(version, "recalibrated", base.preprocessor, base.learners, base.weights,
                    base.features_used, classes["n"], classes["rate"], calibrator, per_model,
                    {**base.tables, "metrics": metrics})


def recalibrated_scores(scored: DataFrame, calibrators: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Apply a calibrator per tenant, held as two arrays in a small stored table.

    Tenants that only differ by calibration share one model pass.
    """
    joined = scored.join(calibrators.select(*by, "boundaries", "predictions"), list(by), "left")
    fitted = scoring.interpolate_arrays(F.col("probability"), F.col("boundaries"), F.col("predictions"))
    return joined.withColumn("probability", F.coalesce(fitted, F.col("probability"))).drop("boundaries", "predictions")


# ------------------------------------------------------------------ promotion


def should_promote(pairs: DataFrame, margin: float = S.PROMOTION_MARGIN) -> DataFrame:
    """Adds ``promote`` and ``reason`` to (challenger_auc, has_champion, champion_auc) rows."""
    new, old = F.col("challenger_auc"), F.col("champion_auc")
    show = lambda c: F.format_string("%.4f", round_to(c, 4))
    wins = new >= old + margin
    case = (
        F.when(new.isNull(), F.lit("challenger produced no ensemble metric"))
        .when(~F.col("has_champion"), F.concat(F.lit("first model for this tenant (AUC "), show(new), F.lit(")")))
        .when(old.isNull(), F.concat(F.lit("incumbent has no recorded AUC (challenger "), show(new), F.lit(")")))
        .when(wins, F.concat(F.lit("challenger AUC "), show(new), F.lit(" beats champion "), show(old),
                             F.lit(f" by at least {margin:.3f}")))
        .otherwise(F.concat(F.lit("challenger AUC "), show(new), F.lit(" did not beat champion "), show(old),
                            F.lit(f" by the required {margin:.3f}; keeping the incumbent")))
    )
    promote = new.isNotNull() & (~F.col("has_champion") | old.isNull() | wins)
    return pairs.withColumns({"promote": F.coalesce(promote, F.lit(False)), "reason": case})


def promote(models: DataFrame, challengers: DataFrame, margin: float = S.PROMOTION_MARGIN) -> DataFrame:
    """The model table after judging one challenger per tenant against its champion.

    Both have tenant_id, version, tier, roc_auc, conversion_rate, training_rows,
    created_at; ``models`` also is_active and promoted_reason.
    """
    champion = models.where("is_active").groupBy("tenant_id").agg(
        F.max(F.struct("created_at", "version", "roc_auc")).alias("_c")).select(
        "tenant_id", F.col("_c.version").alias("champion_version"), F.col("_c.roc_auc").alias("champion_auc"))
    judged = should_promote(
        challengers.join(champion, "tenant_id", "left").withColumns({
            "has_champion": F.col("champion_version").isNotNull(), "challenger_auc": F.col("roc_auc")}), margin)
    added = judged.select(*challengers.columns, F.col("promote").alias("is_active"),
                          F.col("reason").alias("promoted_reason"))
    retired = judged.where("promote").select("tenant_id", F.col("champion_version").alias("version"),
                                             F.lit(True).alias("_retired"))
    kept = models.join(retired, ["tenant_id", "version"], "left").withColumn(
        "is_active", F.col("is_active") & F.col("_retired").isNull()).select(*models.columns)
    return kept.unionByName(added)


# ------------------------------------------------------------------ explanation


def ablation_grid(leads: DataFrame, baseline: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per lead and field whose value differs from the baseline.

    Adds ``field``, ``value``, ``baseline`` (text). Equal fields make no row, and callers
    filter to the leads they explain first.
    """
    packed = baseline.select(*by, F.struct(*fields).alias("_base"))
    if by:
        joined = leads.join(packed, list(by))
    else:
        joined = leads.withColumn("_base", packed.select("_base").scalar())
    cells = []
    for name in fields:
        actual, typical = F.col(name), F.col(f"_base.{name}")
        if name in schema.NUMERIC_FEATURES:
            filled = F.coalesce(actual, typical)
            differs = F.abs(filled - typical) >= 1e-9
        else:
            filled = F.coalesce(F.when(F.trim(actual) != "", actual), typical)
            differs = filled != typical
        cells.append(F.when(differs, F.struct(
            F.lit(name).alias("field"), filled.cast("string").alias("value"),
            typical.cast("string").alias("baseline"))))
    rows = joined.select(*leads.columns, "_base", F.explode(F.array_compact(F.array(*cells))).alias("_cell"))
    return rows.select(*leads.columns, "_base", "_cell.*")


def _impacts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed impacts from ``before`` and ``after``; differences below 0.001 are dropped."""
    delta = F.col("before") - F.col("after")
    # coalesce: from a bare comparison Catalyst infers that both scores are not null, and evaluates the models for that
    # in a filter below the join, many times a row.
    return rows.where(F.coalesce(F.abs(delta) >= 0.001, F.lit(False))).select(
        *keys, field_label(F.col("field")).alias("feature"), "field", "value", "baseline",
        round_to(delta, 4).alias("impact"), F.when(delta > 0, "increases").otherwise("decreases").alias("direction"),
    )


def explain_heuristic(leads: DataFrame, baseline: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Field impacts on the heuristic score; each counterfactual is an expression."""
    fields = [name for name, _, _ in S.HEURISTIC_TERMS]
    grid = ablation_grid(leads, baseline, fields, by)
    resolved = {f: F.coalesce(F.col(f), F.col(f"_base.{f}")) for f in fields}
    reset = {f: F.when(F.col("field") == f, F.col(f"_base.{f}")).otherwise(resolved[f]) for f in fields}
    scored = grid.withColumns({"before": X.heuristic_score(resolved), "after": X.heuristic_score(reset)})
    return _impacts(scored, keys)


def explain_ablation(leads: DataFrame, model: Ensemble, baseline: DataFrame, keys: Sequence[str],
                     by: Sequence[str] = ()) -> DataFrame:
    """Field impacts on a trained model: one batch pass over all counterfactual rows.

    Both sides of each difference are calibrated alike.
    """
    fields = list(schema.FEATURES)
    inputs = clean_frame(leads, keep=[*keys, *[b for b in by if b not in keys]])
    grid = ablation_grid(inputs, baseline, fields, by)
    columns = {}
    for f in fields:
        columns[f] = F.when(F.col("field") == f, F.col(f"_base.{f}")).otherwise(F.coalesce(F.col(f), F.col(f"_base.{f}")))
    carried = [*keys, "field", "value", "baseline"]
    after = model.score(grid.select(*carried, *[c.alias(f) for f, c in columns.items()])).select(
        *carried, F.col("probability").alias("after"))
    packed = baseline.select(*by, F.struct(*fields).alias("_base"))
    whole = inputs.join(packed, list(by)) if by else inputs.withColumn("_base", packed.select("_base").scalar())
    before = model.score(whole.select(*keys, *[F.coalesce(F.col(f), F.col(f"_base.{f}")).alias(f) for f in fields])
                         ).select(*keys, F.col("probability").alias("before"))
    return _impacts(after.join(before, list(keys)), keys)


def top_contributions(impacts: DataFrame, keys: Sequence[str], n: int = 6) -> DataFrame:
    """The n largest absolute impacts of each lead, ranked (a lead has at most 25 rows)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("impact")), F.asc("field"))
    ranked = impacts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def explain_summary(scored: DataFrame, contributions: DataFrame, keys: Sequence[str], heuristic: bool = False) -> DataFrame:
    """One sentence per lead from its probability and top three contributions."""
    p = F.format_string("%.1f", round_to(F.col("probability") * 100.0, 1))
    if heuristic:
        text = F.concat(F.lit(S.SUMMARY_HEURISTIC[0]), p, F.lit(S.SUMMARY_HEURISTIC[1]))
        return scored.select(*keys, text.alias("summary"))
    points = F.format_string("%.1f", round_to(F.abs("impact") * 100.0, 1))
    line = F.concat(F.col("feature"), F.lit(" ("), F.col("value"), F.lit(") "),
                    F.when(F.col("impact") > 0, "raising").otherwise("lowering"), F.lit(" it by "), points, F.lit(" points"))
    drivers = contributions.where(F.col("rank") <= 3).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("_l"))
    headline = F.when(
        F.col("probability") >= S.DECISION_THRESHOLD,
        F.concat(F.lit(S.SUMMARY_OPENING), p, F.lit(S.SUMMARY_ABOVE)),
    ).otherwise(F.concat(F.lit(S.SUMMARY_OPENING), p, F.lit(S.SUMMARY_BELOW)))
    joined = scored.join(drivers, list(keys), "left")
    tail = F.when(
        F.col("_l").isNull(),
        F.lit(S.SUMMARY_NO_FACTOR),
    ).otherwise(F.concat(F.lit(S.SUMMARY_FACTORS),
                         F.array_join(F.transform("_l", lambda e: e["t"]), "; "), F.lit(".")))
    return joined.select(*keys, F.concat(headline, tail).alias("summary"))


# ------------------------------------------------------------------ model selection


def comparison_learners(features: int, iterations: int = 100) -> dict[str, Any]:
    """The classifiers Spark has of those usually compared on this problem, with as many trees, rounds, steps and hidden units as there."""
    common = {"labelCol": "label", "featuresCol": "features"}
    return {
        "RandomForest": RandomForestClassifier(numTrees=iterations, maxDepth=8, seed=42, **common),
        "GradientBoosting": GBTClassifier(maxIter=iterations, maxDepth=3, seed=42, **common),
        "DecisionTree": DecisionTreeClassifier(maxDepth=8, seed=42, **common),
        "Logistic": LogisticRegression(maxIter=iterations, **common),
        "MLPClassifier": MultilayerPerceptronClassifier(layers=[features, 100, 2], maxIter=2 * iterations, seed=42, **common),
        "NaiveBayes": NaiveBayes(modelType="gaussian", **common),
        "SVM": LinearSVC(maxIter=iterations, **common),
    }


@contextmanager
def _spread(ready: DataFrame, most: int = ROWS_PER_PARTITION) -> Iterator[DataFrame]:
    """``ready`` with at most about ``most`` rows a partition, kept on the executors' disks inside the block.

    Files of sparse vectors are small, so a file split holds millions of them, and the cross validator caches each
    partition many times its file's size and reads it whole in a task. A table that fits stays as it is.
    """
    parts = -(-ready.count() // most)
    if parts <= ready.rdd.getNumPartitions():
        yield ready
        return
    dealt = ready.repartition(parts).persist(StorageLevel.DISK_ONLY)
    try:
        yield dealt
    finally:
        dealt.unpersist()


def _at_once(fit: Callable[[Any], Any], tasks: Sequence[Any], data: DataFrame, parallelism: int) -> list[Any]:
    """``fit`` of every task, in their order. Up to ``parallelism`` run at a time while ``data`` has so few partitions that one leaves cores idle."""
    spark = data.sparkSession
    some = min(parallelism, 2 * spark.sparkContext.defaultParallelism // max(1, data.rdd.getNumPartitions()))
    with ThreadPoolExecutor(max(1, some)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), tasks))


@contextmanager
def _dealt(ready: DataFrame, folds: int, seed: int, fewest: int = FEWEST_ROWS) -> Iterator[DataFrame]:
    """``ready`` with ``_fold``, kept on the executors' disks inside the block; a small table is spread over half of the cores, as several fits run."""
    rows, half = ready.count(), -(-ready.sparkSession.sparkContext.defaultParallelism // 2)
    parts = max(-(-rows // ROWS_PER_PARTITION), min(half, rows // fewest))
    spread = ready.repartition(parts) if parts > ready.rdd.getNumPartitions() else ready
    dealt = spread.withColumn("_fold", F.floor(F.rand(seed) * folds)).persist(StorageLevel.DISK_ONLY)
    try:
        yield dealt
    finally:
        dealt.unpersist()


def cross_validate_models(ready: DataFrame, learners: Mapping[str, Any], folds: int = 10,
                          parallelism: int = 8) -> DataFrame:
    """Mean held-out accuracy of each learner; folds and learners as Spark ML jobs."""
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    with _dealt(ready, folds, seed=42) as data:
        def held_out(task: tuple[str, int]) -> float:
            name, k = task
            model = learners[name].fit(data.where(F.col("_fold") != k))
            return float(judge.evaluate(model.transform(data.where(F.col("_fold") == k))))

        found = _at_once(held_out, [(name, k) for name in learners for k in range(folds)], data, parallelism)
    rows = [(name, sum(found[i * folds:(i + 1) * folds]) / folds) for i, name in enumerate(learners)]
    return ready.sparkSession.createDataFrame(rows, "model string, accuracy double").orderBy(
        F.desc("accuracy"), "model")


def random_search(ready: DataFrame, learner: Any, space: Mapping[str, Sequence[Any]], tries: int = 10,
                  folds: int = 10, seed: int = 42, parallelism: int = 4) -> tuple[DataFrame, CrossValidatorModel]:
    """Cross-validated accuracy of ``tries`` settings drawn without repeats from the grid."""
    grid = ParamGridBuilder()
    for name, values in space.items():
        grid = grid.addGrid(learner.getParam(name), list(values))
    everything = grid.build()
    drawn = random.Random(seed).sample(everything, min(tries, len(everything)))
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    with _spread(ready) as data:
        found = CrossValidator(estimator=learner, estimatorParamMaps=drawn, evaluator=judge, numFolds=folds,
                               parallelism=parallelism, seed=seed).fit(data)
    rows = [
        (str({p.name: v for p, v in sorted(params.items(), key=lambda kv: kv[0].name)}), float(metric))
        for params, metric in zip(drawn, found.avgMetrics)
    ]
    table = ready.sparkSession.createDataFrame(rows, "settings string, accuracy double")
    return table.orderBy(F.desc("accuracy"), "settings"), found


