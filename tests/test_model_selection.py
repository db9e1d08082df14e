"""Model selection runs whole: the published folds and learners, and every row in one fold."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from leadlake.operators import train as TR
from leadlake.plans import modelling as MO
from leadlake.session import store


def vectors(spark, n):
    rng = np.random.default_rng(5)
    data = [(i, [float(a), float(b)], float(rng.random() < (0.8 if a > 0 else 0.2))) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    made = spark.createDataFrame(data, "lead_key long, x array<double>, label double")
    return store(made.select("lead_key", array_to_vector("x").alias("features"), "label").coalesce(1))


def test_comparison_has_the_published_folds_and_learners(spark, monkeypatch):
    class Prepared:
        width = 7

    given = {}

    def seen(ready, learners, folds=10):
        given.update(ready=ready, learners=learners, folds=folds)

    monkeypatch.setattr(MO, "_prepared", lambda *of: (Prepared, "rows"))
    monkeypatch.setattr(TR, "cross_validate_models", seen)
    MO.cross_validate_models(spark, "nowhere")
    learners = given["learners"]
    assert given["ready"] == "rows" and given["folds"] == 10 and len(learners) == 7
    assert learners["RandomForest"].getNumTrees() == 100
    assert [learners[n].getMaxIter() for n in ("GradientBoosting", "Logistic", "SVM", "MLPClassifier")] == [100, 100, 100, 200]
    assert learners["MLPClassifier"].getLayers() == [7, 100, 2]


@pytest.mark.parametrize("parallelism", [1, 4])
def test_accuracies_are_those_of_the_cross_validator(spark, parallelism):
    rows = vectors(spark, 600)
    learners = {"tree": DecisionTreeClassifier(maxDepth=3, seed=1), "line": LogisticRegression(maxIter=10)}
    found = {r["model"]: r["accuracy"] for r in TR.cross_validate_models(rows, learners, 4, parallelism).collect()}
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    for name, learner in learners.items():
        cv = CrossValidator(estimator=learner, estimatorParamMaps=[{}], evaluator=judge, numFolds=4, seed=42)
        assert found[name] == pytest.approx(cv.fit(rows).avgMetrics[0], abs=1e-12)


def test_small_tables_are_spread(spark):
    rows = vectors(spark, 800)
    with TR._dealt(rows, 4, seed=42, fewest=100) as data:
        assert data.rdd.getNumPartitions() == min(8, -(-spark.sparkContext.defaultParallelism // 2))
        folds = data.groupBy("_fold").agg(F.count("*").alias("n"), F.count_distinct("lead_key").alias("d")).collect()
        assert sorted(r["_fold"] for r in folds) == [0, 1, 2, 3] and sum(r["n"] for r in folds) == sum(r["d"] for r in folds) == 800
    with TR._dealt(rows, 4, seed=42) as data:
        assert data.rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_a_failing_learner_is_not_hidden(spark):
    class Broken:
        def fit(self, rows):
            raise ValueError("no fit")

    with pytest.raises(ValueError, match="no fit"):
        TR.cross_validate_models(vectors(spark, 50), {"broken": Broken()}, 2)


@pytest.mark.parametrize("rows, folds", [(3200, 5), (900, 3)])
def test_isotonic_query_has_the_published_forest_and_folds(spark, monkeypatch, rows, folds):
    class Asked(Exception):
        pass

    def seen(name, learner, train, id_column, folds):
        forest = learner.getNumTrees(), learner.getMaxDepth(), learner.getMinInstancesPerNode()
        raise Asked(name, forest, train.count(), id_column, folds)

    monkeypatch.setattr(MO, "ready", lambda *of: vectors(spark, rows))
    monkeypatch.setattr(TR, "isotonic_cv", seen)
    with pytest.raises(Asked) as asked:
        MO.isotonic_cv(spark, "nowhere")
    assert asked.value.args == ("random_forest", (300, 12, 8), rows * 4 // 5, "lead_key", folds)


def test_folds_fitted_at_once_keep_their_order(spark):
    rows = vectors(spark, 600)
    learner = DecisionTreeClassifier(maxDepth=3, seed=1)
    scores = []
    for parallelism in (1, 8):
        made = TR.isotonic_cv("tree", learner, rows, "lead_key", 3, parallelism=parallelism)
        scores.append({r["lead_key"]: r["p"] for r in made.score(rows, "p").collect()})
        fold = TR._folded(rows, "lead_key", 3, 7)
        for k, (model, _) in enumerate(made.members):
            assert model.toDebugString.split("\n", 1)[1] == learner.fit(fold.where(F.col("_fold") != k)).toDebugString.split("\n", 1)[1]
    assert scores[0] == scores[1] and len(scores[0]) == 600
