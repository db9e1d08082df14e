"""Classification metrics from (score, label) rows, per group and exact.

Rows collapse to one row per distinct score before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import settings as S
from leadlake.functions.numbers import bin_by_edges, even_edges, ratio, round_to
from leadlake.operators.ranks import BUCKETS, running_totals
from leadlake.session import store


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its positive and negative count."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("int")
    return known.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")
    )


def cumulative_gain(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                    buckets: int = BUCKETS) -> DataFrame:
    """Per distinct score, best first: counts, ``tp`` and ``fp`` at that cut-off, totals.

    The distinct scores are stored once: finding the cuts, the bucket totals and the
    running counts all read them.
    """
    return cumulate(store(score_counts(df, score, label, by)), by, buckets)


def cumulate(counts: DataFrame, by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Running counts over (by, score, pos, neg) rows, best score first."""
    placed = running_totals(counts, ["-score"], ["pos", "neg"], by, buckets)
    return placed.select(
        *by, "score", "pos", "neg",
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_total").alias("positives"), F.col("neg_total").alias("negatives"),
    )


def exact_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
              buckets: int = BUCKETS) -> DataFrame:
    """Rank AUC with ties counted half; null unless both classes are present."""
    return auc_from_gain(cumulative_gain(df, score, label, by, buckets), by)


def auc_from_gain(gain: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return gain.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), _auc().alias("roc_auc")
    )


def _auc() -> Column:
    """Aggregate over cumulative_gain rows.

    A positive beats every negative with a lower score and half of those that tie. The
    pair count outgrows a BIGINT long before the data does, hence decimals.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    beaten = (F.col("negatives") - F.col("fp")) * 2 + F.col("neg")
    won = F.sum(exact(F.col("pos")) * exact(beaten)).cast("double") / 2.0
    return ratio(won, F.sum("pos").cast("double") * F.sum("neg"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                      buckets: int = BUCKETS) -> DataFrame:
    """Sum over cut-offs of (recall step) x (precision); no interpolation."""
    gain = cumulative_gain(df, score, label, by, buckets)
    step = ratio(F.col("pos"), F.col("positives"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return gain.groupBy(*by).agg(F.sum(step * precision).alias("average_precision"))


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
              buckets: int = BUCKETS) -> DataFrame:
    return cumulative_gain(df, score, label, by, buckets).select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
             buckets: int = BUCKETS) -> DataFrame:
    return cumulative_gain(df, score, label, by, buckets).select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def _counts(y: Column, yhat: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & (yhat == 1)).alias("tp"),
        F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"),
        F.count_if((y == 0) & (yhat == 0)).alias("tn"),
    ]


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def classification_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                           threshold: float = S.DECISION_THRESHOLD) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined) and the Brier score."""
    y, p = F.col(label).cast("int"), F.col(score)
    counted = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *_counts(y, F.when(p >= threshold, 1).otherwise(0)),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    return _basics(counted, by)


def _hits(above: Column) -> list[Column]:
    """As ``_counts``, from rows with pos and zero counts on one side of the threshold."""
    return [
        F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name)
        for name, side, c in (("tp", above, "pos"), ("fp", above, "zero"), ("fn", ~above, "pos"), ("tn", ~above, "zero"))
    ]


def _basics(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *by, "rows",
        ratio(tp + tn, F.col("rows")).alias("accuracy"),
        _or_zero(ratio(tp, tp + fp)).alias("precision"),
        _or_zero(ratio(tp, tp + fn)).alias("recall"),
        _or_zero(ratio(tp * 2, tp * 2 + fp + fn)).alias("f1"),
        "brier",
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(
        *by, F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows '0', '1', 'macro avg', 'weighted avg' with precision, recall, f1, support,
    and the accuracy and error of the group on every row."""
    y, yhat = F.col(label).cast("int"), F.col(predicted).cast("int")
    counts = df.groupBy(*by).agg(*_counts(y, yhat))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def row(name: str, hit: Column, false_hit: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            _or_zero(ratio(hit, hit + false_hit)).alias("precision"),
            _or_zero(ratio(hit, hit + missed)).alias("recall"),
            _or_zero(ratio(hit * 2, hit * 2 + false_hit + missed)).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = counts.withColumn("_zero", row("0", tn, fn, fp)).withColumn("_one", row("1", tp, fp, fn))

    def mean(name: str, zero_weight: Column, one_weight: Column) -> Column:
        total = zero_weight + one_weight
        part = lambda m: (F.col(f"_zero.{m}") * zero_weight + F.col(f"_one.{m}") * one_weight) / total
        return F.struct(
            F.lit(name).alias("label"), part("precision").alias("precision"),
            part("recall").alias("recall"), part("f1").alias("f1"),
            (F.col("_zero.support") + F.col("_one.support")).alias("support"),
        )

    one = F.lit(1.0)
    accuracy = ratio(tp + tn, tp + tn + fp + fn)
    return classes.select(
        *by, accuracy.alias("accuracy"), (F.lit(1.0) - accuracy).alias("error"),
        F.inline(F.array(
            F.col("_zero"), F.col("_one"), mean("macro avg", one, one),
            mean("weighted avg", F.col("_zero.support").cast("double"),
                 F.col("_one.support").cast("double")),
        )),
    )


def class_balance(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted count per class, and the accuracy of guessing the larger class."""
    sides = df.select(
        *by, F.inline(F.array(
            F.struct(F.col(label).cast("int").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("predicted")),
            F.struct(F.col(predicted).cast("int").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("predicted")),
        )),
    )
    counts = sides.groupBy(*by, "class").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )
    group = Window.partitionBy(*by)  # two rows a group
    return counts.withColumn(
        "majority_accuracy", ratio(F.max("actual").over(group), F.sum("actual").over(group))
    )


def reliability_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                      bins: int = 5) -> DataFrame:
    """Mean score and observed rate per even bin; empty bins are absent."""
    edges = even_edges(bins)
    p, y = F.col(score), F.col(label).cast("int")
    binned = df.where(p.isNotNull() & y.isNotNull()).withColumn("bin", bin_by_edges(p, edges))
    return binned.where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"),
        ratio(F.sum(y), F.count(F.lit(1))).alias("observed_rate"),
    )


def calibration_bins(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                     bins: int = 10) -> DataFrame:
    edges = even_edges(bins)
    curve = reliability_curve(df, score, label, by, bins)
    low = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin"))
    high = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return curve.select(
        *by, "bin", round_to(low, 2).alias("bin_low"), round_to(high, 2).alias("bin_high"), "n",
        "mean_predicted", "observed_rate",
        (F.col("observed_rate") - F.col("mean_predicted")).alias("gap"),
    )


def calibration_report(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                       bins: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """Status, expected calibration error, Brier, AUC and the two rates per group.

    Groups with one class get ``insufficient_data`` and no numbers.
    """
    per_bin = calibration_bins(df, score, label, by, bins)
    gap = F.abs(F.col("gap")) * F.col("n")
    ece = per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("_ece"))
    p, y = F.col(score), F.col(label).cast("int")
    basics = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum(y).alias("_pos"),
        F.avg((p - y) * (p - y)).alias("_brier"), F.avg(p).alias("_mean"),
    )
    auc = exact_auc(df, score, label, by, buckets).select(*by, F.col("roc_auc").alias("_auc"))
    keys = list(by)
    if not keys:
        keys = ["_all"]
        ece, basics, auc = (t.withColumn("_all", F.lit(1)) for t in (ece, basics, auc))
    # One row per group on every side.
    joined = basics.join(ece, keys, "left").join(auc, keys, "left")
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("sample_size"))
    status = (
        F.when(~both, "insufficient_data").when(F.col("_ece") <= S.ECE_OK, "ok")
        .when(F.col("_ece") <= S.ECE_WARN, "warn").otherwise("alert")
    )
    shown = lambda c: F.when(both, round_to(c, 4))
    return joined.select(
        *by, status.alias("status"), "sample_size",
        shown(F.col("_ece")).alias("expected_calibration_error"),
        shown(F.col("_brier")).alias("brier"), shown(F.col("_auc")).alias("roc_auc"),
        shown(ratio(F.col("_pos"), F.col("sample_size"))).alias("observed_rate"),
        shown(F.col("_mean")).alias("mean_predicted"),
    )


def model_metrics(df: DataFrame, score: str, label: str, by: Sequence[str],
                  buckets: int = BUCKETS) -> DataFrame:
    """The seven holdout metrics per group (one group per model).

    One pass over the rows: the distinct scores are stored with the counts and errors that all metrics need.
    """
    y, p = F.col(label).cast("int"), F.col(score)
    counts = store(df.where(p.isNotNull() & y.isNotNull()).groupBy(*by, p.alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"), F.count_if(y == 0).alias("zero"),
        F.sum((p - y) * (p - y)).alias("error")))
    gain = cumulate(counts.select(*by, "score", "pos", "neg"), by, buckets)
    step = ratio(F.col("pos"), F.col("positives"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    curve = gain.groupBy(*by).agg(
        F.sum(step * precision).alias("pr_auc"), _auc().alias("roc_auc"),
    )
    basics = _basics(counts.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), *_hits(F.col("score") >= S.DECISION_THRESHOLD),
        (F.sum("error") / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
    ), by)
    return basics.join(curve, list(by), "left").select(
        *by, "accuracy", "roc_auc", "pr_auc", "precision", "recall", "f1", "brier"
    )


def model_comparison(df: DataFrame, score: str, label: str, model: str = "model",
                     buckets: int = BUCKETS) -> DataFrame:
    """One row per model, best accuracy first, then best mean of accuracy, F1 and AUC."""
    m = model_metrics(df, score, label, [model], buckets)
    efficiency = (F.col("accuracy") + F.col("f1") + F.col("roc_auc")) / 3.0
    shown = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return m.select(
        model, *[round_to(F.col(c), 4).alias(c) for c in shown],
        round_to(efficiency, 4).alias("predictive_efficiency"),
    ).orderBy(F.desc("accuracy"), F.desc("predictive_efficiency"), F.col(model))


def simplex_weights(parts: int = 10) -> list[tuple[float, float, float]]:
    """Every triple of multiples of 1/parts that sums to 1, in grid order."""
    return [
        (a / parts, b / parts, (parts - a - b) / parts)
        for a in range(parts + 1) for b in range(parts + 1 - a)
    ]


def _blend_at(scores: Sequence[str], weights: tuple[float, float, float]) -> Column:
    a, b, c = (F.col(s) * w for s, w in zip(scores, weights, strict=True))
    return a + b + c


def weight_grid(df: DataFrame, scores: Sequence[str], label: str, parts: int = 10,
                only: Sequence[int] | None = None) -> DataFrame:
    """accuracy, f1 and AUC of every weighting of three scores on a simplex grid.

    The grid is a fixed list of literals exploded per row, not a join; ``only`` names the
    grid points to look at.
    """
    grid = simplex_weights(parts)
    blends = F.array(*[
        F.struct(F.lit(i).alias("weight_id"), _blend_at(scores, grid[i]).alias("p"))
        for i in (range(len(grid)) if only is None else only)
    ])
    rows = df.select(F.col(label).cast("int").alias("y"), F.inline(blends))
    metrics = model_metrics(rows, "p", "y", ["weight_id"])
    pick = lambda k: F.get(F.array(*[F.lit(w[k]) for w in grid]), F.col("weight_id"))
    return metrics.select(
        "weight_id", pick(0).alias("w_first"), pick(1).alias("w_second"), pick(2).alias("w_third"),
        "accuracy", "f1", "roc_auc",
    )


def weight_grid_search(df: DataFrame, scores: Sequence[str], label: str, parts: int = 10) -> DataFrame:
    """The best weighting by (accuracy, f1, AUC); the earlier grid point wins a tie.

    One aggregate counts the hits of every grid point; only those that tie on accuracy and
    F1 need the order of their rows for an AUC.
    """
    y = F.col(label).cast("int")
    counts = []
    for i, weights in enumerate(simplex_weights(parts)):
        p = _blend_at(scores, weights)
        yhat = F.when(p >= S.DECISION_THRESHOLD, 1).when(p.isNotNull(), 0)
        counts += [hit.alias(f"{name}_{i}") for name, hit in zip(("tp", "fp", "fn", "tn"), _counts(y, yhat), strict=True)]
    row = df.agg(*counts).first()

    def merit(i: int) -> tuple[float, float]:
        tp, fp, fn, tn = (row[f"{n}_{i}"] or 0 for n in ("tp", "fp", "fn", "tn"))
        return (tp + tn) / max(1, tp + fp + fn + tn), 2 * tp / max(1, 2 * tp + fp + fn)

    found = [merit(i) for i in range(len(simplex_weights(parts)))]
    tied = [i for i, m in enumerate(found) if m == max(found)]
    grid = weight_grid(df, scores, label, parts, tied)
    best = F.max_by(F.struct(*grid.columns), F.struct(F.coalesce("roc_auc", F.lit(-1.0)), -F.col("weight_id")))
    return grid.agg(best.alias("best")).select("best.*")
