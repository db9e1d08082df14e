"""Screen features for target leakage, every feature of every group in one job.

Features are unpivoted and collapsed to (feature, value, rows, positives) before anything
else, so only distinct values shuffle. Both checks run on that table for every feature;
which one counts is decided at the end, on one row per feature. No feature is skipped for
having many values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake import settings as S
from leadlake.functions.numbers import ratio, round_to
from leadlake.functions.text import suspicious_name, to_number
from leadlake.operators.clean import long_features
from leadlake.operators.metrics import auc_from_gain, cumulate
from leadlake.operators.ranks import BUCKETS, top_rows
from leadlake.session import store


def value_counts(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, n, pos) with null values kept as a row of their own."""
    rows = long_features(df.withColumn("_y", F.col(label).cast("int")), features, [*by, "_y"])
    return rows.groupBy(*by, "feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")
    )


def category_conversion(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    counts = value_counts(df, features, label, by).where(F.col("value").isNotNull())
    return counts.select(*by, "feature", "value", "n", ratio(F.col("pos"), F.col("n")).alias("rate"))


def category_purity(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features whose supported values are nearly pure, with severity before names count."""
    keys = [*by, "feature"]
    rate = ratio(F.col("pos"), F.col("n"))
    present = counts.where(F.col("value").isNotNull()).withColumn("rate", rate)
    is_extreme = (F.col("n") >= S.MIN_SUPPORT) & (
        (F.col("rate") >= S.PURITY_LIMIT) | (F.col("rate") <= S.PURITY_FLOOR))
    summary = present.groupBy(*keys).agg(
        F.sum("n").alias("_rows"), F.sum(F.when(is_extreme, F.col("n"))).alias("_covered"),
        F.count_if(is_extreme).alias("extreme_values"),
        F.max(F.when(is_extreme, F.greatest(F.col("rate"), 1.0 - F.col("rate")))).alias("_worst"),
    ).where(F.col("extreme_values") > 0)
    shown = F.concat(F.lit("'"), F.col("value"), F.lit("'="),
                     F.format_string("%.1f%%", round_to(F.col("rate") * 100.0, 1)))
    examples = (
        top_rows(present.where(is_extreme), [F.col("value")], 3, keys, "value", "_i")
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", shown.alias("t")))).alias("_e"))
        .select(*keys, F.array_join(F.transform("_e", lambda e: e["t"]), ", ").alias("examples"))
    )
    coverage = ratio(F.col("_covered"), F.col("_rows"))
    severity = (
        F.when(coverage >= S.CRITICAL_COVERAGE, "critical")
        .when(coverage >= S.HIGH_COVERAGE, "high").otherwise("moderate")
    )
    return summary.where(coverage >= S.MIN_COVERAGE).join(examples, keys).select(
        *keys, severity.alias("severity"), round_to(F.col("_worst"), 4).alias("statistic"),
        "extreme_values", coverage.alias("coverage"), "examples",
    )


def numeric_solo_auc(counts: DataFrame, by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """AUC of each feature alone, read as a number; only strong ones get a severity."""
    keys = [*by, "feature"]
    scored = counts.withColumn("score", to_number(F.col("value"))).where(F.col("score").isNotNull())
    per_score = scored.groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"))
    auc = auc_from_gain(cumulate(per_score, keys, buckets), keys)
    usable = (F.col("positives") + F.col("negatives") >= S.MIN_SUPPORT) & F.col("roc_auc").isNotNull()
    strength = F.greatest(F.col("roc_auc"), 1.0 - F.col("roc_auc"))
    severity = F.when(strength >= S.SOLO_AUC_CRITICAL, "critical").when(strength >= S.SOLO_AUC_LIMIT, "high")
    return auc.where(usable).select(
        *keys, "roc_auc", round_to(strength, 4).alias("statistic"), severity.alias("severity"))


def feature_kinds(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: distinct values and whether it is read as a number (nulls count against)."""
    numeric = F.sum(F.when(to_number(F.col("value")).isNotNull(), F.col("n")).otherwise(0))
    return counts.groupBy(*by, "feature").agg(
        F.sum("n").alias("rows"), F.count("value").alias("distinct_values"),
        (ratio(numeric, F.sum("n")) > S.NUMERIC_SHARE).alias("is_numeric"),
    )


def escalate(severity: Column, feature: Column) -> Column:
    """A telling name raises a finding by one level; it never makes one."""
    raised = F.when(severity == "moderate", "high").otherwise("critical")
    return F.when(suspicious_name(feature), raised).otherwise(severity)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), severity).cast("int")


def detect_leakage(df: DataFrame, features: Sequence[str], label: str = "converted",
                   by: Sequence[str] = (), quarantine_at: str = "high",
                   buckets: int = BUCKETS) -> DataFrame:
    """One row per finding: feature, severity, reason, statistic, detail, quarantined.

    The source is scanned once; the stored value counts feed every check.
    """
    keys = [*by, "feature"]
    counts = store(value_counts(df.where(F.col(label).isNotNull()), features, label, by))
    kinds = feature_kinds(counts, by).where(F.col("distinct_values") >= 2)
    pure = category_purity(counts, by).select(
        *keys, "severity", "statistic", F.lit("category_purity").alias("reason"),
        F.concat(
            F.col("extreme_values").cast("string"), F.lit(" category value(s) covering "),
            F.format_string("%.0f%%", round_to(F.col("coverage") * 100.0, 0)),
            F.lit(" of rows are near-perfectly separated ("), F.col("examples"), F.lit(")"),
        ).alias("detail"),
    )
    alone = numeric_solo_auc(counts, by, buckets).where(F.col("severity").isNotNull()).select(
        *keys, "severity", "statistic", F.lit("solo_auc").alias("reason"),
        F.concat(
            F.lit("alone predicts the outcome at AUC "),
            F.format_string("%.3f", round_to(F.col("statistic"), 3)),
            F.lit("; a legitimate single feature rarely exceeds 0.90"),
        ).alias("detail"),
    )
    right_check = F.col("is_numeric") == (F.col("reason") == "solo_auc")
    limit = S.SEVERITIES.index(quarantine_at) + 1
    found = pure.unionByName(alone).join(kinds, keys).where(right_check)
    return found.withColumn("severity", escalate(F.col("severity"), F.col("feature"))).select(
        *keys, "severity", "reason", "statistic", "detail",
        (severity_rank(F.col("severity")) <= limit).alias("quarantined"),
    ).orderBy(*by, severity_rank(F.col("severity")), F.desc("statistic"), "feature")


def leakage_summary(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and one text line per finding (at most one finding per feature)."""
    line = F.concat(F.lit("  ["), F.col("severity"), F.lit("] "), F.col("feature"), F.lit(": "), F.col("detail"))
    order = F.struct(severity_rank(F.col("severity")), (-F.col("statistic")).alias("s"), F.col("feature"), line.alias("line"))
    grouped = findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("quarantined").alias("quarantined"),
        F.array_sort(F.collect_list(order)).alias("_l"),
    )
    head = F.concat(F.col("findings").cast("string"), F.lit(" potential leak(s) found; "),
                    F.col("quarantined").cast("string"), F.lit(" feature(s) quarantined."))
    lines = F.array_join(F.transform("_l", lambda l: l["line"]), "\n")
    return grouped.select(*by, "findings", "quarantined", F.concat(head, F.lit("\n"), lines).alias("summary"))


def drop_quarantined(features: DataFrame, findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Features minus the quarantined ones that nobody approved; all keyed by ``feature``."""
    blocked = findings.where("quarantined").select("feature").join(overrides, "feature", "left_anti")
    return features.join(blocked, "feature", "left_anti")
