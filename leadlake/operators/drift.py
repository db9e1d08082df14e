"""Reference distributions, population stability and health.

The reference statistics are a table: one row per (group, feature, bin) with its share. It
is small (at most 25 rows a feature); keep it stored, so that Catalyst knows its size when
the live rows are joined to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import schema, settings as S
from leadlake.functions.numbers import ratio, round_to
from leadlake.operators.clean import category_counts
from leadlake.operators.ranks import BUCKETS, count_values, quantiles_of_counts, top_rows
from leadlake.session import store

OTHER = "(other)"


def _long_numbers(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    return df.select(*by, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _bin(edges: Column, value: Column) -> Column:
    """1-based bin among an edge array; the last is closed; null outside."""
    at = F.size(F.filter(edges, lambda e: e <= value))
    top = F.size(edges)
    return F.when((at >= 1) & (value <= F.element_at(edges, -1)), F.least(at, top - 1))


def numeric_statistics(df: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                       buckets: int = BUCKETS) -> DataFrame:
    """Shares per value for features of at most 20 values, else a decile histogram."""
    keys = [*by, "feature"]
    counts = count_values(_long_numbers(df, features, by), "value", keys)
    basics = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_distinct"), F.sum("n").alias("_total"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    points = [i / S.QUANTILE_BINS for i in range(S.QUANTILE_BINS + 1)]
    edges = quantiles_of_counts(counts, "value", points, keys, buckets).groupBy(*keys).agg(
        F.array_sort(F.collect_set("quantile")).alias("_edges"))  # eleven values at most
    # Stored: one row a feature, and Catalyst sees that it is small.
    profile = store(basics.join(edges, keys))
    discrete = F.col("_distinct") <= S.DISCRETE_VALUE_LIMIT
    listed = counts.join(profile.where(discrete), keys).select(
        *keys, F.lit("numeric_discrete").alias("kind"), F.col("value").cast("string").alias("bin_key"),
        F.col("value").alias("low"), F.col("value").alias("high"), ratio(F.col("n"), F.col("_total")).alias("share"), "mean",
    )
    # Every pair of edges is a bin, also one that no value falls into.
    histograms = profile.where(~discrete & (F.size("_edges") >= 3))
    bins = histograms.withColumn("bin", F.explode(F.sequence(F.lit(1), F.size("_edges") - 1)))
    filled = counts.join(histograms.select(*keys, "_edges"), keys).groupBy(
        *keys, _bin(F.col("_edges"), F.col("value")).alias("bin")).agg(F.sum("n").alias("n"))
    return listed.unionByName(bins.join(filled, [*keys, "bin"], "left").select(
        *keys, F.lit("numeric").alias("kind"), F.col("bin").cast("string").alias("bin_key"),
        F.get("_edges", F.col("bin") - 1).alias("low"), F.get("_edges", F.col("bin")).alias("high"),
        ratio(F.coalesce("n", F.lit(0)), F.col("_total")).alias("share"), "mean",
    ))


def categorical_statistics(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shares of the 25 most frequent values among all non-null rows."""
    keys = [*by, "feature"]
    counts = store(category_counts(df, features, by))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    top = top_rows(counts, [F.desc("n"), F.asc("value")], S.CATEGORY_LIMIT, keys, "value", "_i")
    none = F.lit(None).cast("double")
    return top.join(totals, keys).select(
        *keys, F.lit("categorical").alias("kind"), F.col("value").alias("bin_key"),
        none.alias("low"), none.alias("high"), ratio(F.col("n"), F.col("_total")).alias("share"),
        none.alias("mean"),
    )


def feature_statistics(df: DataFrame, by: Sequence[str] = (),
                       numeric: Sequence[str] = tuple(schema.NUMERIC_FEATURES),
                       categorical: Sequence[str] = tuple(schema.CATEGORICAL_FEATURES),
                       buckets: int = BUCKETS) -> DataFrame:
    """Reference statistics of a clean frame; features without values are absent."""
    return numeric_statistics(df, numeric, by, buckets).unionByName(
        categorical_statistics(df, categorical, by))


def pack_statistics(statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per feature: its kind, histogram edges and known keys (25 at most)."""
    edges = F.array_sort(F.array_distinct(F.concat(
        F.collect_list(F.when(F.col("kind") == "numeric", F.col("low"))),
        F.collect_list(F.when(F.col("kind") == "numeric", F.col("high"))),
    )))
    return statistics.groupBy(*by, "feature").agg(
        F.first("kind").alias("kind"), edges.alias("edges"), F.collect_set("bin_key").alias("keys"))


def _live_values(live: DataFrame, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    known = [c for c in live.columns if c in schema.FEATURES]
    # The number is made here once, not from text for every edge it is compared with.
    number = lambda c: F.col(c) if c in schema.NUMERIC_FEATURES else F.lit(None)
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("text"),
                 number(c).cast("double").alias("number")) for c in known
    ]
    return live.select(*extra, *by, F.inline(F.array(*pairs))).where(F.col("text").isNotNull())


def _bin_key() -> Column:
    return (
        F.when(F.col("kind") == "numeric", _bin(F.col("edges"), F.col("number")).cast("string"))
        .when(F.array_contains("keys", F.col("text")), F.col("text"))
    )


def live_bins(live: DataFrame, statistics: DataFrame, by: Sequence[str] = (),
              extra: Sequence[str] = ()) -> DataFrame:
    """(extra, by, feature, kind, bin_key) of every live value; null key = outside.

    Works on batch and on streaming frames. ``extra`` passes columns such as an event time.
    """
    placed = _live_values(live, by, extra).join(pack_statistics(statistics, by), [*by, "feature"])
    return placed.select(*extra, *by, "feature", "kind", _bin_key().alias("bin_key"))


def live_counts(live: DataFrame, statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Live rows per bin, stored: what several steps read next.

    Equal values are counted before the join, so it sees distinct values, not rows.
    """
    values = _live_values(live, by, ()).groupBy(*by, "feature", "text", "number").agg(F.count(F.lit(1)).alias("n"))
    placed = values.join(pack_statistics(statistics, by), [*by, "feature"])
    return store(placed.groupBy(*by, "feature", _bin_key().alias("bin_key")).agg(F.sum("n").alias("n")))


def reference_vs_live(statistics: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and observed share per bin, a missing side as 0, with the (other) bin.

    Histogram shares leave out live values beyond the edges; the other kinds collect
    whatever the reference does not list in one more bin. All rows here are per bin.
    """
    keys = [*by, "feature"]
    outside = counts.withColumn("bin_key", F.coalesce("bin_key", F.lit(OTHER)))
    names = [c for c in by if c not in statistics.columns]
    # Groups seen live meet the whole reference, so a bin nobody hit still counts.
    seen = counts.select(*keys).distinct()
    reference = statistics.select(*[c for c in keys if c not in names], "kind", "bin_key", "share")
    expected = seen.join(reference, [c for c in keys if c not in names])
    other = expected.groupBy(*keys, "kind").agg(F.greatest(1.0 - F.sum("share"), F.lit(0.0)).alias("share"))
    other = other.where(F.col("kind") != "numeric").withColumn("bin_key", F.lit(OTHER))
    full = expected.unionByName(other).join(outside, [*keys, "bin_key"], "full_outer")
    group = Window.partitionBy(*keys)  # at most 27 rows
    kind = F.max("kind").over(group)
    inside = F.col("share").isNotNull()
    total = F.sum(F.when((kind != "numeric") | inside, F.col("n"))).over(group)
    return full.withColumns({"_kind": kind, "_total": total}).where(inside).select(
        *keys, F.col("_kind").alias("kind"), "bin_key", F.col("share").alias("expected"),
        F.coalesce(ratio(F.col("n"), F.col("_total")), F.lit(0.0)).alias("observed"),
    )


def psi(statistics: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Population stability index per feature; both shares clipped at 1e-6."""
    bins = reference_vs_live(statistics, counts, by)
    e, o = (F.greatest(F.col(c), F.lit(S.PSI_EPSILON)) for c in ("expected", "observed"))
    return bins.groupBy(*by, "feature").agg(F.sum((o - e) * F.ln(o / e)).alias("psi"))


def drift_severity(c: Column) -> Column:
    return F.when(c >= S.PSI_ALERT, "alert").when(c >= S.PSI_WARN, "warn").otherwise("ok")


def drift_signals(statistics: DataFrame, live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features that moved, largest index first."""
    scored = psi(statistics, live_counts(live, statistics, by), by)
    severity = drift_severity(F.col("psi"))
    moved = F.when(F.col("severity") == "alert", "materially").otherwise("noticeably")
    out = scored.withColumn("severity", severity).where(F.col("severity") != "ok")
    return out.select(
        *by, "feature", round_to(F.col("psi"), 4).alias("psi"), "severity",
        F.concat(F.lit("PSI "), F.format_string("%.3f", round_to(F.col("psi"), 3)),
                 F.lit(" — the distribution of '"), F.col("feature"), F.lit("' has moved "), moved,
                 F.lit(" since training")).alias("detail"),
    ).orderBy(*by, F.desc("psi"), "feature")


def detect_drift(statistics: DataFrame, live: DataFrame, by: Sequence[str] = (),
                 min_rows: int = S.MIN_DRIFT_ROWS) -> DataFrame:
    """One row per group: status, rows_examined and how many features warn or alert."""
    rows = live.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_examined"))
    signals = drift_signals(statistics, live, by).groupBy(*by).agg(
        F.count_if(F.col("severity") == "alert").alias("alerts"),
        F.count_if(F.col("severity") == "warn").alias("warnings"), F.max("psi").alias("worst_psi"))
    keys = list(by)
    if not keys:
        keys = ["_all"]
        rows, signals = (t.withColumn("_all", F.lit(1)) for t in (rows, signals))
    few = F.col("rows_examined") < min_rows
    n = lambda c: F.when(few, 0).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    status = (
        F.when(few, "insufficient_data").when(F.col("alerts") > 0, "alert")
        .when(F.col("warnings") > 0, "warn").otherwise("ok")
    )
    return rows.join(signals, keys, "left").select(
        *by, status.alias("status"), "rows_examined", n("alerts").alias("alerts"),
        n("warnings").alias("warnings"), F.when(~few, F.col("worst_psi")).alias("worst_psi"),
    )


def health_rollup(drift: DataFrame, calibration: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """The worse of both checks per group, whether to act, and the advice."""
    order = F.array(*[F.lit(s) for s in S.HEALTH_ORDER])
    both = drift.select(*by, F.col("status").alias("drift")).join(
        calibration.select(*by, F.col("status").alias("calibration")), list(by), "full_outer")
    place = lambda c: F.coalesce(F.array_position(order, F.col(c)), F.lit(2))
    worst = F.element_at(order, F.greatest(place("drift"), place("calibration")).cast("int"))
    advice = F.create_map(*[F.lit(x) for pair in S.HEALTH_ADVICE.items() for x in pair])
    return both.withColumn("status", worst).select(
        *by, "status", "drift", "calibration", (F.col("status") == "alert").alias("action_required"),
        advice[F.col("status")].alias("recommendation"),
    )
