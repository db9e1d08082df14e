"""Cleaning: mapping columns, placeholders, coercion, imputing, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake import schema, settings as S
from leadlake.functions import text as X
from leadlake.operators.ranks import BUCKETS, exact_quantiles, top_rows


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename mapped columns and drop the rest; the first column of a field wins.

    One select, so the scan reads only the mapped columns.
    """
    chosen: dict[str, str] = {}
    for source, target in mapping.items():
        if source in df.columns:
            chosen.setdefault(target, source)
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in chosen.items()])


def clean_frame(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 25 canonical features in fixed order: numbers as DOUBLE, answers as STRING.

    A feature the source lacks is null. ``keep`` passes other columns through.
    """
    types = dict(df.dtypes)
    features = []
    for name in schema.FEATURES:
        numeric = name in schema.NUMERIC_FEATURES
        if name not in types:
            features.append(F.lit(None).cast("double" if numeric else "string").alias(name))
        elif numeric:
            features.append(X.to_number(F.col(name), types[name]).alias(name))
        else:
            features.append(X.null_placeholders(F.col(name)).cast("string").alias(name))
    return df.select(*keep, *features)


def long_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value) rows with the values as text, nulls kept."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value"))
             for c in features]
    return df.select(*by, F.inline(F.array(*pairs)))


def category_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per non-null (feature, value); partial counts are merged before the shuffle."""
    return (
        long_features(df, features, by).where(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def baseline_medians(df: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                     buckets: int = BUCKETS) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features]
    values = df.select(*by, F.inline(F.array(*pairs)))
    return exact_quantiles(values, "value", [0.5], [*by, "feature"], buckets).select(
        *by, "feature", F.col("quantile").alias("median")
    )


def baseline_modes(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per feature; the smallest of equally frequent ones."""
    return category_counts(df, features, by).groupBy(*by, "feature").agg(
        F.min(F.struct((-F.col("n")).alias("_n"), "value")).alias("_top")
    ).select(*by, "feature", F.col("_top.value").alias("mode"))


def baseline_row(df: DataFrame, by: Sequence[str] = (), buckets: int = BUCKETS,
                 numeric: Sequence[str] = tuple(schema.NUMERIC_FEATURES),
                 categorical: Sequence[str] = tuple(schema.CATEGORICAL_FEATURES)) -> DataFrame:
    """The typical lead of each group: one row with a median or mode per feature.

    ``df`` is a clean frame. A feature without values gets 0 or ``Unknown``.
    """
    keys = list(by)
    parts = []
    if numeric:
        medians = baseline_medians(df, numeric, by, buckets)
        parts.append(medians.select(*keys, "feature", F.col("median").cast("string").alias("v")))
    if categorical:
        modes = baseline_modes(df, categorical, by)
        parts.append(modes.select(*keys, "feature", F.col("mode").alias("v")))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wide = long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("v"))).alias(c) for c in (*numeric, *categorical)
    ])
    out = df.select(*keys).distinct().join(wide, keys, "left") if keys else wide
    return out.select(
        *keys,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
        *[F.coalesce(F.col(c), F.lit(schema.UNKNOWN)).alias(c) for c in categorical],
    )


def impute_baseline(df: DataFrame, baseline: DataFrame, by: Sequence[str] = (),
                    numeric: Sequence[str] = tuple(schema.NUMERIC_FEATURES),
                    categorical: Sequence[str] = tuple(schema.CATEGORICAL_FEATURES)) -> DataFrame:
    """Fill null or blank features from the group's baseline, else 0 or ``Unknown``.

    ``baseline`` has one row per group; give it as a stored table so that Catalyst knows
    its size. Without groups it is one row, read as a scalar subquery.
    """
    columns = [*numeric, *categorical]
    if by:
        packed = baseline.select(*by, F.struct(*columns).alias("_base"))
        joined = df.join(packed, list(by), "left")
    else:
        one = baseline.select(F.struct(*columns).alias("_base")).scalar()
        joined = df.withColumn("_base", one)
    filled = {c: F.coalesce(F.col(c), F.col(f"_base.{c}"), F.lit(0.0)) for c in numeric}
    filled |= {
        c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"_base.{c}"), F.lit(schema.UNKNOWN))
        for c in categorical
    }
    return joined.withColumns(filled).drop("_base")


def strip_pii(df: DataFrame, payload: str | None = None) -> DataFrame:
    """Drop personal columns whatever their case, and personal keys of a payload map."""
    out = df.drop(*[c for c in df.columns if c.lower() in S.PII_FIELDS])
    if payload is not None:
        out = out.withColumn(payload, F.map_filter(payload, lambda k, _: ~F.lower(k).isin(*S.PII_FIELDS)))
    return out


def drop_known_leaky(df: DataFrame) -> DataFrame:
    return df.drop(*S.POST_OUTCOME_COLUMNS)


def legacy_alias(df: DataFrame) -> DataFrame:
    """Old name of the time field fills the new one where that is absent; unknown columns go."""
    old, new = "total_time_spent_on_website", "time_on_site_seconds"
    if old in df.columns:
        known = F.col(new) if new in df.columns else F.lit(None)
        df = df.withColumn(new, F.coalesce(known.cast("double"), F.col(old).cast("double")))
    kept = [c for c in df.columns if c in schema.FEATURES or c in ("deal_value", "external_id", "lead_key", "tenant_id")]
    return df.select(*kept)


# Fields that may not be negative.
NON_NEGATIVE = (
    "total_time_spent_on_website", "page_views_per_visit", "total_visits",
    "time_on_site_seconds", "email_opens", "email_clicks", "form_submissions",
    "days_since_last_activity", "deal_value",
)


def validate_ranges(df: DataFrame) -> DataFrame:
    """Adds ``reasons``: the fields below 0. Empty means valid; filter on its size."""
    present = [c for c in NON_NEGATIVE if c in df.columns]
    checks = [F.when(F.col(c) < 0, F.lit(f"{c} must be >= 0")) for c in present]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def mapping_gate(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of sources with a confirmed mapping, one status row per source)."""
    confirmed = sources.where(F.col("mapping_confirmed")).select("source_id")
    passed = records.join(confirmed, "source_id", "left_semi")
    blocked = ~F.coalesce(F.col("mapping_confirmed"), F.lit(False))
    status = sources.select(
        "source_id", F.when(blocked, "blocked").otherwise("ready").alias("status"),
        F.when(blocked, "Schema mapping is not confirmed yet.").alias("error"),
    )
    return passed, status


def labelled_rows(df: DataFrame, label: str = "converted") -> DataFrame:
    """Rows with a readable label, as 0/1."""
    dtype = dict(df.dtypes)[label]
    return df.withColumn(label, X.coerce_label(F.col(label), dtype)).where(F.col(label).isNotNull())


def sample_rows(df: DataFrame, fraction: float = 0.1, seed: int = 42, id_column: str = "lead_key") -> DataFrame:
    """About ``fraction`` of the rows, chosen by the md5 of seed and id: the same rows whatever the partitions, the
    engine or the other rows are. Rows of one id come or go together; a null id is an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(place < F.lit(int(fraction * (1 << 32))))


def drop_index_column(df: DataFrame, names: Sequence[str] = ("Unnamed: 0", "_c0", "")) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names])


def sample_for_inspection(df: DataFrame, n: int = 300) -> DataFrame:
    """The first n records, for a person to look at; profiles use the whole table."""
    return df.limit(n)


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text: the shape in which sources deliver records."""
    return df.select(*[F.col(f"`{c}`").cast(T.StringType()).alias(c) for c in df.columns])


def category_options(df: DataFrame, features: Sequence[str], k: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent values per feature; ties by value."""
    counts = category_counts(df, features, by)
    return top_rows(counts, [F.desc("n"), F.asc("value")], k, [*by, "feature"], "value")


def contact_suppression(df: DataFrame) -> DataFrame:
    """Leads that refused contact."""
    from leadlake.functions.scoring import opted_out

    return df.where(opted_out(F.col("do_not_contact")))


def typed_payload(payload: Column) -> Column:
    """A JSON payload as the canonical struct; unknown keys are ignored."""
    return F.from_json(payload, schema.CANONICAL_STRUCT)
