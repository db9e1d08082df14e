"""Propose, review and confirm how source columns map onto the canonical schema.

Profiles read the whole of every source; everything after the profile works on one row per
column or per (column, field) pair of a source, which is a catalog.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake import schema, settings as S
from leadlake.functions.numbers import ratio, round_to
from leadlake.functions.similarity import field_similarities
from leadlake.functions.text import folded, looks_like_timestamp, normalize_key, null_placeholders, to_number
from leadlake.operators.clean import long_features


def column_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Per column: rows with a value, distinct values, numeric and date share, binary flag.

    Distinct values are counted exactly by grouping on them first; no value set is held in
    one buffer.
    """
    rows = long_features(df, columns, by).withColumn("value", null_placeholders(F.col("value")))
    counts = rows.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    held = lambda cond: F.sum(F.when(present & cond, F.col("n")).otherwise(0))
    pairs = [F.coalesce(F.bool_and(F.when(present, folded(F.col("value")).isin(*pair))), F.lit(False))
             for pair in S.BINARY_VALUE_PAIRS]
    binary = pairs[0]
    for p in pairs[1:]:
        binary = binary | p
    stats = counts.groupBy(*by, F.col("feature").alias("column")).agg(
        F.sum("n").alias("rows"), held(F.lit(True)).alias("non_missing"), F.count("value").alias("distinct_values"),
        held(to_number(F.col("value")).isNotNull()).alias("_numeric"),
        held(looks_like_timestamp(F.col("value"))).alias("_dates"), binary.alias("is_binary"),
    )
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("non_missing")), F.lit(0.0))
    return stats.select(
        *by, "column", "rows", "non_missing", "distinct_values",
        share("_numeric").alias("numeric_ratio"), share("distinct_values").alias("distinct_ratio"),
        share("_dates").alias("timestamp_ratio"), "is_binary",
    )


def shape_score(kind: Column) -> Column:
    """How well a profiled column fits a field kind, 0 to 1."""
    repeat = F.col("distinct_ratio")
    category = (
        F.when(F.col("distinct_values") <= 1, 0.2).when(repeat < 0.05, 1.0)
        .when(repeat < 0.2, 0.6).otherwise(0.15)
    )
    return (
        F.when(F.col("non_missing") == 0, 0.0)
        .when(kind.isin("numeric", "value"), F.col("numeric_ratio"))
        .when(kind == "target", F.when(F.col("is_binary"), 1.0).otherwise(0.0))
        .when(kind == "identity", repeat)
        .when(kind == "timestamp", F.col("timestamp_ratio"))
        .when(kind == "categorical", category).otherwise(0.0)
    )


def _kind_of(field: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for f in schema.FIELDS for x in (f.name, f.kind)])
    return kinds[field]


def alias_match(profile: DataFrame) -> DataFrame:
    """Columns whose normalized name is a known alias, with the field it stands for."""
    table = profile.sparkSession.createDataFrame(schema.alias_pairs(), "normalized string, field string")
    # Fixed list of under 200 aliases, so the broadcast cannot grow with the data.
    return profile.withColumn("normalized", normalize_key(F.col("column"))).join(
        F.broadcast(table), "normalized")


def fuzzy_match(profile: DataFrame) -> DataFrame:
    """(column, field) pairs whose best alias similarity is at least 0.72."""
    named = profile.withColumn("normalized", normalize_key(F.col("column")))
    # Sources share many names, so each distinct name is compared once.
    return named.join(field_similarities(named, "normalized", S.NAME_FLOOR), "normalized")


def mapping_candidates(profile: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Best evidence for each (column, field): confidence, method, evidence."""
    shape = shape_score(_kind_of(F.col("field")))
    strong, weak = S.ALIAS_CONFIDENCE
    exact = alias_match(profile).select(
        *by, "column", "field", F.when(shape >= 0.5, strong).otherwise(weak).alias("confidence"),
        F.lit("alias").alias("method"),
        F.concat(F.lit("'"), F.col("column"), F.lit("' is a known synonym")).alias("evidence"),
    )
    percent = lambda c: F.format_string("%.0f%%", round_to(c * 100.0, 0))
    near = fuzzy_match(profile).select(
        *by, "column", "field",
        (S.NAME_WEIGHT * F.col("name_score") + S.SHAPE_WEIGHT * shape).alias("confidence"),
        F.lit("fuzzy").alias("method"),
        F.concat(F.lit("name similarity "), percent(F.col("name_score")), F.lit(", value shape "),
                 percent(shape)).alias("evidence"),
    )
    # A fuzzy score replaces an alias only when it is larger.
    best = F.max_by(F.struct("confidence", "method", "evidence"),
                    F.struct("confidence", (F.col("method") == "alias").cast("int")))
    return exact.unionByName(near).groupBy(*by, "column", "field").agg(best.alias("b")).select(
        *by, "column", "field", "b.*")


def _assigned(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The pairs that a greedy choice takes: confirmed ones, then the strongest first; each column and each field once.

    A source's pairs, its columns times thirty fields at most, are folded in order.
    """
    item = F.struct((F.col("method") != "confirmed").alias("late"), (-F.col("confidence")).alias("order"), F.col("column"), F.col("field"))
    sure = F.when(F.col("confidence") >= S.REVIEW_FLOOR, item)
    ordered = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(sure)).alias("_pairs"))  # bounded by the header

    def take(chosen: Column, p: Column) -> Column:
        taken = F.exists(chosen, lambda c: (c["column"] == p["column"]) | (c["field"] == p["field"]))
        return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(F.struct(p["column"].alias("column"), p["field"].alias("field")))))

    none = F.array().cast("array<struct<column:string,field:string>>")
    return ordered.select(*by, F.inline(F.aggregate("_pairs", none, take)))


def propose_mapping(profile: DataFrame, confirmed: DataFrame | None = None,
                    source: str = "source_id") -> DataFrame:
    """One proposal per source column.

    Columns: source, column, canonical_field, confidence, method, evidence, needs_review,
    alternatives. ``confirmed`` (source, column, field) pairs hold their field at 1.0.
    Ties are broken by column, then field, so column order does not matter.
    """
    by = [source]
    pairs = mapping_candidates(profile, by)
    if confirmed is not None:
        held = confirmed.select(source, "column", "field")
        pairs = pairs.join(held.select(source, "column"), [source, "column"], "left_anti")
        pairs = pairs.unionByName(held.select(
            *by, "column", "field", F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("method"),
            F.lit("Confirmed by a human.").alias("evidence")))
    pairs = pairs.where(F.col("confidence").isNotNull())
    chosen = _assigned(pairs, by).withColumn("_yes", F.lit(True))
    settled = pairs.join(chosen, [*by, "column", "field"], "left").withColumn("assigned", F.col("_yes").isNotNull())
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("confidence")).alias("order"), F.col("field"))))
    folded_up = settled.groupBy(source, "column").agg(
        F.max(F.when(F.col("assigned"), F.struct("field", "confidence", "method", "evidence"))).alias("_a"),
        F.slice(ranked, 1, 4).alias("_top"),
    )
    rest = F.filter("_top", lambda t: F.coalesce(t["field"] != F.col("_a.field"), F.lit(True)))
    alternatives = F.when(
        F.coalesce(F.col("_a.method"), F.lit("")) == "confirmed", F.array().cast("array<struct<canonical_field:string,confidence:double>>")
    ).otherwise(F.transform(
        F.when(F.col("_a").isNotNull(), F.slice(rest, 1, 3)).otherwise(rest),
        lambda t: F.struct(t["field"].alias("canonical_field"), round_to(-t["order"], 3).alias("confidence"))))
    joined = profile.select(source, "column").join(folded_up, [source, "column"], "left")
    if confirmed is not None:
        extra = confirmed.select(source, "column").join(profile, [source, "column"], "left_anti")
        joined = joined.unionByName(extra.join(folded_up, [source, "column"]))
    method = F.coalesce(F.col("_a.method"), F.when(F.col("_top").isNull(), "none").otherwise("conflict"))
    confidence = F.coalesce(round_to(F.col("_a.confidence"), 3), F.lit(0.0))
    return joined.select(
        source, "column", F.col("_a.field").alias("canonical_field"), confidence.alias("confidence"),
        method.alias("method"),
        F.coalesce(
            F.col("_a.evidence"),
            F.when(F.col("_top").isNull(), "No canonical field resembles this column.")
            .otherwise("every candidate field was claimed by a stronger match")).alias("evidence"),
        (F.col("_a").isNotNull() & (F.coalesce(F.col("_a.confidence"), F.lit(0.0)) < S.AUTO_ACCEPT)).alias("needs_review"),
        F.coalesce(alternatives, F.array().cast("array<struct<canonical_field:string,confidence:double>>")).alias("alternatives"),
    )


def needs_review(proposals: DataFrame) -> DataFrame:
    return proposals.where("needs_review")


def unmapped_columns(columns: DataFrame, mapping: DataFrame, source: str = "source_id") -> DataFrame:
    """Columns without a field; ``mapping`` has (source, column, field)."""
    return columns.select(source, "column").join(mapping.where("field IS NOT NULL"), [source, "column"], "left_anti")


def mapped_features(mapping: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, field) pairs of the mapping that are features."""
    return mapping.select(source, "field").where(F.col("field").isin(*schema.FEATURES)).distinct()


def missing_features(mapping: DataFrame, source: str = "source_id") -> DataFrame:
    """Features of each source that no column fills."""
    wanted = mapping.select(source).distinct().select(
        source, F.explode(F.array(*[F.lit(f) for f in schema.FEATURES])).alias("field"))
    return wanted.join(mapped_features(mapping, source), [source, "field"], "left_anti")


def mapping_coverage(mapping: DataFrame, source: str = "source_id") -> DataFrame:
    """Mapped and missing feature lists, share of the 25 and whether the label is mapped."""
    features = F.array(*[F.lit(f) for f in schema.FEATURES])
    fields = mapping.groupBy(source).agg(F.collect_set("field").alias("_f"))  # thirty at most
    mapped = F.array_sort(F.array_intersect(features, "_f"))
    return fields.select(
        source, mapped.alias("mapped_features"),
        F.array_sort(F.array_except(features, "_f")).alias("missing_features"),
        round_to(F.size(mapped) / F.lit(float(len(schema.FEATURES))), 3).alias("coverage"),
        F.array_contains("_f", "converted").alias("has_target"),
    )


def mapping_summary(proposals: DataFrame, source: str = "source_id") -> DataFrame:
    """Counts of confident, uncertain, unmapped and missing, with a text per source.

    The text lists every mapped column, then up to twelve unmapped ones; a source has one
    proposal per column, so the list is as short as its header.
    """
    features = list(schema.FEATURES)
    counted = proposals.groupBy(source).agg(
        F.count_if(F.col("canonical_field").isNotNull() & ~F.col("needs_review")).alias("confident"),
        F.count_if("needs_review").alias("review"),
        F.count_if(F.col("canonical_field").isNull()).alias("unmapped"),
        (F.lit(len(features)) - F.count_if(F.col("canonical_field").isin(*features))).alias("missing"),
    )
    mark = F.when(F.col("needs_review"), "?").otherwise("=")
    line = F.concat(F.lit("  "), F.col("column"), F.lit(" "), mark, F.lit("> "), F.col("canonical_field"), F.lit(" ("),
                    F.format_string("%.0f%%", round_to(F.col("confidence") * 100.0, 0)), F.lit(", "), F.col("method"), F.lit(")"))
    listed = proposals.groupBy(source).agg(
        F.array_sort(F.collect_list(F.when(F.col("canonical_field").isNotNull(), line))).alias("_lines"),
        F.array_sort(F.collect_list(F.when(F.col("canonical_field").isNull(), F.col("column")))).alias("_rest"))
    head = F.concat(F.col("confident").cast("string"), F.lit(" column(s) mapped confidently, "),
                    F.col("review").cast("string"), F.lit(" need confirmation."))
    rest = F.when(F.size("_rest") > 0, F.concat(F.lit("  unmapped: "), F.array_join(F.slice("_rest", 1, 12), ", ")))
    none = F.when(F.col("missing") > 0, F.concat(F.lit("  canonical fields with no source: "), F.col("missing").cast("string")))
    text = F.array_join(F.array_compact(F.concat(F.array(head), F.col("_lines"), F.array(rest), F.array(none))), "\n")
    return counted.join(listed, source).withColumn("summary", text).drop("_lines", "_rest")


def merge_confirmations(mapping: DataFrame, corrections: DataFrame, source: str = "source_id") -> DataFrame:
    """Corrections (source, column, field, position) laid over a mapping.

    A null field rejects the column. A field moves to the column of the last correction
    that names it. Fields outside the schema are an error.
    """
    known = F.col("field").isNull() | F.col("field").isin(*schema.FIELD_NAMES)
    checked = corrections.select(
        source, "column",
        F.when(known, F.col("field")).otherwise(
            F.raise_error(F.concat(F.lit("Unknown canonical field: "), "field"))).alias("field"),
        F.col("position").cast("int").alias("priority"))
    both = mapping.select(source, "column", "field", F.lit(-1).alias("priority")).unionByName(checked)
    per_column = both.groupBy(source, "column").agg(F.max(F.struct("priority", "field")).alias("_b"))
    per_column = per_column.select(source, "column", "_b.field", "_b.priority").where("field IS NOT NULL")
    return per_column.groupBy(source, "field").agg(
        F.max_by("column", F.struct("priority", "column")).alias("column")).select(source, "column", "field")

